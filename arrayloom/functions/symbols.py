"""Symbol vectors over a base: binary, unsigned(B) or signed(B)."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Base:
    """``kind`` is binary, unsigned or signed; ``b`` the number of symbols."""

    kind: str
    b: int = 2

    @property
    def cardinality(self) -> int:
        return 2 if self.kind == "binary" else self.b

    @property
    def bits_per_dim(self) -> float:
        return log2(self.cardinality)

    @property
    def low(self) -> int:
        return -(self.b // 2) if self.kind == "signed" else 0

    @property
    def high(self) -> int:
        return self.b // 2 if self.kind == "signed" else self.cardinality - 1

    @property
    def is_signed(self) -> bool:
        return self.kind == "signed"

    @property
    def has_cancellation(self) -> bool:
        return self.is_signed

    def storage_bits(self, d: int) -> int:
        return d * max(1, ceil(self.bits_per_dim))

    def storage_bytes(self, d: int) -> int:
        return -(-self.storage_bits(d) // 8)

    @property
    def name(self) -> str:
        return {"binary": "Binary", "unsigned": f"Unsigned({self.b})", "signed": f"Signed({self.b})"}[self.kind]

    def template(self, d: int, rng: np.random.Generator) -> list[int]:
        """A random vector of the base."""
        return rng.integers(self.low, self.high + 1, d).tolist()


BINARY = Base("binary")


def _clamp(x: Column, base: Base) -> Column:
    return F.greatest(F.lit(base.low), F.least(F.lit(base.high), x))


def bind_element(x: Column, y: Column, base: Base) -> Column:
    x, y = x.cast("int"), y.cast("int")
    if base.kind == "binary":
        return x.bitwiseXOR(y)
    return F.pmod(x + y, F.lit(base.b)) if base.kind == "unsigned" else _clamp(x + y, base)


def unbind_element(x: Column, y: Column, base: Base) -> Column:
    x, y = x.cast("int"), y.cast("int")
    if base.kind == "binary":
        return x.bitwiseXOR(y)
    return F.pmod(x - y, F.lit(base.b)) if base.kind == "unsigned" else _clamp(x - y, base)


def bind(a: Column, b: Column, base: Base) -> Column:
    return F.zip_with(a, b, lambda x, y: bind_element(x, y, base))


forward_bind = bind


def bind_deep(vectors: list[Column], base: Base) -> Column:
    """Bind one after the other."""
    out = vectors[0]
    for v in vectors[1:]:
        out = bind(out, v, base)
    return out


def unbind(bound: Column, role: Column, base: Base) -> Column:
    """Undo a binding; a signed one that was cut off at the range's end does not come back."""
    return F.zip_with(bound, role, lambda x, y: unbind_element(x, y, base))


reverse_unbind = unbind


def bundle_element(total: Column, n: Column, base: Base) -> Column:
    """One place of a bundle from the sum of its symbols: the majority (a tie gives 0), or the sum cut to the range."""
    if base.kind == "binary":
        return F.when(2 * total > n, 1).otherwise(0)
    return _clamp(total, base).cast("int")


def distance(a: Column, b: Column) -> Column:
    """Places with different symbols."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
