"""Quantisation of arrays of numbers, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import let


def _clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def u8(a: Column) -> Column:
    """Asymmetric 8 bits: (q, scale, zero_point); scale is the range by 255, 1 for a constant array."""
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    scale = F.when(high - low == 0, F.lit(1.0)).otherwise((high - low) / 255)
    zero = _clamp(F.round(-low / scale), 0, 255).cast("int")

    def apply(p: Column) -> Column:
        q = F.transform(a, lambda x: _clamp(F.round(x.cast("double") / p["scale"]) + p["zero_point"], 0, 255).cast("smallint"))
        return F.struct(q.alias("q"), p["scale"].alias("scale"), p["zero_point"].alias("zero_point"))

    return let(F.struct(scale.alias("scale"), zero.alias("zero_point")), apply)


def symmetric(a: Column, levels: int, low: int | None = None) -> Column:
    """Symmetric integers: scale is the largest absolute value by ``levels``, 1 where that is 0."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, F.lit(1.0)).otherwise(top / levels)

    def apply(p: Column) -> Column:
        q = F.transform(a, lambda x: _clamp(F.round(x.cast("double") / p), -levels if low is None else low, levels).cast("smallint"))
        return F.struct(q.alias("q"), p.alias("scale"), F.lit(0).alias("zero_point"))

    return let(scale, apply)


def i8(a: Column) -> Column:
    return symmetric(a, 127)


def i4(a: Column) -> Column:
    """Four bits, two to a byte: the even place in the high half."""
    return let(symmetric(a, 7, -8), lambda s: F.struct(pack_i4(s["q"]).alias("packed"), s["scale"].alias("scale"), F.size(a).alias("n")))


def pack_i4(q: Column) -> Column:
    def byte(i: Column) -> Column:
        high, low = F.get(q, 2 * i), F.coalesce(F.get(q, 2 * i + 1), F.lit(0).cast("smallint"))
        return (F.shiftleft(high.cast("int").bitwiseAND(15), 4) + low.cast("int").bitwiseAND(15)).cast("smallint")

    n = F.ceil(F.size(q) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<smallint>"))


def unpack_i4(packed: Column, scale: Column, n: Column) -> Column:
    """The numbers of packed four-bit integers."""

    def value(i: Column) -> Column:
        b = F.get(packed, F.floor(i / 2).cast("int")).cast("int")
        half = F.when(i % 2 == 0, F.shiftright(b, 4)).otherwise(b.bitwiseAND(15))
        return F.when(half > 7, half - 16).otherwise(half) * scale

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<double>"))


def restore(q: Column, scale: Column, zero_point: Column) -> Column:
    """The numbers of quantised ones."""
    return F.transform(q, lambda x: (x - zero_point) * scale)
