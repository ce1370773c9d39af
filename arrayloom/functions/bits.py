"""Bit vectors as arrays of 64-bit words, lowest bit first: bit i is bit i % 64 of word i / 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def zeros(n_bits: int) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), n_bits // WORD)


def ones(n_bits: int) -> Column:
    return F.array_repeat(F.lit(-1).cast("bigint"), n_bits // WORD)


def is_zero(w: Column) -> Column:
    return F.forall(w, lambda x: x == 0)


def xor(a: Column, b: Column) -> Column:
    """Binding: its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


bind = xor


def conj(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def disj(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def invert(a: Column) -> Column:
    return F.transform(a, lambda x: F.bitwise_not(x))


def popcount(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.bit_count(x))


def hamming(a: Column, b: Column, n_words: int | None = None) -> Column:
    """Differing bits of two bit vectors of equal size; a known size of few words stays inside generated code."""
    if n_words is not None and n_words <= 16:
        return hamming_words([F.get(a, i) for i in range(n_words)], [F.get(b, i) for i in range(n_words)]).cast("bigint")
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def hamming_words(a: list[Column], b: list[Column]) -> Column:
    """The same over word columns: stays inside generated code."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / (F.size(a) * WORD)


def permute(a: Column, k: int, n_words: int) -> Column:
    """Rotate towards higher bits by k places, around the end."""
    k %= n_words * WORD
    q, r = divmod(k, WORD)

    def word(i: Column) -> Column:
        high = F.get(a, (i - q + n_words) % n_words)
        if not r:
            return high
        low = F.get(a, (i - q - 1 + 2 * n_words) % n_words)
        return F.shiftleft(high, r).bitwiseOR(F.shiftrightunsigned(low, WORD - r))

    return F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), word)


def pack(flags: Column, n_words: int) -> Column:
    """Words from an array of booleans, 64 for each word."""

    def word(i: Column) -> Column:
        own = F.slice(flags, i * WORD + 1, WORD)
        return F.aggregate(F.transform(own, lambda f, j: F.when(f, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    return F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), word)


def sign_words(v: Column, size: int) -> Column:
    """The sign fingerprint of an array of numbers: a bit is set where the element is 0 or more."""
    return pack(F.transform(v, lambda x: x >= 0), -(-size // WORD))


def bit(a: Column, i: Column) -> Column:
    """Bit i as 0 or 1."""
    return F.getbit(F.get(a, F.floor(i / WORD).cast("int")), (i % WORD).cast("int"))


def from_bytes(data: Column, n_words: int) -> Column:
    """Words from little-endian bytes; bytes beyond are ignored, missing ones are zero."""
    padded = F.rpad(F.hex(data), 16 * n_words, "0")

    def word(i: Column) -> Column:
        def byte(j: int) -> Column:
            return F.conv(F.substring(padded, i * 16 + 2 * j + 1, F.lit(2)), 16, 10).cast("bigint")

        out = byte(0)
        for j in range(1, 8):
            out = out.bitwiseOR(F.shiftleft(byte(j), 8 * j))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), word)


def to_bytes(words: Column) -> Column:
    """Little-endian bytes of words."""

    def text(w: Column) -> Column:
        every = [F.lpad(F.hex(F.shiftrightunsigned(w, 8 * j).bitwiseAND(255)), 2, "0") for j in range(8)]
        return F.concat(*every)

    return F.unhex(F.array_join(F.transform(words, text), ""))


def signed_byte(b: Column) -> Column:
    """A byte 0..255 as two's complement."""
    return F.when(b > 127, b - 256).otherwise(b)


def dot_i8(a: Column, b: Column) -> Column:
    """Inner product of two arrays of bytes 0..255 read as signed."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: signed_byte(x).cast("bigint") * signed_byte(y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def norm_sq_i8(a: Column) -> Column:
    return dot_i8(a, a)


def cosine_i8(a: Column, b: Column) -> Column:
    """Cosine of signed bytes, 0 where a norm is 0."""
    norms = F.sqrt(norm_sq_i8(a).cast("double")) * F.sqrt(norm_sq_i8(b).cast("double"))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot_i8(a, b).cast("double"), norms))


def or_mask_lower_bound(query: Column, mask: Column) -> Column:
    """Bits of a query outside a mask: no vector under the mask can be closer."""
    return F.aggregate(F.zip_with(query, mask, lambda q, m: F.bit_count(q.bitwiseAND(F.bitwise_not(m)))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def xor_diff(centre: Column, point: Column) -> Column:
    """Differing bytes of a point as (pos, val); val is the exclusive or."""
    both = F.zip_with(centre, point, lambda c, p: c.bitwiseXOR(p))
    every = F.transform(both, lambda x, i: F.struct(i.alias("pos"), x.cast("smallint").alias("val")))
    return F.filter(every, lambda d: d["val"] != 0)


def xor_apply(centre: Column, diffs: Column) -> Column:
    """The point again."""
    at = F.map_from_entries(diffs)
    return F.transform(centre, lambda c, i: c.bitwiseXOR(F.coalesce(at[i], F.lit(0).cast("smallint"))))


def xor_cost(diffs: Column) -> Column:
    """Bytes to store differences: two for a place, one for a value."""
    return F.size(diffs) * 3


def hamming_from_diffs(query: Column, centre: Column, diffs: Column, to_centre: Column) -> Column:
    """Hamming distance of a query to a point known by its differences, from the distance to its centre."""
    change = F.aggregate(
        diffs,
        F.lit(0).cast("bigint"),
        lambda s, d: s + F.bit_count(F.get(query, d["pos"]).bitwiseXOR(F.get(centre, d["pos"])).bitwiseXOR(d["val"])) - F.bit_count(F.get(query, d["pos"]).bitwiseXOR(F.get(centre, d["pos"]))),
    )
    return to_centre + change
