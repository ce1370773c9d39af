import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.functions import bf16, bits, elementwise, quant, symbols


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def arr(values, kind="bigint"):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def words(data: bytes) -> list[int]:
    return np.frombuffer(data.ljust(-(-len(data) // 8) * 8, b"\0"), np.int64).tolist()


def test_permute_moves_bits_over_bytes(spark):
    first = words(bytes([0x80] + [0] * 15))
    whole = words(bytes([0xFF] + [0] * 15))
    r = one(spark, bits.permute(arr(first), 1, 2), bits.permute(arr(whole), 8, 2), bits.permute(bits.permute(arr(first), 77, 2), 128 - 77, 2))
    assert r[0] == words(bytes([0, 1] + [0] * 14)) and r[1] == words(bytes([0, 0xFF] + [0] * 14)) and r[2] == first


def test_hamming_popcount_and_logic(spark):
    a, b = arr([-1]), arr([0])
    r = one(spark, bits.hamming(a, b), bits.popcount(a), bits.similarity(a, b), bits.invert(a), bits.is_zero(b), bits.or_mask_lower_bound(a, arr([15])))
    assert tuple(r) == (64, 64, 0.0, [0], True, 60)


def test_bytes_round_trip(spark):
    raw = bytes(range(16))
    r = one(spark, bits.to_bytes(bits.from_bytes(F.lit(raw), 2)), bits.from_bytes(F.lit(raw), 1), bits.from_bytes(F.lit(b"\x01"), 2))
    assert bytes(r[0]) == raw and r[1] == words(raw)[:1] and r[2] == [1, 0]


def test_signed_bytes(spark):
    a = arr([255, 254, 1, 2], "int")
    r = one(spark, bits.dot_i8(a, a), bits.norm_sq_i8(arr([3, 4], "int")), bits.cosine_i8(arr([1] * 4, "int"), arr([255] * 4, "int")), bits.dot_i8(arr([127] * 1024, "int"), arr([127] * 1024, "int")), bits.cosine_i8(arr([0], "int"), arr([1], "int")))
    assert tuple(r) == (10, 25, -1.0, 16516096, 0.0)


def test_differences_to_a_centre(spark):
    c, p, q = arr([1, 2, 255], "smallint"), arr([1, 3, 0], "smallint"), arr([9, 2, 7], "smallint")
    d = bits.xor_diff(c, p)
    r = one(spark, bits.xor_apply(c, d), bits.xor_cost(d), bits.hamming_from_diffs(q, c, d, F.lit(6).cast("bigint")))
    assert r[0] == [1, 3, 0] and r[1] == 6
    assert r[2] == 6 + sum((x ^ y).bit_count() - (x ^ z).bit_count() for x, y, z in zip([9, 2, 7], [1, 3, 0], [1, 2, 255]))


def test_bf16_patterns_match_the_upper_half_of_floats(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 1, 50) * 10.0 ** rng.integers(-30, 30, 50), [0.0, 1.0, -2.0, 0.5, 1.9]]).astype(np.float32)
    want = (x.view(np.uint32) >> 16).astype(int).tolist()
    near = [int((int(v) + 0x7FFF + ((int(v) >> 16) & 1)) >> 16) for v in x.view(np.uint32)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    rows = df.select("i", bf16.from_float(F.col("x")), bf16.from_float_rounded(F.col("x")), bf16.to_float(bf16.from_float(F.col("x")))).orderBy("i").collect()
    assert [r[1] for r in rows] == want and [r[2] for r in rows] == near
    assert [r[3] for r in rows] == pytest.approx((np.array(want, np.uint32) << 16).view(np.float32).tolist())


def test_bf16_distance_and_difference(spark):
    diff = bf16.structural_diff(F.transform(arr([1, 2, 3, 4], "double"), bf16.from_float), F.transform(arr([1, -2, 3, -4], "double"), bf16.from_float))
    r = one(spark, bf16.distance(arr([0, 0], "int"), arr([65535, 65535], "int")), diff, bf16.interpretation(diff))
    assert r[0] == 782 and r[1]["sign_flips"] == 2 and r[1]["sign_dims"] == [1, 3] and r[2] == "semantic_reversal"
    with pytest.raises(ValueError):
        bf16.Weights(4096, 4096, 4096)


def test_quantisation(spark):
    a = arr([0, 0.5, 1, -0.5, -1], "double")
    for s in (quant.u8(a), quant.i8(a)):
        r = one(spark, quant.restore(s["q"], s["scale"], s["zero_point"]))
        assert r[0] == pytest.approx([0, 0.5, 1, -0.5, -1], abs=0.02)
    s, high = quant.i4(a), quant.u8(arr([100, 200], "double"))
    r = one(spark, quant.unpack_i4(s["packed"], s["scale"], s["n"]), high["q"], quant.i8(arr([0, 0], "double"))["scale"])
    assert r[0] == pytest.approx([0, 0.5, 1, -0.5, -1], abs=0.15) and r[1] == [255, 255] and r[2] == 1.0


def test_symbols(spark):
    u5, s5, s7 = symbols.Base("unsigned", 5), symbols.Base("signed", 5), symbols.Base("signed", 7)
    r = one(
        spark, symbols.bind(arr([0, 1, 1, 0]), arr([1, 1, 0, 0]), symbols.BINARY), symbols.bind(arr([2, 3, 4]), arr([4, 3, 2]), u5), symbols.bind(arr([2, -2, 1]), arr([2, -2, 0]), s5),
        symbols.unbind(symbols.bind(arr([3]), arr([2]), s7), arr([2]), s7), symbols.distance(arr([1, 2, 3]), arr([1, 0, 3])), symbols.bind_deep([arr([1]), arr([2]), arr([4])], u5),
    )
    assert tuple(r) == ([1, 0, 1, 0], [1, 1, 1], [2, -2, 1], [1], 1, [2])
    assert (u5.cardinality, s5.low, s5.high, s7.name, symbols.BINARY.storage_bytes(9)) == (5, -2, 2, "Signed(7)", 2)


def test_elementwise(spark):
    v = arr([1.0, 2.0, 3.0], "double")
    r = one(
        spark, elementwise.divide(1, 0), elementwise.divide(-1, 0), elementwise.wrapping("+", F.lit(250), 10, "u8"), elementwise.wrapping("*", F.lit(2**31 - 1), 2, "i32"), elementwise.wrapping("-", F.lit(-(2**63)), 1, "i64"),
        elementwise.wrapping("/", F.lit(-7), 2, "i32"), elementwise.softmax(v), elementwise.axpy(2.0, v, v), elementwise.iamax(arr([1, -3, 3], "double")), elementwise.int_sqrt(F.lit(10)), elementwise.strided(v, 2, 2), elementwise.dot(v, v),
        elementwise.log_softmax(v), elementwise.cosine(v, arr([0, 0, 0], "double")), elementwise.log(F.lit(-1.0)),
    )
    assert r[0] == float("inf") and r[1] == float("-inf") and r[2] == 4 and r[3] == -2 and r[4] == 2**63 - 1 and r[5] == -3
    e = np.exp([1, 2, 3])
    assert r[6] == pytest.approx((e / e.sum()).tolist()) and r[7] == [3, 6, 9] and r[8] == 1 and r[9] == 3 and r[10] == [1, 3] and r[11] == 14
    assert r[12] == pytest.approx(np.log(e / e.sum()).tolist()) and r[13] == 0 and r[14] is None
    with pytest.raises(Exception, match="equal sizes"):
        one(spark, elementwise.add(v, arr([1.0], "double"), True))
    with pytest.raises(Exception, match="not positive"):
        one(spark, elementwise.log(F.lit(0.0), strict=True))
