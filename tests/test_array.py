import numpy as np
import pytest

from arrayloom.array import SparkArray, arange, linspace, ones, zeros


def test_arithmetic_and_reductions(spark):
    m = np.arange(24.0).reshape(2, 3, 4) - 7
    a = SparkArray.of(spark, m.tolist())
    assert a.shape == [2, 3, 4] and len(a) == 24 and a.tolist() == m.tolist()
    assert ((a + a) * 2 - 1).tolist() == (m * 4 - 1).tolist() and (a / 2).tolist() == (m / 2).tolist()
    for axis in (0, 1, 2, (0, 2)):
        for name, f in (("mean", np.mean), ("median", np.median), ("var", np.var), ("std", np.std), ("min", np.min), ("max", np.max)):
            assert np.array(getattr(a, name)(axis).tolist()) == pytest.approx(f(m, axis=axis)), (name, axis)
    assert np.array(a.norm(1, 1, True).tolist()) == pytest.approx(np.abs(m).sum(axis=1, keepdims=True))
    assert (a.mean(), a.norm(2), a.argmin(), a.argmax()) == (m.mean(), pytest.approx(np.linalg.norm(m)), 0, 23)
    assert a.percentile(30) == pytest.approx(np.percentile(m, 30)) and a.top_k(2) == ([23, 22], [16.0, 15.0])
    assert np.array(a.cumsum().tolist()) == pytest.approx(m.cumsum().reshape(2, 3, 4))
    assert (a * -1).sort().tolist() == sorted((-m).ravel().tolist())
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    assert np.array(a.softmax().tolist()) == pytest.approx(e / e.sum(axis=-1, keepdims=True))
    assert np.array(a.sigmoid().exp().log().tolist()) == pytest.approx(1 / (1 + np.exp(-m)))
    with pytest.raises(ValueError):
        a + SparkArray.of(spark, [1.0])


def test_shapes_and_products(spark):
    m, n = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    a, b = SparkArray.of(spark, m.tolist()), SparkArray.of(spark, n.tolist())
    assert (a @ b).tolist() == (m @ n).tolist() and (a @ SparkArray.of(spark, [1.0, 2.0, 3.0])).tolist() == [8, 26]
    assert SparkArray.of(spark, [1.0, 2, 3, 4]).dot(SparkArray.of(spark, [4.0, 3, 2, 1])) == 20
    assert a.transpose().tolist() == m.T.tolist() and a.flip((0, 1)).tolist() == m[::-1, ::-1].tolist()
    assert b[1:, 2].tolist() == n[1:, 2].tolist() and b[-1].tolist() == n[-1].tolist() and b.reshape([4, 3]).tolist() == n.reshape(4, 3).tolist()
    assert SparkArray.concatenate([a, a], 1).tolist() == np.concatenate([m, m], 1).tolist()
    assert a.slice(1, 0, 1).squeeze().shape == [2] and a[0, 0].item() == 0 and a.cosine_similarity(a) == pytest.approx(1)
    assert zeros(spark, [2, 2]).tolist() == [[0, 0], [0, 0]] and ones(spark, [1]).item() == 1
    assert arange(spark, 0, 1, 0.25).tolist() == [0, 0.25, 0.5, 0.75] and linspace(spark, 0, 1, 3).tolist() == [0, 0.5, 1]


def test_bytes(spark):
    u = lambda v: SparkArray.of(spark, v, "uint8")
    a, b = u([0b10101010, 1, 255]), u([0b11001100, 255, 255])
    assert (a + 250).tolist() == [(170 + 250) % 256, 251, 249] and (a ^ b).tolist() == [170 ^ 204, 254, 0] and (~a).tolist() == [85, 254, 0]
    assert (a & 15).tolist() == [10, 1, 15] and (a | b).tolist() == [170 | 204, 255, 255]
    assert a.hamming_distance(b) == 4 + 7 and a.hamming_distance_adaptive(b, 3) is None and a.popcount() == 4 + 1 + 8
    assert u([0x80] + [0] * 15).permute(1).tolist() == [0, 1] + [0] * 14 and a.permute(5).permute(19).tolist() == a.tolist()
    assert SparkArray.bundle([u([0b10101010]), u([0b11001100]), u([0b11110000])]).tolist() == [0b11101000]
    assert u([255, 254, 1, 2]).dot_i8(u([255, 254, 1, 2])) == 10 and u([1] * 4).cosine_i8(u([255] * 4)) == -1
    i = SparkArray.of(spark, [2**31 - 1, -5], "int32")
    assert (i + 1).tolist() == [-(2**31), -4] and (i / 2).tolist() == [(2**31 - 1) // 2, -2]
