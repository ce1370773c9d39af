"""Linear algebra. Products are joins and sums over coordinates (i, j, x); dense small systems are solved with numpy in
one task for each system, in parallel over systems or right-hand sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bf16 import from_float_rounded, to_float
from ..functions.quant import i8
from ..shipping import ship
from .layout import swapped


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, x) times (k, j, x): (i, j, x)."""
    left, right = a.select("i", "k", F.col("x").alias("xa")), b.select("k", "j", F.col("x").alias("xb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


def matvec(a: DataFrame, v: DataFrame) -> DataFrame:
    """(i, k, x) times (k, x): (i, x)."""
    return a.select("i", "k", F.col("x").alias("xa")).join(v.select("k", F.col("x").alias("xb")), "k").groupBy("i").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product or matrix-vector product, by whether the right side has a column j."""
    return matmul(a, b) if "j" in b.columns else matvec(a, b)


def transposed(a: DataFrame, trans: bool, row: str = "i", col: str = "k") -> DataFrame:
    return swapped(a, row, col) if trans else a


def _combine(product: DataFrame, c: DataFrame | None, alpha: float, beta: float, keys: list[str]) -> DataFrame:
    """alpha * product + beta * c over the places of either."""
    p = product.withColumn("x", F.lit(alpha) * F.col("x"))
    if c is None or beta == 0:
        return p
    old = c.select(*keys, (F.lit(beta) * F.col("x")).alias("x"))
    return p.select(*keys, "x").unionByName(old).groupBy(*keys).agg(F.sum("x").alias("x"))


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, *, alpha: float = 1.0, beta: float = 0.0, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """alpha * op(a) op(b) + beta * c."""
    return _combine(matmul(transposed(a, trans_a), transposed(b, trans_b, "k", "j")), c, alpha, beta, ["i", "j"])


def gemv(a: DataFrame, v: DataFrame, y: DataFrame | None = None, *, alpha: float = 1.0, beta: float = 0.0, trans: bool = False) -> DataFrame:
    return _combine(matvec(transposed(a, trans), v), y, alpha, beta, ["i"])


def ger(x: DataFrame, y: DataFrame, a: DataFrame | None = None, *, alpha: float = 1.0) -> DataFrame:
    """a + alpha * x y': every place of the result has one term, so its size is the output's."""
    outer = x.select("i", F.col("x").alias("xa")).crossJoin(y.select("j", F.col("x").alias("xb"))).select("i", "j", (F.col("xa") * F.col("xb")).alias("x"))
    return _combine(outer, a, alpha, 1.0, ["i", "j"])


def mirrored(a: DataFrame, upper: bool = True, row: str = "i", col: str = "k") -> DataFrame:
    """A symmetric matrix from one of its triangles."""
    own = a.where(F.col(row) <= F.col(col) if upper else F.col(row) >= F.col(col))
    return own.unionByName(swapped(own.where(F.col(row) != F.col(col)), row, col))


def symv(a: DataFrame, v: DataFrame, y: DataFrame | None = None, *, upper: bool = True, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    return gemv(mirrored(a, upper), v, y, alpha=alpha, beta=beta)


def symm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, *, upper: bool = True, left: bool = True, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """a b, or b a, for a symmetric from one triangle: a is (i, k, x); b is (k, j, x), or (i, k, x) on the left."""
    full = mirrored(a, upper)
    return gemm(full, b, c, alpha=alpha, beta=beta) if left else gemm(b, full.select(F.col("i").alias("k"), F.col("k").alias("j"), "x"), c, alpha=alpha, beta=beta)


def syrk(a: DataFrame, c: DataFrame | None = None, *, alpha: float = 1.0, beta: float = 0.0, trans: bool = False, upper: bool = False) -> DataFrame:
    """One triangle of alpha * a a' + beta * c (or a' a)."""
    own = transposed(a, trans)
    l, r = own.select("i", "k", F.col("x").alias("xa")), own.select(F.col("i").alias("j"), "k", F.col("x").alias("xb"))
    keep = F.col("i") <= F.col("j") if upper else F.col("i") >= F.col("j")
    product = l.join(r, "k").where(keep).groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))
    return _combine(product, None if c is None else c.where(keep), alpha, beta, ["i", "j"])


def gram(rows: DataFrame, by: str | None = None, vector: str = "v") -> DataFrame:
    """([by,] i, j, x, n): sums of products of the places of all vectors (of each group), and how many vectors they cover.
    A task multiplies blocks of rows and sends one matrix for each group, so d * d numbers for it are shuffled, not
    for each vector."""
    from .search import matrix

    ship(rows.sparkSession)
    kind = rows.schema[by].dataType.simpleString() if by else "int"
    own = rows.where(F.col(vector).isNotNull()).select((F.col(by) if by else F.lit(0)).alias("g"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            v = matrix(batch.column(1))
            keys = batch.column(0).dictionary_encode()
            code = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            for c in np.unique(code).tolist():
                some = v[code == c]
                key = keys.dictionary[c].as_py() if c < len(keys.dictionary) else None
                old = held.get(key)
                held[key] = (some.T @ some, len(some)) if old is None else (old[0] + some.T @ some, old[1] + len(some))
            if len(held) * v.shape[1] ** 2 > 4_000_000:  # a task's memory does not grow with the number of groups
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        for key, (m, n) in held.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array([key] * m.size, pa.from_numpy_dtype(np.int64) if kind in ("int", "bigint") else None), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel()), pa.array(np.full(m.size, n))], ["g", "i", "j", "x", "n"])

    parts = own.withColumn("g", F.col("g").cast("bigint") if kind in ("int", "bigint") else F.col("g")).mapInArrow(run, f"g {'bigint' if kind in ('int', 'bigint') else kind}, i bigint, j bigint, x double, n bigint")
    sums = parts.groupBy("g", "i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.withColumnRenamed("g", by) if by else sums.drop("g")


def trmv(a: DataFrame, v: DataFrame, *, upper: bool = True, trans: bool = False, unit: bool = False) -> DataFrame:
    """A triangle times a vector."""
    own = a.where(F.col("i") <= F.col("k") if upper else F.col("i") >= F.col("k"))
    if unit:
        own = own.withColumn("x", F.when(F.col("i") == F.col("k"), F.lit(1.0)).otherwise(F.col("x")))
    return matvec(transposed(own, trans), v)


def dense(a: DataFrame, n: int, row: str = "i", col: str = "k") -> np.ndarray:
    """A small matrix on the driver: n is its stated size, and more places than n * n are an error."""
    rows = a.select(row, col, "x").limit(n * n + 1).collect()
    if len(rows) > n * n:
        raise ValueError("the matrix has more places than its stated size")
    out = np.zeros((n, n))
    for i, k, x in rows:
        out[i, k] = x
    return out


def _triangle(a: np.ndarray, upper: bool, trans: bool, unit: bool) -> np.ndarray:
    t = np.triu(a) if upper else np.tril(a)
    if unit:
        np.fill_diagonal(t, 1.0)
    return t.T if trans else t


def trsm(a: DataFrame, n: int, b: DataFrame, *, upper: bool = True, trans: bool = False, unit: bool = False, alpha: float = 1.0, left: bool = True) -> DataFrame:
    """Solve op(a) X = alpha * b for each column j of b (k, j, x), or X op(a) = alpha * b for each row j. Right-hand
    sides are solved in parallel; a's n * n numbers go to each."""
    t = _triangle(dense(a, n), upper, trans, unit)
    t = t if left else t.T
    ship(b.sparkSession)
    row, col = "k", "j"
    lower = np.allclose(t, np.tril(t))

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(n)
        y[part[row].to_numpy()] = alpha * part["x"].to_numpy()
        x = np.zeros(n)
        for i in range(n) if lower else range(n - 1, -1, -1):
            x[i] = (y[i] - t[i] @ x) / t[i, i]
        return pd.DataFrame({row: np.arange(n), col: key[0], "x": x})

    return b.groupBy(col).applyInPandas(solve, f"{row} bigint, {col} bigint, x double")


def trsv(a: DataFrame, n: int, b: DataFrame, **how) -> DataFrame:
    """One right-hand side (k, x)."""
    return trsm(a, n, b.withColumn("j", F.lit(0).cast("bigint")), **how).select("k", "x")


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """LU with partial pivoting in one array, pivots from 0, and where the first zero pivot was (from 1), or 0."""
    a, n, info = a.astype(float).copy(), len(a), 0
    pivots = np.arange(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        pivots[k] = p
        if a[p, k] == 0:
            info = info or k + 1
            continue
        a[[k, p]] = a[[p, k]]
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, pivots, info


def lu_solve(factor: np.ndarray, pivots: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.array(b, float)
    for k, p in enumerate(pivots):
        x[[k, p]] = x[[p, k]]
    n = len(factor)
    for i in range(n):
        x[i] -= factor[i, :i] @ x[:i]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - factor[i, i + 1 :] @ x[i + 1 :]) / factor[i, i]
    return x


def cholesky(a: np.ndarray) -> tuple[np.ndarray, int]:
    """The lower factor, and the first column (from 1) where the matrix isn't positive definite, or 0."""
    n = len(a)
    out = np.zeros((n, n))
    for j in range(n):
        d = a[j, j] - out[j, :j] @ out[j, :j]
        if d <= 0:
            return out, j + 1
        out[j, j] = d**0.5
        out[j + 1 :, j] = (a[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out, 0


def cholesky_solve(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = np.array(b, float)
    for i in range(len(factor)):
        y[i] = (y[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    for i in range(len(factor) - 1, -1, -1):
        y[i] = (y[i] - factor[i + 1 :, i] @ y[i + 1 :]) / factor[i, i]
    return y


def householder_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R on and above the diagonal, reflectors below it (their first element is 1), and their factors tau."""
    a, (m, n) = a.astype(float).copy(), a.shape
    tau = np.zeros(min(m, n))
    for k in range(min(m, n)):
        x = a[k:, k]
        size = np.sqrt(x @ x)
        if size == 0:
            continue
        r = -size if x[0] >= 0 else size
        v = x.copy()
        v[0] -= r
        first = v[0]
        v = v / first if first else v
        tau[k] = -first / r
        a[k:, k:] -= tau[k] * np.outer(v, v @ a[k:, k:])
        a[k, k], a[k + 1 :, k] = r, v[1:]
    return a, tau


def per_matrix(df: DataFrame, n: int, kind: str) -> DataFrame:
    """Factor each small matrix of (m, i, k, x) in a task of its own: kind is lu, cholesky or qr. Gives (m, i, k, x) and
    info."""

    ship(df.sparkSession)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n))
        a[part["i"].to_numpy(), part["k"].to_numpy()] = part["x"].to_numpy()
        if kind == "lu":
            out, _, info = lu(a)
        elif kind == "cholesky":
            out, info = cholesky(a)
        else:
            out, info = householder_qr(a)[0], 0
        i, k = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        return pd.DataFrame({"m": key[0], "i": i.ravel(), "k": k.ravel(), "x": out.ravel(), "info": info})

    return df.groupBy("m").applyInPandas(run, "m bigint, i bigint, k bigint, x double, info int")


def rebuilt(factors: DataFrame, n: int, kind: str) -> DataFrame:
    """The matrices that factors of ``per_matrix`` stand for, (m, i, k, x): the product of LU's triangles (rows in the order
    of the pivots), L L' of Cholesky, or R' R of QR, which is A' A."""
    low = factors.where(F.col("k") < F.col("i")) if kind == "lu" else factors.where(F.col("k") <= F.col("i"))
    up = factors.where(F.col("k") >= F.col("i"))
    if kind == "lu":
        units = factors.where(F.col("i") == F.col("k")).withColumn("x", F.lit(1.0))
        left, right = low.unionByName(units).select("m", "i", F.col("k").alias("c"), F.col("x").alias("a")), up.select("m", F.col("i").alias("c"), "k", F.col("x").alias("b"))
    elif kind == "cholesky":
        left, right = low.select("m", "i", F.col("k").alias("c"), F.col("x").alias("a")), low.select("m", F.col("i").alias("k"), F.col("k").alias("c"), F.col("x").alias("b"))
    else:
        left, right = up.select("m", F.col("i").alias("c"), F.col("k").alias("i"), F.col("x").alias("a")), up.select("m", F.col("i").alias("c"), "k", F.col("x").alias("b"))
    return left.join(right, ["m", "c"]).groupBy("m", "i", "k").agg(F.sum(F.col("a") * F.col("b")).alias("x"))


def solve_systems(a: DataFrame, b: DataFrame, n: int, kind: str = "lu") -> DataFrame:
    """Solve each system of (m, i, k, x) for its right side (m, i, x)."""
    ship(a.sparkSession)
    both = a.withColumn("side", F.lit(False)).unionByName(b.withColumn("k", F.lit(0).cast("bigint")).withColumn("side", F.lit(True)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[~part["side"]], part[part["side"]]
        m, y = np.zeros((n, n)), np.zeros(n)
        m[left["i"].to_numpy(), left["k"].to_numpy()] = left["x"].to_numpy()
        y[right["i"].to_numpy()] = right["x"].to_numpy()
        if kind == "lu":
            factor, pivots, info = lu(m)
            x = lu_solve(factor, pivots, y) if not info else np.full(n, np.nan)
        else:
            factor, info = cholesky(m)
            x = cholesky_solve(factor, y) if not info else np.full(n, np.nan)
        return pd.DataFrame({"m": key[0], "i": np.arange(n), "x": x})

    return both.groupBy("m").applyInPandas(run, "m bigint, i bigint, x double")


def dft(df: DataFrame, n: int, series: str = "s", *, inverse: bool = False, half: bool = False) -> DataFrame:
    """Discrete Fourier transform of each series (series, t, re[, im]) of n places, by a join with the n * n twiddles:
    (series, f, re, im); the inverse is divided by n; ``half`` keeps f <= n / 2."""
    spark = df.sparkSession
    freq = spark.range(n // 2 + 1 if half else n).select(F.col("id").alias("f"))
    im = F.col("im") if "im" in df.columns else F.lit(0.0)
    angle = (2 if inverse else -2) * np.pi / n * ((F.col("t") * F.col("f")) % n)
    both = df.select(series, "t", "re", im.alias("im")).crossJoin(F.broadcast(freq)).withColumn("c", F.cos(angle)).withColumn("d", F.sin(angle))
    by = F.lit(1.0 / n if inverse else 1.0)
    return both.groupBy(series, "f").agg((by * F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("d"))).alias("re"), (by * F.sum(F.col("re") * F.col("d") + F.col("im") * F.col("c"))).alias("im"))


def fft(df: DataFrame, n: int, series: str = "s", *, inverse: bool = False, half: bool = False) -> DataFrame:
    """The same by a fast transform of each whole series: n must be a power of two."""
    if n & (n - 1) or n < 1:
        raise ValueError("n must be a power of two")
    kind = df.schema[series].dataType.simpleString()
    imag = "im" in df.columns
    ship(df.sparkSession)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(n, complex)
        z[part["t"].to_numpy()] = part["re"].to_numpy() + (1j * part["im"].to_numpy() if imag else 0)
        out = np.fft.ifft(z) if inverse else np.fft.fft(z)
        out = out[: n // 2 + 1] if half else out
        return pd.DataFrame({series: key[0], "f": np.arange(len(out)), "re": out.real, "im": out.imag})

    return df.groupBy(series).applyInPandas(run, f"{series} {kind}, f bigint, re double, im double")


def int_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Integer product, exact in 64 bits."""
    left, right = a.select("i", "k", F.col("q").cast("bigint").alias("qa")), b.select("k", "j", F.col("q").cast("bigint").alias("qb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("qa") * F.col("qb")).alias("acc"))


def int_matmul_float(a: DataFrame, b: DataFrame, scale_a: float, zero_point_a: int, scale_b: Column) -> DataFrame:
    """Integer product with the zero point of a taken out, scaled; ``scale_b`` may be a column of b, for scales by j."""
    left = a.select("i", "k", F.col("q").cast("bigint").alias("qa"))
    right = b.select("k", "j", F.col("q").cast("bigint").alias("qb"), scale_b.alias("sb"))
    sums = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("qa") * F.col("qb")).alias("acc"), F.sum("qb").alias("colsum"), F.first("sb").alias("sb"))
    return sums.select("i", "j", (F.lit(scale_a) * F.col("sb") * (F.col("acc") - F.lit(zero_point_a) * F.col("colsum"))).alias("x"))


def bf16_gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, *, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """The product of operands rounded to BF16, summed in double precision."""
    low = lambda m: m.withColumn("x", to_float(from_float_rounded(F.col("x"))))
    return gemm(low(a), low(b), c, alpha=alpha, beta=beta)


def pruned_rows(rows: DataFrame, fraction: float) -> DataFrame:
    """(i, v): rows whose approximate norm reaches the one at place floor(m * fraction) of all norms in order."""
    from .reduce import approx_row_norm

    norms = rows.withColumn("norm", approx_row_norm(F.col("v")))
    m = rows.count()
    at = min(m - 1, int(m * fraction))
    # the norm at a place, by an exact percentile: place / (m - 1) of the way needs no interpolation
    low = norms.agg(F.percentile("norm", F.lit(at / (m - 1) if m > 1 else 0.0)).alias("low"))
    return norms.crossJoin(F.broadcast(low)).where(F.col("norm") >= F.col("low") - 1e-12).drop("low")


def quantised_rows(rows: DataFrame) -> DataFrame:
    """(i, v) as (i, k, q, scale) in symmetric 8-bit integers for each row."""
    s = rows.select("i", i8(F.col("v")).alias("s"))
    return s.select("i", F.posexplode("s.q").alias("k", "q"), F.col("s.scale").alias("scale"))


def block_product(a: DataFrame, b: DataFrame, n_b: int) -> DataFrame:
    """Rows (i, v) times a small dense matrix b (k, j, x) of n_b columns, rows in batches: for tall a. b's numbers go to
    every task, so b must be small: more than 16 million places are an error."""
    d = b.agg(F.max("k")).first()[0] + 1
    if d * n_b > 16_000_000:
        raise ValueError("b is too large to send to every task")
    m = np.zeros((d, n_b))
    ship(a.sparkSession)
    for k, j, x in b.select("k", "j", "x").collect():
        m[k, j] = x

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                out = np.stack(part["v"].to_numpy()) @ m
                yield pd.DataFrame({"i": part["i"], "v": list(out)})

    return a.select("i", "v").mapInPandas(run, "i bigint, v array<double>")
