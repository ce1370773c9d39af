"""An N-dimensional array over a DataFrame: lazy, in long form (i, x) with i the linear place, last axis fastest.

``SparkArray`` has the operators of a dense array type: arithmetic, reductions by axis, reshaping, products and bit
operations. Nothing runs before ``tolist``, ``item`` or one of the methods that give a Python number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import elementwise
from .operators import layout, linalg, ordered

Axis = int | Sequence[int] | None
#: Element types; u8, i32 and i64 wrap around, the others are doubles.
INTEGERS = {"uint8": "u8", "int32": "i32", "int64": "i64"}


def _axes(axis: Axis, n: int) -> list[int]:
    some = range(n) if axis is None else [axis] if isinstance(axis, int) else axis
    return sorted({a % n for a in some}) if n else []


class SparkArray:
    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: str = "float64"):
        self.df, self.shape, self.dtype = df.select(F.col("i").cast("bigint").alias("i"), "x"), list(shape), dtype

    # Making and reading

    @classmethod
    def of(cls, spark: SparkSession, data: Sequence, dtype: str = "float64") -> SparkArray:
        """From nested Python lists."""
        shape, flat = [], data
        while isinstance(flat, (list, tuple)):
            shape.append(len(flat))
            flat = flat[0] if len(flat) else None

        def walk(x):
            if isinstance(x, (list, tuple)):
                for y in x:
                    yield from walk(y)
            else:
                yield x

        kind, cast = ("bigint", int) if dtype in INTEGERS else ("double", float)
        values = [(i, cast(v)) for i, v in enumerate(walk(data))]
        if len(values) != prod(shape):
            raise ValueError("rows must have equal lengths")
        return cls(spark.createDataFrame(values, f"i bigint, x {kind}"), shape, dtype)

    def tolist(self) -> list:
        flat = [r.x for r in self.df.orderBy("i").collect()]
        for n in reversed(self.shape[1:]):
            flat = [flat[k : k + n] for k in range(0, len(flat), n)] if n else []
        return flat if self.shape else flat[0]

    def item(self):
        if prod(self.shape) != 1:
            raise ValueError("the array must have one element")
        return self.df.first().x

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def __len__(self) -> int:
        return prod(self.shape)

    def __repr__(self) -> str:
        return f"SparkArray(shape={self.shape}, dtype={self.dtype})"

    def _like(self, df: DataFrame, shape: Sequence[int] | None = None, dtype: str | None = None) -> SparkArray:
        return SparkArray(df, self.shape if shape is None else shape, dtype or self.dtype)

    # Element-wise

    def _beside(self, other: SparkArray) -> DataFrame:
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")
        return self.df.join(other.df.withColumnRenamed("x", "y"), "i")

    def _arith(self, other, op: str, f: Callable[[Column, Column], Column]) -> SparkArray:
        df, y = (self._beside(other), F.col("y")) if isinstance(other, SparkArray) else (self.df, F.lit(other))
        kind = INTEGERS.get(self.dtype)
        x = elementwise.wrapping(op, F.col("x"), y, kind).cast("bigint") if kind else f(F.col("x"), y)
        return self._like(df.select("i", x.alias("x")))

    def __add__(self, other):
        return self._arith(other, "+", lambda a, b: a + b)

    def __sub__(self, other):
        return self._arith(other, "-", lambda a, b: a - b)

    def __mul__(self, other):
        return self._arith(other, "*", lambda a, b: a * b)

    def __truediv__(self, other):
        return self._arith(other, "/", elementwise.divide)

    def _map(self, f: Callable[[Column], Column], dtype: str = "float64") -> SparkArray:
        return self._like(self.df.select("i", f(F.col("x")).alias("x")), dtype=dtype)

    def exp(self) -> SparkArray:
        return self._map(F.exp)

    def log(self) -> SparkArray:
        return self._map(lambda x: elementwise.log(x, strict=True))

    def sigmoid(self) -> SparkArray:
        return self._map(elementwise.sigmoid)

    def _last_axis(self) -> tuple[DataFrame, Column]:
        n = self.shape[-1]
        cut = self.df.withColumn("g", F.floor(F.col("i") / n))
        top = cut.groupBy("g").agg(F.max("x").alias("m"))
        shifted = cut.join(top, "g").withColumn("z", F.col("x") - F.col("m"))
        return shifted.join(shifted.groupBy("g").agg(F.sum(F.exp("z")).alias("s")), "g"), F.col("z")

    def softmax(self) -> SparkArray:
        df, z = self._last_axis()
        return self._like(df.select("i", (F.exp(z) / F.col("s")).alias("x")))

    def log_softmax(self) -> SparkArray:
        df, z = self._last_axis()
        return self._like(df.select("i", (z - F.ln("s")).alias("x")))

    # Reductions

    def _reduce(self, agg: Column, axis: Axis, keepdims: bool = False):
        """A number over everything, or an array without the axes."""
        if axis is None and not keepdims:
            return self.df.agg(agg.alias("x")).first().x
        gone = _axes(axis, self.ndim)
        kept = [a for a in range(self.ndim) if a not in gone]
        cut = layout.with_axes(self.df, self.shape)
        sums = cut.groupBy(*[f"a{a}" for a in kept]).agg(agg.alias("x"))
        place = F.lit(0).cast("bigint")
        for a, s in zip(kept, layout.strides([self.shape[a] for a in kept]), strict=True):
            place = place + F.col(f"a{a}") * s
        shape = [1 if a in gone else n for a, n in enumerate(self.shape)] if keepdims else [self.shape[a] for a in kept]
        return SparkArray(sums.select(place.alias("i"), "x"), shape)

    def mean(self, axis: Axis = None):
        return self._reduce(F.avg("x"), axis)

    def median(self, axis: Axis = None):
        return self._reduce(F.median("x"), axis)

    def var(self, axis: Axis = None):
        return self._reduce(F.coalesce(F.var_pop("x"), F.lit(0.0)), axis)

    def std(self, axis: Axis = None):
        return self._reduce(F.coalesce(F.stddev_pop("x"), F.lit(0.0)), axis)

    def min(self, axis: Axis = None):
        return self._reduce(F.min("x"), axis)

    def max(self, axis: Axis = None):
        return self._reduce(F.max("x"), axis)

    def percentile(self, p: float, axis: Axis = None):
        return self._reduce(F.percentile("x", F.lit(p / 100)), axis)

    def argmin(self) -> int:
        return self.df.agg(F.min_by("i", F.struct("x", "i"))).first()[0]

    def argmax(self) -> int:
        return self.df.agg(F.max_by("i", F.struct(F.col("x"), -F.col("i")))).first()[0]

    def norm(self, p: int = 2, axis: Axis = None, keepdims: bool = False):
        if p not in (1, 2):
            raise ValueError("p must be 1 or 2")
        return self._reduce(F.sum(F.abs("x")) if p == 1 else F.sqrt(F.sum(F.col("x") * F.col("x"))), axis, keepdims)

    def cumsum(self) -> SparkArray:
        from .operators.ordered import cumsum_all

        return self._like(cumsum_all(self.df, "x", "i").select("i", F.col("cumsum").alias("x")))

    def sort(self) -> SparkArray:
        """Ascending, flat. Places are counted within ranges of the elements, so no task sees all rows."""
        own = ordered.ranked(self.df.select(F.col("i").alias("_i"), "x"), "x", "_i")
        return SparkArray(own.select(F.col("place").cast("bigint").alias("i"), "x"), [len(self)], self.dtype)

    def top_k(self, k: int) -> tuple[list[int], list]:
        """Places and values of the k largest, lower places first among equal ones."""
        if k > len(self):
            raise ValueError("k exceeds the size")
        rows = self.df.orderBy(F.desc("x"), "i").limit(k).collect()
        return [r.i for r in rows], [r.x for r in rows]

    # Shape

    def reshape(self, shape: Sequence[int]) -> SparkArray:
        if prod(shape) != prod(self.shape):
            raise ValueError("shapes must have equally many elements")
        return self._like(self.df, shape)

    def _moved(self, shape: Sequence[int], change: Callable[[DataFrame], DataFrame]) -> SparkArray:
        return self._like(layout.from_axes(change(layout.with_axes(self.df, self.shape)), shape), shape)

    def transpose(self) -> SparkArray:
        if self.ndim != 2:
            raise ValueError("two axes are needed")
        return self._moved(self.shape[::-1], lambda df: layout.swapped(df, "a0", "a1"))

    def flip(self, axis: Axis) -> SparkArray:
        def change(df: DataFrame) -> DataFrame:
            for a in _axes(axis, self.ndim):
                df = layout.flip(df, f"a{a}", self.shape[a])
            return df

        return self._moved(self.shape, change)

    def slice(self, axis: int, start: int | None, stop: int | None) -> SparkArray:
        lo, hi, _ = slice(start, stop).indices(self.shape[axis])
        shape = [max(0, hi - lo) if a == axis else n for a, n in enumerate(self.shape)]
        return self._moved(shape, lambda df: layout.slice_axis(df, f"a{axis}", lo, hi))

    def squeeze(self, axes: Sequence[int] | None = None) -> SparkArray:
        return self._like(self.df, layout.squeeze(self.shape, axes))

    def __getitem__(self, key) -> SparkArray:
        """Integers and slices by axis; an axis that an integer names goes."""
        out, gone = self, []
        for a, k in enumerate(key if isinstance(key, tuple) else (key,)):
            if isinstance(k, int):
                k = k % self.shape[a]
                out, gone = out.slice(a, k, k + 1), [*gone, a]
            elif k.step == -1 and k.start is None and k.stop is None:
                out = out.flip(a)
            elif k.step in (None, 1):
                out = out.slice(a, k.start, k.stop)
            else:
                raise ValueError("steps other than 1 and -1 are not offered")
        return out.squeeze(gone) if gone else out

    @staticmethod
    def concatenate(arrays: Sequence[SparkArray], axis: int = 0) -> SparkArray:
        first = arrays[0]
        if any([n for a, n in enumerate(x.shape) if a != axis] != [n for a, n in enumerate(first.shape) if a != axis] for x in arrays):
            raise ValueError("the other axes must agree")
        shape = [sum(x.shape[axis] for x in arrays) if a == axis else n for a, n in enumerate(first.shape)]
        parts = [(layout.with_axes(x.df, x.shape).drop("i"), x.shape[axis]) for x in arrays]
        return first._like(layout.from_axes(layout.concatenate(parts, f"a{axis}"), shape), shape)

    # Products

    def dot(self, other: SparkArray):
        """Inner product of two vectors, else the matrix product."""
        if self.ndim == other.ndim == 1:
            return self._beside(other).agg(F.sum(F.col("x") * F.col("y"))).first()[0]
        return self @ other

    def __matmul__(self, other: SparkArray) -> SparkArray:
        if self.ndim != 2 or other.ndim not in (1, 2) or self.shape[1] != other.shape[0]:
            raise ValueError(f"shapes {self.shape} and {other.shape} do not match")
        n = other.shape[1] if other.ndim == 2 else 1
        a = self.df.select(F.floor(F.col("i") / self.shape[1]).alias("i"), (F.col("i") % self.shape[1]).alias("k"), "x")
        b = other.df.select(F.floor(F.col("i") / n).alias("k"), (F.col("i") % n).alias("j"), "x")
        out = linalg.matmul(a, b).select((F.col("i") * n + F.col("j")).alias("i"), "x")
        return self._like(out, [self.shape[0], n] if other.ndim == 2 else [self.shape[0]])

    matmul = __matmul__

    def cosine_similarity(self, other: SparkArray) -> float:
        r = self._beside(other).agg(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))).first()
        return r[0] / r[1] if r[1] else 0.0

    # Bits: elements of unsigned bytes

    def _bitwise(self, other, f: Callable[[Column, Column], Column]) -> SparkArray:
        df, y = (self._beside(other), F.col("y")) if isinstance(other, SparkArray) else (self.df, F.lit(other).cast("bigint"))
        return self._like(df.select("i", f(F.col("x"), y).alias("x")))

    def __and__(self, other):
        return self._bitwise(other, lambda a, b: a.bitwiseAND(b))

    def __or__(self, other):
        return self._bitwise(other, lambda a, b: a.bitwiseOR(b))

    def __xor__(self, other):
        return self._bitwise(other, lambda a, b: a.bitwiseXOR(b))

    bind = __xor__

    def __invert__(self) -> SparkArray:
        return self._map(lambda x: x.bitwiseXOR(F.lit(255 if self.dtype == "uint8" else -1).cast("bigint")), self.dtype)

    def permute(self, k: int) -> SparkArray:
        """Turn bytes by k bits towards higher places, around the end."""
        n = len(self)
        q, r = divmod(k % (8 * n), 8)
        x = F.col("x")
        high = self.df.select(((F.col("i") + q) % n).alias("i"), F.shiftleft(x, r).bitwiseAND(255).alias("x"))
        low = self.df.select(((F.col("i") + q + 1) % n).alias("i"), F.shiftright(x, 8 - r).alias("x"))
        return self._like(high.unionByName(low).groupBy("i").agg(F.bit_or("x").alias("x")))

    def popcount(self) -> int:
        return self.df.agg(F.coalesce(F.sum(F.bit_count("x")), F.lit(0))).first()[0]

    def hamming_distance(self, other: SparkArray) -> int:
        return (self ^ other).popcount()

    def hamming_distance_adaptive(self, other: SparkArray, threshold: int) -> int | None:
        """The distance where it is within the threshold."""
        d = self.hamming_distance(other)
        return d if d <= threshold else None

    def dot_i8(self, other: SparkArray) -> int:
        signed = lambda c: F.when(F.col(c) > 127, F.col(c) - 256).otherwise(F.col(c))
        return self._beside(other).agg(F.sum(signed("x") * signed("y"))).first()[0]

    def cosine_i8(self, other: SparkArray) -> float:
        norms = (self.dot_i8(self) * other.dot_i8(other)) ** 0.5
        return self.dot_i8(other) / norms if norms else 0.0

    @staticmethod
    def bundle(arrays: Sequence[SparkArray]) -> SparkArray:
        """Majority of each bit; a tie gives 0."""
        first, every = arrays[0], None
        for a in arrays:
            every = a.df if every is None else every.unionByName(a.df)
        n = len(arrays)
        value = F.lit(0).cast("bigint")
        for b in range(8):
            value = value + F.when(2 * F.sum(F.getbit("x", F.lit(b)).cast("bigint")) > n, F.lit(1 << b)).otherwise(F.lit(0))
        return first._like(every.groupBy("i").agg(value.alias("x")))


def zeros(spark: SparkSession, shape: Sequence[int]) -> SparkArray:
    return SparkArray(layout.zeros(spark, shape), shape)


def ones(spark: SparkSession, shape: Sequence[int]) -> SparkArray:
    return SparkArray(layout.ones(spark, shape), shape)


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> SparkArray:
    from math import ceil

    return SparkArray(layout.arange(spark, start, stop, step), [max(0, ceil((stop - start) / step))])


def linspace(spark: SparkSession, start: float, stop: float, num: int) -> SparkArray:
    return SparkArray(layout.linspace(spark, start, stop, num), [num])
