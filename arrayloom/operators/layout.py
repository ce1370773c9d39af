"""Arrays as DataFrames: wide (id, v array) and long (id, i, x), constructors, and changes of shape."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_long(df: DataFrame, id_col: str, array_col: str, *keep: str) -> DataFrame:
    """One row for each element: the id, kept columns, i from 0, and x as a double."""
    return df.select(id_col, *keep, F.posexplode(F.col(array_col)).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def to_wide(df: DataFrame, id_col: str, place: str = "i", value: str = "x") -> DataFrame:
    """One array for each id, in order of place."""
    pairs = F.array_sort(F.collect_list(F.struct(place, value)))
    return df.groupBy(id_col).agg(F.transform(pairs, lambda p: p[value]).alias("v"))


def full(spark: SparkSession, shape: Sequence[int], value: float) -> DataFrame:
    """A constant array in long form; an empty shape is one element."""
    return spark.range(prod(shape)).select(F.col("id").alias("i"), F.lit(float(value)).alias("x"))


def zeros(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    return full(spark, shape, 1.0)


def arange(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """start, start + step, ... before stop."""
    if step == 0:
        raise ValueError("step must not be 0")
    n = max(0, ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("x"))


def linspace(spark: SparkSession, start: float, stop: float, num: int) -> DataFrame:
    """``num`` numbers with equal steps, both ends included."""
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    x = F.lit(float(start)) + F.col("id") * F.lit(step)
    return spark.range(num).select(F.col("id").alias("i"), (F.when(F.col("id") == num - 1, F.lit(float(stop))).otherwise(x) if num > 1 else x).alias("x"))


def strides(shape: Sequence[int]) -> list[int]:
    """Elements between neighbours of each axis, the last axis fastest."""
    out, step = [], 1
    for n in reversed(shape):
        out.insert(0, step)
        step *= n
    return out


def leading_dim(rows: int, cols: int, layout: str = "row") -> int:
    return cols if layout == "row" else rows


def linear_index(i: Column, j: Column, ld: int, layout: str = "row") -> Column:
    return i * ld + j if layout == "row" else j * ld + i


def with_axes(df: DataFrame, shape: Sequence[int], place: str = "i") -> DataFrame:
    """Index columns a0, a1, ... of a linear place."""
    for k, (n, s) in enumerate(zip(shape, strides(shape), strict=True)):
        df = df.withColumn(f"a{k}", F.floor(F.col(place) / s) % n)
    return df


def from_axes(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """The linear place of index columns, as i."""
    place = F.lit(0).cast("bigint")
    for k, s in enumerate(strides(shape)):
        place = place + F.col(f"a{k}") * s
    return df.withColumn("i", place)


def checked_shape(a: Column, shape: Sequence[int]) -> Column:
    """The array, or an error where its size isn't the shape's."""
    return F.when(F.size(a) == prod(shape), a).otherwise(F.raise_error(F.lit(f"size must be {prod(shape)}")).cast("array<double>"))


def item(a: Column) -> Column:
    """The only element of an array."""
    return F.when(F.size(a) == 1, F.get(a, 0)).otherwise(F.raise_error(F.lit("the array must have one element")).cast("double"))


def reshape(df: DataFrame, old: Sequence[int], new: Sequence[int]) -> DataFrame:
    """New index columns over the same order of elements."""
    if prod(old) != prod(new):
        raise ValueError("shapes must have equally many elements")
    return with_axes(df.drop(*[f"a{k}" for k in range(len(old))]), new)


def transpose(df: DataFrame, row: str = "i", col: str = "j") -> DataFrame:
    return swapped(df, row, col)


def swapped(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two columns with their names exchanged."""
    return df.select(*[F.col(c).alias({a: b, b: a}.get(c, c)) for c in df.columns])


def flip(df: DataFrame, axis: str, size: int) -> DataFrame:
    """Reverse an index column."""
    return df.withColumn(axis, F.lit(size - 1) - F.col(axis))


def slice_axis(df: DataFrame, axis: str, start: int, end: int) -> DataFrame:
    """Places [start, end) of an index column, counted from 0 again."""
    return df.where((F.col(axis) >= start) & (F.col(axis) < end)).withColumn(axis, F.col(axis) - start)


def squeeze(shape: Sequence[int], axes: Sequence[int] | None = None) -> list[int]:
    """The shape without its axes of size 1, or without those listed, which must have it."""
    if axes is not None and any(shape[a] != 1 for a in axes):
        raise ValueError("only axes of size 1 can go")
    return [n for k, n in enumerate(shape) if not (n == 1 if axes is None else k in axes)]


def concatenate(parts: Sequence[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """Put arrays behind each other along an index column; each comes with its size there."""
    out, offset = None, 0
    for df, size in parts:
        moved = df.withColumn(axis, F.col(axis) + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += size
    return out


def get(df: DataFrame, **place: int) -> DataFrame:
    """The element at index columns' values."""
    for axis, at in place.items():
        df = df.where(F.col(axis) == at)
    return df


def put(df: DataFrame, value: float, column: str = "x", **place: int) -> DataFrame:
    """The array with one element replaced."""
    test = F.lit(True)
    for axis, at in place.items():
        test = test & (F.col(axis) == at)
    return df.withColumn(column, F.when(test, F.lit(value)).otherwise(F.col(column)))
