"""Reductions of arrays in long form: over everything, or over the axes that ``by`` leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

X = "x"


def _agg(df: DataFrame, by: Sequence[str], **cols: Column) -> DataFrame:
    named = [c.alias(k) for k, c in cols.items()]
    return df.groupBy(*by).agg(*named) if by else df.agg(*named)


def mean(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    return _agg(df, by, mean=F.avg(x))


def int_mean(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    """The mean of integers cut off towards zero."""
    return _agg(df, by, mean=F.call_function("div", F.sum(x), F.count(x)))


def median(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    return _agg(df, by, median=F.median(x))


def var(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    """Population variance, 0 without elements."""
    return _agg(df, by, var=F.coalesce(F.var_pop(x), F.lit(0.0)))


def std(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    return _agg(df, by, std=F.coalesce(F.stddev_pop(x), F.lit(0.0)))


def percentile(df: DataFrame, p: float, *by: str, x: str = X) -> DataFrame:
    """Percentile p of 0..100, interpolated between neighbours."""
    if not 0 <= p <= 100:
        raise ValueError("p must be from 0 to 100")
    return _agg(df, by, percentile=F.percentile(x, F.lit(p / 100)))


def extremes(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    """min and max; null without elements."""
    return _agg(df, by, min=F.min(x), max=F.max(x))


def arg_extremes(df: DataFrame, *by: str, place: str = "i", x: str = X) -> DataFrame:
    """Places of the smallest and the largest element, the first of equal ones."""
    return _agg(df, by, argmin=F.min_by(place, F.struct(x, place)), argmax=F.max_by(place, F.struct(F.col(x), -F.col(place))))


def norm(df: DataFrame, p: int, *by: str, x: str = X) -> DataFrame:
    """L1 or L2 norm."""
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    return _agg(df, by, norm=F.sum(F.abs(x)) if p == 1 else F.sqrt(F.sum(F.col(x) * F.col(x))))


def approx_mean_std(df: DataFrame, *by: str, x: str = X) -> DataFrame:
    """Mean and standard deviation over 256 levels between the smallest and the largest element."""
    low = _agg(df, by, low=F.min(x), high=F.max(x))
    joined = df.join(F.broadcast(low) if not by else low, list(by)) if by else df.crossJoin(F.broadcast(low))
    scale = (F.col("high") - F.col("low")) / 255
    q = F.when(scale == 0, F.lit(0.0)).otherwise(F.round((F.col(x) - F.col("low")) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)))
    graded = joined.select(*by, "low", scale.alias("scale"), q.alias("q"))
    moments = graded.groupBy(*by, "low", "scale").agg(F.avg("q").alias("m"), F.avg(F.col("q") * F.col("q")).alias("m2"))
    return moments.select(*by, (F.col("low") + F.col("scale") * F.col("m")).alias("mean"), (F.col("scale") * F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("m") * F.col("m")))).alias("std"))


def approx_row_norm(v: Column) -> Column:
    """L2 norm of an array through symmetric 8-bit integers."""
    from ..functions.elementwise import let
    from ..functions.quant import i8

    return let(i8(v), lambda s: s["scale"] * F.sqrt(F.aggregate(s["q"], F.lit(0).cast("bigint"), lambda t, q: t + q.cast("bigint") * q).cast("double")))


def matrix_stats(df: DataFrame, total_bits: int, value: str = "pop") -> DataFrame:
    """Mean, deviation, extremes, and shares within one and beyond two deviations of half the bits."""
    z = F.abs(F.col(value) - total_bits / 2) / (total_bits / 4) ** 0.5
    return df.agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(F.when(z < 1, 1.0).otherwise(0.0)).alias("within_1"), F.avg(F.when(z > 2, 1.0).otherwise(0.0)).alias("beyond_2"),
    )


def lfd(count_r: Column, count_half: Column) -> Column:
    """Local fractal dimension from the numbers of points within r and r / 2; 0 where either tells nothing."""
    return F.when((count_half <= 0) | (count_r <= count_half), F.lit(0.0)).otherwise(F.log2(count_r / count_half))


def lower_percentiles(df: DataFrame, x: str, ps: Sequence[int]) -> DataFrame:
    """Percentiles by place n * p / 100 in order, without interpolation, and min, max, mean. For a column of bounded size:
    one place for each node of a tree."""
    ordered = df.agg(F.array_sort(F.collect_list(x)).alias("a"))
    last = F.size("a") - 1
    return ordered.select(
        *[F.get("a", F.least(last, F.floor(F.size("a") * p / 100).cast("int"))).alias(f"p{p}") for p in ps],
        F.array_min("a").alias("min"), F.array_max("a").alias("max"), (F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / F.size("a")).alias("mean"),
    )


def channel_gaps(df: DataFrame, d: int, channels: int) -> DataFrame:
    """For positions (j, channel): the smallest gap between neighbours of one channel, and the deviation of the
    channels' sizes from d / channels."""
    w = Window.partitionBy("channel").orderBy("j")
    gap = df.withColumn("gap", F.col("j") - F.lag("j").over(w)).agg(F.min("gap").alias("min_gap"))
    sizes = df.groupBy("channel").count().agg(F.sqrt(F.sum(F.pow(F.col("count") - d / channels, 2)) / channels).alias("size_std"))
    return gap.crossJoin(sizes)
