"""Operators that follow an order: running sums, sorting, top-k, sliding windows and gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumsum(df: DataFrame, x: str, order: str, *by: str, out: str = "cumsum") -> DataFrame:
    """Running sum within each of ``by``'s groups."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(x).over(w))


def cumsum_all(df: DataFrame, x: str, order: str, *, out: str = "cumsum", ranges: int | None = None) -> DataFrame:
    """Running sum over a whole table in order of a column, without bringing all rows to one task.

    Rows are dealt into ranges of about equal size by sampled quantiles of the order, so clustered values make no large
    range; only the ranges' sums are summed up in one place, the running sum within a range is a window of its own. Rows that
    share a value of the order come one after the other.
    """
    from .cluster import kept

    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = kept(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()))
    sums = cut.groupBy("_range").agg(F.sum(x).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum(x).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_inner")).drop("_range", "_inner", "_before")


def ranked(df: DataFrame, x: str, tie: str, *, out: str = "place") -> DataFrame:
    """The place (from 0) of each row in order of x, then of the tie; nulls first. Rows are dealt into ranges by sampled
    quantiles; places within a range are a window of its own, and only the ranges' sizes meet."""
    from .cluster import kept

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = kept(df.repartitionByRange(n, x, tie).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(x, tie)) - 1
    return cut.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_inner")).drop("_range", "_inner", "_before")


def top_k(df: DataFrame, x: str, k: int, tie: str) -> DataFrame:
    """The k largest, ties to the smaller ``tie``."""
    return df.orderBy(F.desc(x), tie).limit(k)


def top_k_by(df: DataFrame, order: list[Column], k: int, *by: str, rank: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def absorption(df: DataFrame, x: str, order: list[str], window: int, *by: str) -> DataFrame:
    """Mean and minimum of the last ``window`` values, and what they call for."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    out = df.withColumn("average", F.avg(x).over(w)).withColumn("minimum", F.min(x).over(w))
    return out.withColumn("action", flush_action(F.col("average"), F.col("minimum")))


def flush_action(average: Column, minimum: Column) -> Column:
    return F.when(minimum < 0.1, "emergency").when(average < 0.4, "hard").when(average < 0.7, "soft").otherwise("none")


def gradient_3d(df: DataFrame, r: int, value: str = "pop") -> DataFrame:
    """Central differences of a cubic table (i, j, k, value) along each axis; 0 on its surface."""
    inside = F.lit(True)
    for a in "ijk":
        inside = inside & F.col(a).between(1, r - 2)
    for a in "ijk":
        w = Window.partitionBy(*[b for b in "ijk" if b != a]).orderBy(a)
        slope = (F.lead(value).over(w) - F.lag(value).over(w)) / 2
        df = df.withColumn(f"d{a}", F.when(inside, slope).otherwise(F.lit(0.0)))
    return df


def plasticity(count: Column, age: Column, decay_window: int, cardinality: int | None = None) -> Column:
    """How much a concept may change: little when it is new, fully when active, less and less with more writes."""
    scale = 1.0 if cardinality is None else min(1.5, max(0.5, 8 / cardinality))
    new, young = min(1.0, max(0.15, 0.5 * scale)), min(1.0, max(0.3, 0.8 * scale))
    curve = F.when(count <= 2, F.lit(new)).when(count <= 5, F.lit(young)).when(count <= 20, F.lit(1.0)).when(count <= 50, F.lit(0.5)).when(count <= 200, F.lit(0.2)).otherwise(F.lit(0.1))
    return F.when(age > decay_window, F.lit(0.3)).otherwise(curve)
