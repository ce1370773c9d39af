"""Lagged causal signals between two series, and reverse traces through bound vectors.

A series has one row for each time: t, and arrays a and b. Lags are an equi-join on time, all of them in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bf16, symbols


def lagged(series: DataFrame, lags: list[int], *by: str) -> DataFrame:
    """(by, tau, t, a, b, later): each time beside b at t + tau, for each series of ``by``."""
    each = series.select(*by, "t", "a", "b", F.explode(F.array(*[F.lit(x) for x in lags])).alias("tau")).withColumn("_t", F.col("t") + F.col("tau"))
    return each.join(series.select(*by, F.col("t").alias("_t"), F.col("b").alias("later")), [*by, "_t"]).drop("_t")


def granger_signal(series: DataFrame, lags: list[int], *by: str) -> DataFrame:
    """(tau, signal): the mean of d(a(t), b(t + tau)) - d(b(t), b(t + tau)); negative where a leads."""
    d = lambda x, y: symbols.distance(F.col(x), F.col(y))
    return lagged(series, lags, *by).groupBy(*by, "tau").agg(F.avg(d("a", "later") - d("b", "later")).alias("signal"))


def granger_scan(series: DataFrame, max_lag: int, *by: str) -> DataFrame:
    """The lag of 1 to max_lag with the smallest signal, the first of equal ones; lags without a pair don't count."""
    return granger_signal(series, list(range(1, max_lag + 1)), *by).groupBy(*by).agg(F.min(F.struct("signal", "tau")).alias("m")).select(*by, "m.tau", "m.signal")


def bf16_granger_dims(series: DataFrame, lags: list[int], *by: str) -> DataFrame:
    """(by, tau, dim, sign_flips, exponent_shifts, rank): how often each place changes sign, and magnitude, from a(t) to
    b(t + tau); places are ranked by sign flips, then number."""
    diff = bf16.structural_diff(F.col("a"), F.col("later"))
    each = lagged(series, lags, *by).select(*by, "tau", diff.alias("d"))
    marks = F.concat(
        F.transform("d.sign_dims", lambda i: F.struct(i.alias("dim"), F.lit(1).alias("s"), F.lit(0).alias("e"))),
        F.transform("d.major_dims", lambda i: F.struct(i.alias("dim"), F.lit(0).alias("s"), F.lit(1).alias("e"))),
    )
    counts = each.select(*by, "tau", F.explode(marks).alias("m")).groupBy(*by, "tau", F.col("m.dim").alias("dim")).agg(F.sum("m.s").alias("sign_flips"), F.sum("m.e").alias("exponent_shifts"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "tau").orderBy(F.desc("sign_flips"), "dim")))


def bf16_granger_signal(series: DataFrame, lags: list[int], *by: str, weights: bf16.Weights = bf16.TRAINING) -> DataFrame:
    d = lambda x, y: bf16.distance(F.col(x), F.col(y), weights)
    return lagged(series, lags, *by).groupBy(*by, "tau").agg(F.avg(d("a", "later") - d("b", "later")).alias("signal"), F.count(F.lit(1)).alias("timesteps"))


def bf16_granger_scan(series: DataFrame, max_lag: int, *by: str) -> DataFrame:
    """The best lag's signal and its places."""
    lags = list(range(1, max_lag + 1))
    best = bf16_granger_signal(series, lags, *by).groupBy(*by).agg(F.min(F.struct("signal", "tau", "timesteps")).alias("m")).select(*by, "m.tau", "m.signal", "m.timesteps")
    return bf16_granger_dims(series, lags, *by).join(best, [*by, "tau"])


def sign_flip_rate(flips: Column, timesteps: Column) -> Column:
    return F.when(timesteps == 0, F.lit(0.0)).otherwise(flips / timesteps)


def dims_above(dims: DataFrame, rate: float) -> DataFrame:
    """Places whose rate of sign flips is above a rate."""
    return dims.where(sign_flip_rate(F.col("sign_flips"), F.col("timesteps")) > rate)


def reverse_trace(outcome: list[int], role: list[int], entities: DataFrame, base: symbols.Base, max_depth: int, threshold: float) -> DataFrame:
    """From an outcome back: unbind the role, take the nearest of (id, s), go on from it while the distance by the
    number of places stays below the threshold. (depth, id, dist, normalised, confident). One pass over the entities
    for each hop; the driver holds one row."""
    spark, d = entities.sparkSession, len(outcome)
    current, steps = outcome, []
    for depth in range(max_depth):
        cand = symbols.unbind(F.array(*map(F.lit, current)), F.array(*map(F.lit, role)), base)
        found = entities.agg(F.min(F.struct(symbols.distance(cand, F.col("s")).alias("dist"), "id", "s")).alias("m")).select("m.*").first()
        if found is None or found["id"] is None:
            break
        norm = found["dist"] / d
        steps.append((depth, found["id"], found["dist"], norm, norm < threshold))
        if norm >= threshold:
            break
        current = list(found["s"])
    return spark.createDataFrame(steps, "depth int, id bigint, dist bigint, normalised double, confident boolean")


def bf16_reverse_trace(outcome: list[int], role: list[int], entities: DataFrame, max_depth: int, threshold: float, weights: bf16.Weights = bf16.Weights()) -> DataFrame:  # noqa: B008
    """The same over BF16 patterns: unbinding is an exclusive or, distances are weighted and normalised by the most that
    is possible. Adds the places whose sign flips at each hop."""
    spark, d = entities.sparkSession, len(outcome)
    current, steps = outcome, []
    for depth in range(max_depth):
        cand = F.array(*[F.lit(x ^ y) for x, y in zip(current, role, strict=True)])
        found = entities.agg(F.min(F.struct(bf16.distance(cand, F.col("s"), weights).alias("dist"), "id", "s", bf16.structural_diff(cand, F.col("s"))["sign_dims"].alias("dims"))).alias("m")).select("m.*").first()
        if found is None or found["id"] is None:
            break
        norm = found["dist"] / (weights.most * d)
        steps.append((depth, found["id"], found["dist"], norm, norm < threshold, list(found["dims"])))
        if norm >= threshold:
            break
        current = list(found["s"])
    return spark.createDataFrame(steps, "depth int, id bigint, dist bigint, normalised double, confident boolean, dims array<int>")


def backbone(trace: DataFrame) -> DataFrame:
    """Places that flip in all confident hops but one at most, from a depth of two on."""
    sure = trace.where("confident")
    n = sure.count()
    return sure.select(F.explode("dims").alias("dim")).groupBy("dim").count().where(F.lit(n >= 2) & (F.col("count") >= max(1, n - 1))).select("dim")
