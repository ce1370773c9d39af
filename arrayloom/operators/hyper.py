"""Hyperdimensional operators: bundles, random projections, edge codes and binding tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..shipping import ship
from ..sources.random import SplitMix64

#: Verbs of the default codebook and their rotations.
VERBS = {"BECOMES": 1, "CAUSES": 2, "SUPPORTS": 3, "CONTRADICTS": 4, "REFINES": 5, "GROUNDS": 6, "ABSTRACTS": 7}


def bundle(df: DataFrame, by: str, words: str, n_words: int) -> DataFrame:
    """Majority of each bit over a group's bit vectors, a tie gives 0: (by, w). Counts are kept in an array for each
    group, summed before the shuffle."""
    counted = df.select(by, F.posexplode(words).alias("word", "w")).select(by, "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), "w")
    votes = counted.groupBy(by, "word", "bit").agg((2 * F.sum(F.getbit("w", F.col("bit")).cast("bigint")) > F.count(F.lit(1))).alias("set"))
    value = F.when(F.col("set"), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint"))
    each = votes.groupBy(by, "word").agg(F.bit_or(value).alias("w"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "w"))), lambda s: s["w"]).alias("w"))


def hyperplanes(d: int, n_bits: int, seed: int) -> np.ndarray:
    """d x n_bits numbers in [-1, 1) from SplitMix64, row by row."""
    raw = SplitMix64(seed).array(d * n_bits)
    return ((raw >> np.uint64(40)).astype(np.float64) / (1 << 24) * 2 - 1).reshape(d, n_bits)


def simhash(df: DataFrame, id_col: str, vector: str, n_bits: int, planes: np.ndarray) -> DataFrame:
    """(id, w): the signs of projections on hyperplanes (d x n_bits), which are sent to every task."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            side = np.stack(part[vector].to_numpy()).astype(np.float64) @ planes >= 0
            packed = np.packbits(side, axis=1).view(np.int64)  # the first bit of each byte is its highest
            yield pd.DataFrame({id_col: part[id_col], "w": list(packed)})

    return df.select(id_col, vector).mapInPandas(run, f"{id_col} {kind}, w array<bigint>")


def simhash_int8_planes(d: int, n_bits: int, seed: int) -> np.ndarray:
    """d x n_bits signs drawn bit by bit, for integer vectors."""
    raw = SplitMix64(seed).array(d * n_bits)
    return np.where(raw.reshape(n_bits, d) >> np.uint64(63), 1.0, -1.0).T


def simhash_int8(df: DataFrame, id_col: str, vector: str, n_bits: int, seed: int) -> DataFrame:
    """(id, w): the signs of projections of integer vectors on hyperplanes of plus and minus one. Sums are exact."""
    d = df.select(F.max(F.size(vector))).first()[0] or 0
    return simhash(df, id_col, vector, n_bits, simhash_int8_planes(d, n_bits, seed))


def codebook(spark: SparkSession, verbs: dict[str, int] = VERBS) -> DataFrame:
    return spark.createDataFrame(list(verbs.items()), "verb string, offset int")


def encode_edge(src: Column, tgt: Column, offset: int, n_words: int) -> Column:
    """source + source turned by the verb's offset + target turned twice as far."""
    return bits.xor(bits.xor(src, bits.permute(src, offset, n_words)), bits.permute(tgt, 2 * offset, n_words))


def decode_target(edge: Column, src: Column, offset: int, n_words: int) -> Column:
    turned = bits.xor(bits.xor(edge, src), bits.permute(src, offset, n_words))
    return bits.permute(turned, n_words * 64 - 2 * offset % (n_words * 64), n_words)


def encode_edge_explicit(src: Column, verb: Column, tgt: Column, n_words: int) -> Column:
    return bits.xor(bits.xor(src, bits.permute(verb, 1, n_words)), bits.permute(tgt, 2, n_words))


def decode_target_explicit(edge: Column, src: Column, verb: Column, n_words: int) -> Column:
    return bits.permute(bits.xor(bits.xor(edge, src), bits.permute(verb, 1, n_words)), n_words * 64 - 2, n_words)


def causality_asymmetry(src: Column, tgt: Column, offset: int, n_words: int) -> Column:
    """Share of bits in which an edge differs from its reverse."""
    return bits.hamming(encode_edge(src, tgt, offset, n_words), encode_edge(tgt, src, offset, n_words)) / (n_words * 64)


def non_causal_edges(edges: DataFrame, offset: int, n_words: int, threshold: float) -> DataFrame:
    """(id, src, tgt) whose asymmetry is below the threshold."""
    return edges.withColumn("asymmetry", causality_asymmetry(F.col("src"), F.col("tgt"), offset, n_words)).where(F.col("asymmetry") < threshold)


def infer_verb(edges: DataFrame, candidates: DataFrame, n_words: int, verbs: dict[str, int] = VERBS) -> DataFrame:
    """(eid, edge, src) with the verb and candidate (cid, c) that decode it best; the first verb, then candidate, of
    equal ones. Verbs are columns of one pass, candidates a bounded set of queries."""
    from .search import pair_queries

    decoded = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("verb"), decode_target(F.col("edge"), F.col("src"), o, n_words).alias("t")) for k, (v, o) in enumerate(verbs.items())])
    tried = pair_queries(candidates, edges.select("eid", F.explode(decoded).alias("d")))
    return tried.groupBy("eid").agg(F.min(F.struct(bits.hamming(F.col("d.t"), F.col("c")).alias("dist"), F.col("d.k").alias("k"), F.col("cid"), F.col("d.verb").alias("verb"))).alias("m")).select("eid", "m.verb", "m.cid", "m.dist")


def binding_table(df: DataFrame, r: int, n_words: int) -> DataFrame:
    """For the only row's bit vectors x, y, z: (i, j, k, pop) for turns by multiples of bits / r."""
    step = n_words * 64 // r

    def turned(name: str, place: str) -> DataFrame:
        every = F.array(*[F.struct(F.lit(i).alias(place), bits.permute(F.col(name), i * step, n_words).alias("w")) for i in range(r)])
        return df.select(F.explode(every).alias("s")).select(f"s.{place}", F.col("s.w").alias(f"w{place}"))

    cube = turned("x", "i").crossJoin(turned("y", "j")).crossJoin(turned("z", "k"))  # r ** 3 rows, as the result
    return cube.select("i", "j", "k", bits.popcount(bits.xor(bits.xor(F.col("wi"), F.col("wj")), F.col("wk"))).alias("pop"))


def sweet_spots(table: DataFrame, total_bits: int, below: float | None = 1.0, above: float | None = None) -> DataFrame:
    """Cells whose count lies less than ``below`` deviations from half the bits, nearest first, or more than ``above``,
    farthest first."""
    z = F.abs(F.col("pop") - total_bits / 2) / (total_bits / 4) ** 0.5
    cells = table.withColumn("z", z)
    if above is not None:
        return cells.where(F.col("z") > above).orderBy(F.desc("z"), "i", "j", "k")
    return cells.where(F.col("z") < below).orderBy("z", "i", "j", "k")


def cross_section(table: DataFrame, k: int) -> DataFrame:
    return table.where(F.col("k") == k).select("i", "j", "pop")
