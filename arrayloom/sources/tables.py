"""Sources and sinks: Parquet tables, named views, and records of four channels as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

#: Words of a record's channel.
CHANNEL_WORDS = 256
CHANNELS = ("meta", "cam", "btree", "embed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write Parquet, in folders by columns."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


class Board:
    """Named DataFrames: put replaces, kept ones are cached until they are freed."""

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, {}

    def put(self, name: str, df: DataFrame, keep: bool = False) -> DataFrame:
        self.free(name)
        self._held[name] = df.persist() if keep else df
        df.createOrReplaceTempView(name)
        return self._held[name]

    def get(self, name: str) -> DataFrame | None:
        return self._held.get(name)

    def free(self, name: str) -> bool:
        df = self._held.pop(name, None)
        if df is None:
            return False
        df.unpersist()
        self.spark.catalog.dropTempView(name)
        return True

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def __len__(self) -> int:
        return len(self._held)

    def names(self) -> list[str]:
        return sorted(self._held)


def record(meta: Column, cam: Column, btree: Column, embed: Column, words: int = CHANNEL_WORDS) -> Column:
    """A record of four channels of ``words`` words each."""

    def sized(a: Column) -> Column:
        return F.when(F.size(a) == words, a).otherwise(F.raise_error(F.lit(f"a channel has {words} words")).cast("array<bigint>"))

    return F.struct(*[sized(a).alias(c) for a, c in zip((meta, cam, btree, embed), CHANNELS, strict=True)])


def zero_record(words: int = CHANNEL_WORDS) -> Column:
    return F.struct(*[bits.zeros(words * 64).alias(c) for c in CHANNELS])


def record_to_bytes(rec: Column) -> Column:
    return F.concat(*[bits.to_bytes(rec[c]) for c in CHANNELS])


def record_from_bytes(data: Column, words: int = CHANNEL_WORDS) -> Column:
    size = 8 * words
    return F.struct(*[bits.from_bytes(F.substring(data, F.lit(1 + k * size), F.lit(size)), words).alias(c) for k, c in enumerate(CHANNELS)])
