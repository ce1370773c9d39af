"""Shared session helpers: tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        current = jsc.getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="arrayloom-shared-")
            spark.sparkContext.setCheckpointDir(found)
            found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing reads any more, and let Spark drop the shuffles behind it."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


#: Keys that may count as heavy, and rows that no key needs to be heavy below.
HEAVY_KEYS, HEAVY_ROWS = 100_000, 4096


def join_by_weight(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row for each key; its column ``weight`` is how many of the
    ``total`` rows have that key, and goes. Keys of more than total / HEAVY_KEYS rows cannot be more than HEAVY_KEYS: those
    are broadcast and their rows stay where they are. The others join by a shuffle in which no key is large. Keys that
    are null match nothing."""
    floor = max(HEAVY_ROWS, total // HEAVY_KEYS)
    if total <= floor:
        return rows.join(side.drop(weight), keys)
    light = side.where(F.col(weight) <= floor).drop(weight)
    heavy = F.broadcast(side.where(F.col(weight) > floor).drop(weight))
    rest = rows.join(heavy.select(*keys), keys, "left_anti")
    return rest.join(light.hint("shuffle_hash"), keys).unionByName(rows.join(heavy, keys))


def hash_sample(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """The ``n`` rows of smallest hash of a key. Rows are thinned out to about twice as many first, so that what the
    tasks send to the driver does not grow with their number."""
    total = df.count() if total is None else total
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 2 * n + 200:
        df = df.where(h < int((2 * n + 200) / total * (1 << 40)))
    return df.orderBy(h, key).limit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
