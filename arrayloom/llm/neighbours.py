"""Approximate nearest neighbours by inner product: NN-descent builds graphs, greedy search over them answers queries.

Equal vectors are one node. Nodes are dealt to shards of bounded size by a hash of their id; one task makes the graph of a
shard by NN-descent and searches it for every query (``descent``), so a vector travels once and what is shuffled for the
queries is one row a query and shard. A shard's pool of each query is scored in double precision, and a query's best over
all shards are kept. Shards are handled in waves, so the copies of the queries on disk stay within a multiple of the table.
A table beyond that has more shards, not larger ones, so each is searched as well as before, and the work of a query grows
with the number of shards.

Vectors travel in four bytes a number where that loses nothing (an array of float) and in eight elsewhere. Searches take
products in four bytes only where the numbers have no more, products stay in range (``descent.working``) and no groups of
near copies need more (``Graph.tight``).

Defined cases: vectors that are null, zero, or hold a null or a number that is not finite take no part; vectors are compared with
those of their own length, each length by itself; of a repeated id the smallest vector counts; ties go to smaller ids; with
fewer candidates than asked all are returned; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .descent import Graph, working
from .session import discard, join_by_weight, ship, write_table

#: Most nodes and numbers of a shard, nodes that make another one worth a task, and shards of a wave.
SHARD, NUMBERS, LEAST, WAVE = 48_000, 1 << 24, 4096, 40
#: The search's pool, twice that where a query's best lie in fewer than ``FEW`` shards, and queries searched at once, and numbers of a temporary array.
POOL, FEW, ASKED, BLOCK = 96, 4, 8192, 1 << 22


def packed(v: np.ndarray, kind: str) -> list[bytes]:
    """Each vector as bytes, as ``kind`` (``f4`` or ``f8``), in the order of the vectors."""
    u = kind.replace("f", "u")
    bits = (v + 0.0).astype(kind).view(u)  # one zero
    top = np.array(1 << 8 * bits.itemsize - 1, u)
    data = np.where(bits & top, ~bits, bits | top).astype(f">{u}")
    return [r.tobytes() for r in data]


def restored(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Packed vectors of ``size`` numbers as a matrix of doubles."""
    data, at = K.buffers(column)
    rows = np.ascontiguousarray(data[at[0] : at[-1]]).reshape(len(at) - 1, -1)
    u = f"u{rows.shape[1] // size}"
    bits = rows.view(f">{u}").astype(u)
    top = np.array(1 << 8 * bits.itemsize - 1, u)
    return np.where(bits & top, bits ^ top, ~bits).view(u.replace("u", "f")).astype(np.float64)


def bounds(key: np.ndarray) -> list[int]:
    """Where groups of equal keys start, and the end."""
    return [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, size, q (packed) of the rows that take part."""
    kind = "f4" if table.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)  # nulls as NaN
            start = np.cumsum(sizes) - sizes

            def count(of: np.ndarray, start: np.ndarray = start, sizes: np.ndarray = sizes) -> np.ndarray:
                sums = np.append(0, np.cumsum(of))
                return sums[start + sizes] - sums[start]

            fit = (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0)
            for size in np.unique(sizes[fit]).tolist():
                every, step = np.flatnonzero(fit & (sizes == size)), max(1, BLOCK // size)
                for lo in range(0, len(every), step):
                    own = every[lo : lo + step]
                    v = values[start[own, None] + np.arange(size)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.full(len(own), size, np.int32)), pa.array(packed(v, kind), pa.binary())], ["vec_id", "size", "q"])

    v = F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(pack, "vec_id bigint, size int, q binary").groupBy("vec_id").agg(F.min(F.struct("q", "size")).alias("r")).select("vec_id", "r.size", "r.q")


FOUND = "query bigint, found binary"


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> bytes:
    """The ``k`` best of distinct nodes, as bytes: the ids, then the scores."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order].astype("<i8").tobytes() + scores[order].astype("<f8").tobytes()


def parts(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``best`` has written."""
    half = len(found) // 2
    return np.frombuffer(found, "<i8", half // 8), np.frombuffer(found, "<f8", half // 8, half)


def search(nodes: DataFrame, queries: DataFrame, size: int, total: int, k: int, *, pool: int = POOL) -> DataFrame:
    """(query, node, score): the ``k`` best found of each query. ``nodes`` has node, q; ``queries`` query, q."""
    spark = nodes.sparkSession
    most, step = max(1, min(SHARD, NUMBERS // size)), max(1, BLOCK // size)
    shards = max(-(-total // most), min(spark.sparkContext.defaultParallelism, -(-total // LEAST)), 1)
    pool = max(pool if shards >= FEW else 2 * pool, 2 * k)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        graph = ids = v = x = None

        def asked() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for at in range(0, len(table), min(ASKED, step)):
                part = table.slice(at, min(ASKED, step))
                query, q = part.column(2).to_numpy(), restored(part.column(3), size)
                own = q.astype(x.dtype) if x.dtype == np.float64 else working(q)
                near = graph.search(x if own.dtype == x.dtype else v, own, pool)
                row, place = np.nonzero(near >= 0)
                node = near[row, place]
                score = np.empty(len(node))
                for lo in range(0, len(node), step):
                    score[lo : lo + step] = np.einsum("ij,ij->i", v[node[lo : lo + step]], q[row[lo : lo + step]])
                cut = np.searchsorted(row, np.arange(len(query) + 1))
                found = [best(ids[node[lo:hi]], score[lo:hi], k) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found, pa.binary())], ["query", "found"])

        shard: int | None = None
        for batch in batches:  # of each shard the nodes, then all queries
            cut = bounds(batch.column(0).to_numpy())
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                piece = batch.slice(lo, hi - lo)
                if piece.column(0)[0].as_py() != shard:
                    if graph is not None and held:
                        yield from asked()
                    shard, graph, held = piece.column(0)[0].as_py(), None, []
                first = int(np.searchsorted(piece.column(1).to_numpy(), 1))
                if graph is None:
                    held.append(piece.slice(0, first))
                    if first == len(piece):
                        continue
                    table = pa.Table.from_batches(held)
                    ids, v = table.column(2).to_numpy(), restored(table.column(3), size)
                    x, held = working(v), []
                    graph = Graph(x) if len(v) else None
                    if graph is not None and graph.tight():
                        x, graph = v, Graph(v)
                if graph is not None:
                    held.append(piece.slice(first))
                    if sum(map(len, held)) >= ASKED:
                        yield from asked()
                        held = []
        if graph is not None and held:
            yield from asked()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: int | None = None
        held: list[bytes] = []
        for batch in batches:
            names, founds = [], []
            for own, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != query and held:
                    names.append(query), founds.append(join(held))
                    held = []
                query = own
                held.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(founds, pa.binary())], ["query", "found"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([query], pa.int64()), pa.array([join(held)], pa.binary())], ["query", "found"])

    def join(held: list[bytes]) -> bytes:
        ids, scores = zip(*map(parts, held), strict=True)
        return best(np.concatenate(ids), np.concatenate(scores), k)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, scores = zip(*map(parts, batch.column(1).to_pylist()), strict=True)
                query = np.repeat(batch.column(0).to_numpy(), [len(i) for i in ids])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query", "node", "score"])

    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    dealt = nodes.select(shard.alias("shard"), F.lit(0).alias("kind"), F.col("node").alias("id"), "q")
    found: DataFrame | None = None
    for lo in range(0, shards, WAVE):
        hi = min(shards, lo + WAVE)
        each = F.explode(F.array(*(F.lit(i) for i in range(lo, hi))))
        rows = dealt.where(F.col("shard").between(lo, hi - 1)).unionByName(queries.select(each.alias("shard"), F.lit(1).alias("kind"), F.col("query").alias("id"), "q"))
        rows = rows.withColumn("shard", F.col("shard") - lo)
        answers = rows.repartitionById(hi - lo, F.col("shard")).sortWithinPartitions("shard", "kind", "id").mapInArrow(answer, FOUND)
        before = found
        answers = answers if before is None else answers.unionByName(before)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = write_table(answers.repartition(n, "query").sortWithinPartitions("query").mapInArrow(merge, FOUND), "answers")
        if before is not None:
            discard(before)
    return found.mapInArrow(explode, "query bigint, node bigint, score double")


def nearest(table: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    ship(spark)
    rows = write_table(vectors(table, id_col, vector_col), "vectors")
    found = [_nearest(rows.where(F.col("size") == r[0]), r[0], r[1], k, every) for r in rows.groupBy("size").count().orderBy(F.desc("count")).collect()]
    out = found[0] if found else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(rows: DataFrame, size: int, count: int, k: int, every: int) -> DataFrame:
    """``nearest`` among the ``count`` rows (vec_id, q) of vectors of one length."""
    nodes = write_table(rows.groupBy("q").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    total = nodes.count()
    # the rows of vectors that stand once are their nodes; the others meet their node by weight
    own = nodes.where("n = 1").select("node", F.col("node").alias("vec_id"))
    several = None
    if total < count:
        several = write_table(join_by_weight(rows.select("vec_id", "q"), nodes.where("n > 1").select("q", "node", "n"), ["q"], "n", count).select("node", "vec_id"), "own")
        own = own.unionByName(several)
    asked = own.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    names = write_table(asked.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "names")
    queries = write_table(nodes.join(names.select(F.col("query").alias("node")), "node", "left_semi").select(F.col("node").alias("query"), "q"), "queries")
    each = search(nodes.select("node", "q"), queries, size, total, k + 1)
    if several is None:
        each = each.select("query", F.col("node").alias("vec_id"), "score")
    else:  # a node's k + 1 smallest ids are all that a result can hold of it
        place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
        members = several.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("node").agg(F.collect_list("vec_id").alias("members"))
        each = each.join(members, "node", "left").select("query", F.explode(F.coalesce("members", F.array("node"))).alias("vec_id"), "score")
    order = [F.desc("score"), F.col("vec_id")]
    top = each.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k + 1)
    lists = top.groupBy("query").agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("found"))
    lists = write_table(lists.join(names, "query"), "found")
    out = join_by_weight(asked, lists, ["query"], "n", names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kept = F.filter(F.array_sort("found"), lambda x: x["vec_id"] != F.col("query_id"))
    out = out.select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
