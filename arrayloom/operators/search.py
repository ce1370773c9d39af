"""Similarity search and joins over fingerprints, byte vectors and symbol vectors.

Queries are a stated, bounded set: they are counted and sent to all rows, a larger set block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bf16, bits, symbols
from ..shipping import ship

QUERIES_MOST = 10_000
#: Numbers of a block of queries that are sent to every task, and pairs that a task scores at a time: by products, and by
#: words, where a tile stays in a core's cache.
NUMBERS_MOST, PAIRS_MOST, TILE = 4_000_000, 1 << 20, 1 << 17


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; lists of different sizes are an error."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    if len(flat) % len(column) or len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors must have equal sizes")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def block_scores(queries: DataFrame, rows: DataFrame, score: Callable, names: list[str]) -> DataFrame:
    """(qid, id, ...) for queries (qid, qv) and rows (id, v), by matrix products of blocks. ``score(q, v)`` gives for two
    matrices the places (row of q, row of v) that stay, and a double column for each of ``names``. Queries are counted and
    go to the executors in blocks of at most NUMBERS_MOST numbers; rows are read once for each block. Null vectors take
    no part."""
    ship(rows.sparkSession)
    queries, rows = queries.where("qid IS NOT NULL AND qv IS NOT NULL").select("qid", "qv"), rows.where("v IS NOT NULL").select("id", "v")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    numbers = queries.agg(F.coalesce(F.sum(F.size("qv")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-numbers // NUMBERS_MOST)), None
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toArrow()
        ids, q = own.column(0).combine_chunks(), matrix(own.column(1).combine_chunks())
        found = rows.mapInArrow(_scorer(ids, q, score, names), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scorer(ids: pa.Array, q: np.ndarray, score: Callable, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lot = max(1, PAIRS_MOST // max(1, len(q)))
            for lo in range(0, len(batch) if len(q) else 0, lot):
                part = batch.slice(lo, lot)
                i, j, *values = score(q, matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), part.column(0).take(pa.array(j)), *[pa.array(x, pa.float64()) for x in values]], ["qid", "id", *names])

    return run


def _all_scores(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    dot = q @ v.T
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
    cosine = np.divide(dot, norms, out=np.zeros_like(dot), where=norms != 0)
    i, j = np.indices(dot.shape)
    return i.ravel(), j.ravel(), dot.ravel(), cosine.ravel()


def dot_cosine(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, id, dot, cosine) of every query (qid, qv) with every row (id, v); a cosine is 0 where a norm is."""
    return block_scores(queries, rows, _all_scores, ["dot", "cosine"])


def pair_queries(queries: DataFrame, rows: DataFrame, most: int = QUERIES_MOST) -> DataFrame:
    """Every query beside every row. The queries are counted: up to ``most`` they are broadcast, beyond that they are
    dealt into blocks that are broadcast one by one, so that rows stay spread over all tasks."""
    n = queries.limit(most + 1).count()
    if n <= most:
        return rows.crossJoin(F.broadcast(queries))
    blocks, out = -(-queries.count() // most), None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)) == b)
        both = rows.crossJoin(F.broadcast(own))
        out = both if out is None else out.unionByName(both)
    return out


def first_k(df: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query, numbered from 1."""
    w = Window.partitionBy(query).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def words(column: pa.Array) -> np.ndarray:
    """A column of word arrays as a matrix of unsigned words; arrays of different sizes are an error."""
    if not len(column):
        return np.zeros((0, 0), np.uint64)
    flat = column.flatten()
    if len(flat) % len(column) or len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors must have equal sizes")
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64).reshape(len(column), -1))


def _counted(q: np.ndarray, w: np.ndarray, outside: bool) -> np.ndarray:
    if q.shape[-1] != w.shape[-1]:
        raise ValueError("vectors must have equal sizes")
    total = np.zeros(np.broadcast_shapes(q.shape, w.shape)[:-1], np.uint8 if q.shape[-1] <= 3 else np.int32)
    for c in range(q.shape[-1]):
        total += np.bitwise_count(q[..., c] & ~w[..., c] if outside else q[..., c] ^ w[..., c])
    return total


def differing(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hamming distances along the last axis, in one byte each where they fit below 255."""
    return _counted(q, w, False)


def outside(q: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bits of queries outside masks: lower bounds of the distance to all under a mask."""
    return _counted(q, mask, True)


class Nearest:
    """The k nearest found so far of each query: distances and ids, the smallest first, ties to the smaller id."""

    def __init__(self, n: int, k: int, kind: type):
        self.k, self.far = k, np.iinfo(kind).max
        self.dist, self.ids = np.full((n, k), self.far, kind), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, lo: int, hi: int) -> np.ndarray:
        """The distances beyond which nothing can enter: the k-th found, or the largest there is."""
        return np.minimum(self.dist[lo:hi, -1], self.far - 1)

    def offer(self, lo: int, dist: np.ndarray, ids: np.ndarray) -> None:
        """Distances (a row for each query from ``lo`` on, a column for each id); the largest number stands for none."""
        head = dist.shape[1] // 8
        if head > 2 * self.k and (self.dist[lo : lo + len(dist), -1] == self.far).any():  # a few first, to know a limit
            self.offer(lo, dist[:, :head], ids[:head])
            dist, ids = dist[:, head:], ids[head:]
        limit = self.worst(lo, lo + len(dist))
        flat = np.flatnonzero(dist <= limit[:, None])
        i, j = np.divmod(flat, dist.shape[1])
        d, x = dist.ravel()[flat], ids[j]
        enters = (d < self.dist[lo + i, -1]) | (x < self.ids[lo + i, -1])
        i, d, x = i[enters], d[enters], x[enters]
        if not len(i):
            return
        own = np.unique(i)
        q = np.concatenate([np.repeat(own, self.k), i])
        d, x = np.concatenate([self.dist[lo + own].ravel(), d]), np.concatenate([self.ids[lo + own].ravel(), x])
        order = np.lexsort((x, d, q))
        q, d, x = q[order], d[order], x[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.dist[lo + own], self.ids[lo + own] = d[first].reshape(-1, self.k), x[first].reshape(-1, self.k)

    def batch(self, qids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        i, r = np.nonzero(self.dist < self.far)
        return pa.RecordBatch.from_arrays([qids.take(pa.array(i)), pa.array(self.ids[i, r]).cast(id_type), pa.array(self.dist[i, r].astype(np.int64))], ["qid", "id", "dist"])


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt evenly to all cores, two tasks each."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def whole_words(df: DataFrame, key: str, w: str) -> DataFrame:
    """Rows with a key and all words; others take no part in a search."""
    return df.where(F.col(key).isNotNull() & F.col(w).isNotNull() & F.forall(w, lambda x: x.isNotNull()))


def word_blocks(queries: DataFrame, rows: DataFrame, scan: Callable, schema: str, k: int = 0) -> DataFrame:
    """``scan(qids, words)`` gives for a block of queries (qid, qw) a function of a task's batches of ``rows``, which are used
    as they are. Queries are counted and go out in blocks of at most NUMBERS_MOST numbers, the k places that a task keeps for
    each among them; rows are read once for each block."""
    ship(rows.sparkSession)
    queries = whole_words(queries.select("qid", "qw"), "qid", "qw")
    numbers = queries.agg(F.coalesce(F.sum(F.size("qw") + 2 * k), F.lit(0))).first()[0]
    blocks, out = max(1, -(-numbers // NUMBERS_MOST)), None
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).toArrow()
        found = rows.mapInArrow(scan(own.column(0).combine_chunks(), words(own.column(1).combine_chunks())), schema)
        out = found if out is None else out.unionByName(found)
    return out


def tiles(n_queries: int, n_rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of queries that make at most TILE pairs with the rows."""
    lot = max(1, TILE // max(1, n_rows))
    for lo in range(0, n_queries if n_rows else 0, lot):
        yield lo, min(n_queries, lo + lot)


def found_schema(queries: DataFrame, rows: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, dist bigint"


def ranked_first(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what tasks found for each query: (qid, id, dist, rank)."""
    return first_k(found, "qid", [F.col("dist"), F.col("id")], k)


def smallest(queries: DataFrame, rows: DataFrame, k: int, measure: Callable = differing) -> DataFrame:
    """(qid, id, dist, rank) for (qid, qw) against (id, w) with integer ids: the k smallest of a measure of words, ties to
    the smaller id. Each task keeps k rows for each query, so pairs are neither sorted nor shuffled."""
    rows = whole_words(rows.select("id", "w"), "id", "w")

    def scan(qids: pa.Array, q: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kind = None, None
            for batch in batches if len(q) else ():
                w, ids, kind = words(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(0).type
                for lo, hi in tiles(len(q), len(w)):
                    dist = measure(q[lo:hi, None], w)
                    best = best or Nearest(len(q), k, dist.dtype.type)
                    best.offer(lo, dist, ids)
            if best is not None:
                yield best.batch(qids, kind)

        return run

    return ranked_first(word_blocks(queries, spread(rows), scan, found_schema(queries, rows), k), k)


def hamming_top_k(queries: DataFrame, rows: DataFrame, k: int, n_words: int | None = None) -> DataFrame:
    """(qid, qw) against (id, w): the k nearest by Hamming distance, ties to the smaller id."""
    return smallest(queries, rows, k)


def hamming_within(queries: DataFrame, rows: DataFrame, rho: int, n_words: int | None = None) -> DataFrame:
    """All rows within a Hamming distance."""
    return pair_queries(queries, rows).select("qid", "id", bits.hamming(F.col("qw"), F.col("w"), n_words).alias("dist")).where(F.col("dist") <= rho)


def prefix_estimate(q: Column, w: Column, words: int, total: int) -> Column:
    """Hamming distance estimated from the first words."""
    return bits.hamming(F.slice(q, 1, words), F.slice(w, 1, words)) * (total / words)


def hamming_adaptive(q: Column, w: Column, n_words: int, threshold: int, faithful: bool = False) -> Column:
    """The distance where it is within the threshold, else null. ``faithful`` first rejects on estimates from a
    sixteenth and a quarter of the words, with margins of three and two deviations, and so may miss some."""
    exact = bits.hamming(q, w)
    kept = F.when(exact <= threshold, exact)
    if not faithful or n_words < 16:
        return kept
    n = n_words * 64
    p = threshold / n
    for part, deviations in ((4, 2), (16, 3)):
        words = n_words // part
        sigma = part * (max(p * (1 - p), 0.0) * words * 64) ** 0.5
        kept = F.when(prefix_estimate(q, w, words, n_words) <= threshold + deviations * max(sigma, 1.0), kept)
    return kept


def adaptive_within(queries: DataFrame, rows: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """(qid, id, dist, staged) for (qid, qw) against (id, w) within the threshold: ``hamming_adaptive`` both ways, over blocks of
    words in the tasks that hold the rows."""
    n, p = n_words * 64, threshold / (n_words * 64)
    stages = []
    for part, deviations in ((16, 3), (4, 2)) if n_words >= 16 else ():
        sigma = part * (max(p * (1 - p), 0.0) * (n_words // part) * 64) ** 0.5
        stages.append((n_words // part, threshold + deviations * max(sigma, 1.0)))
    rows = whole_words(rows.select("id", "w"), "id", "w")

    def scan(qids: pa.Array, q: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if len(q) else ():
                w = words(batch.column(1))
                for lo, hi in tiles(len(q), len(w)):
                    dist = differing(q[lo:hi, None], w)
                    flat = np.flatnonzero(dist <= threshold)
                    i, j = np.divmod(flat, dist.shape[1])
                    dist, passed = dist.ravel()[flat].astype(np.int64), np.ones(len(i), bool)
                    for first, limit in stages:
                        passed &= differing(q[lo + i, :first], w[j, :first]) * (n_words / first) <= limit
                    if len(i):
                        yield pa.RecordBatch.from_arrays([qids.take(pa.array(lo + i)), batch.column(0).take(pa.array(j)), pa.array(dist), pa.array(dist, mask=~passed)], ["qid", "id", "dist", "staged"])

        return run

    return word_blocks(queries, spread(rows), scan, found_schema(queries, rows) + ", staged bigint")


def score(mode: str, q: Column, b: Column, hamming: Column, n_bytes: int, *, scale: float = 1.0, zero_point: int = 0, delta_weight: float = 0.5, weights: bf16.Weights = bf16.Weights()) -> Column:  # noqa: B008
    """The precise score of a finalist, higher is closer: off, vnni, f32, bf16 (as f32), delta_xor or bf16_hamming.
    ``q`` and ``b`` are arrays of bytes 0..255, or of BF16 patterns for bf16_hamming."""
    if mode == "off":
        return F.lit(None).cast("double")
    if mode == "vnni":
        return bits.cosine_i8(q, b)
    if mode in ("f32", "bf16"):
        from ..functions import elementwise

        real = lambda a: F.transform(a, lambda x: F.lit(scale) * (x - zero_point).cast("double"))
        return elementwise.cosine(real(q), real(b))
    if mode == "delta_xor":
        blended = hamming / (8.0 * n_bytes) * (1 - delta_weight) + (1 - bits.cosine_i8(q, b)) * delta_weight
        return 1 - blended
    if mode == "bf16_hamming":
        most = weights.most * (n_bytes // 2)
        return 1 - bf16.distance(q, b, weights) / most if most else F.lit(0.0)
    raise ValueError(mode)


def cascade(queries: DataFrame, rows: DataFrame, threshold: int, mode: str = "off", n_bytes: int = 8, n_words: int | None = None, **how) -> DataFrame:
    """(qid, qw, qb) against (id, w, b): rows within the Hamming threshold, with their precise score."""
    both = pair_queries(queries, rows).withColumn("hamming", bits.hamming(F.col("qw"), F.col("w"), n_words)).where(F.col("hamming") <= threshold)
    return both.select("qid", "id", "hamming", score(mode, F.col("qb"), F.col("b"), F.col("hamming"), n_bytes, **how).alias("precise"))


def cosine_i8_search(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(qid, qb) against (id, b): rows whose signed-byte cosine is at least ``least``; zero vectors are left out. Products of
    bytes are exact in doubles."""

    def signed(x: np.ndarray) -> np.ndarray:
        return np.where(x > 127, x - 256, x)

    def score(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        q, v = signed(q), signed(v)
        norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))
        cosine = np.divide(q @ v.T, norms, out=np.full(norms.shape, -2.0), where=norms > 0)
        i, j = np.nonzero((norms > 0) & (cosine >= least))
        return i, j, cosine[i, j]

    return block_scores(queries.select("qid", F.col("qb").alias("qv")), rows.select("id", F.col("b").alias("v")), score, ["cosine"])


CHANNELS = ("meta", "cam", "btree", "embed")


def sweep(queries: DataFrame, rows: DataFrame, thresholds: tuple[int, int, int, int]) -> DataFrame:
    """Records of four channels (struct ``rec`` and ``qrec`` of word arrays): those within every channel's threshold."""
    both = pair_queries(queries, rows)
    for c, t in zip(CHANNELS, thresholds, strict=True):
        both = both.withColumn(f"d_{c}", bits.hamming(F.col(f"qrec.{c}"), F.col(f"rec.{c}"))).where(F.col(f"d_{c}") <= t)
    return both


def hdr_sweep(queries: DataFrame, rows: DataFrame, thresholds: tuple[int, int, int, int]) -> DataFrame:
    """The same with the signed-byte cosine of the embed channel's bytes (``qe`` and ``e``); callers order by it."""
    return sweep(queries, rows, thresholds).withColumn("cosine", bits.cosine_i8(F.col("qe"), F.col("e")))


#: Rows that share a slice and are compared in one task; more of them are dealt into blocks that meet two by two.
SLICE_MOST = 16_384


def _planes(symbols_: np.ndarray) -> np.ndarray:
    """Symbols (a row for each vector) as planes of packed words: (planes, rows, words). Places differ where a plane does."""
    codes = np.unique(symbols_, return_inverse=True)[1].reshape(symbols_.shape).astype(np.uint32)
    n = max(1, int(codes.max(initial=0)).bit_length())
    padded = np.zeros((len(codes), -(-codes.shape[1] // 64) * 64), np.uint32)
    padded[:, : codes.shape[1]] = codes
    return np.stack([np.packbits((padded >> p & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for p in range(n)])


def _plane_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((a.shape[1], b.shape[1]), np.uint8 if a.shape[2] <= 3 else np.int32)
    for c in range(a.shape[2]):
        differ = a[0, :, c, None] ^ b[0, :, c]
        for p in range(1, len(a)):
            differ |= a[p, :, c, None] ^ b[p, :, c]
        total += np.bitwise_count(differ)
    return total


def _slice_pairs(most: int, cuts: list[tuple[int, int]]) -> Callable:
    """Pairs within ``most`` of the rows of one slice k or of two blocks of it (id, s, k, side), each at the first slice in
    which the two agree."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, side, k = part.column("id").to_numpy(), part.column("side").to_numpy(), part.column("k")[0].as_py()
        s = matrix(part.column("s").combine_chunks()).astype(np.int64)
        planes, out = _planes(s), []
        one, two = np.flatnonzero(side <= 0), np.flatnonzero(side > 0)
        if not side.any():  # one block with itself
            two = one
        for lo, hi in tiles(len(one), len(two)):
            i, j = np.nonzero(_plane_distances(planes[:, one[lo:hi]], planes[:, two]) <= most)
            i, j = one[lo + i], two[j]
            if one is two:
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
            else:
                i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
            differ = s[i] != s[j]
            first = np.all([differ[:, a:b].any(axis=1) for a, b in cuts[:k]], axis=0) if k else np.ones(len(i), bool)
            out.append((ids[i[first]], ids[j[first]], differ[first].sum(axis=1)))
        a, b, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": pa.array(a), "b": pa.array(b), "dist": pa.array(d.astype(np.int64))}).cast(pa.schema([("a", part.schema.field("id").type), ("b", part.schema.field("id").type), ("dist", pa.int64())]))

    return run


def similar_pairs(rows: DataFrame, radius: float, d: int, pieces: int | None = None) -> DataFrame:
    """Pairs (a, b, dist) of symbol vectors (id, s) with dist / d below the radius, each once, a before b.

    Exact without comparing all pairs: with at most t differing places, vectors agree in one of t + 1 slices, so the rows
    that share a slice are compared in one task, as packed words. Slices of more than SLICE_MOST rows are dealt into blocks,
    and each two of those are one task. Where that needs more slices than ``d`` allows, blocks of all rows are compared.
    """
    most = ceil(radius * d) - 1  # the largest number of places below the radius
    if most < 0:
        empty = rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("bigint").alias("dist")).limit(0)
        return empty
    slices = most + 1 if pieces is None else pieces
    left, right = (rows.select(F.col("id").alias(n), F.col("s").alias(f"s{n}")) for n in "ab")
    if slices <= d // 4:
        ship(rows.sparkSession)
        size = d // slices
        cuts = [(k * size, (k + 1) * size if k < slices - 1 else d) for k in range(slices)]
        keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.slice("s", a + 1, b - a)).alias("h")) for k, (a, b) in enumerate(cuts)])
        keyed = rows.where("id IS NOT NULL AND s IS NOT NULL").select("id", "s", F.inline(keys))
        many = keyed.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE_MOST)
        dealt = keyed.join(F.broadcast(many.select("k", "h", F.ceil(F.col("n") / SLICE_MOST).alias("of"))), ["k", "h"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "of")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)))
        dealt = dealt.select("id", "s", "k", "h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"))
        kind = rows.schema["id"].dataType.simpleString()
        return dealt.groupBy("k", "h", "low", "high").applyInArrow(_slice_pairs(most, cuts), f"a {kind}, b {kind}, dist bigint")
    both = pair_queries(left, right).where("a < b").select("a", "b", symbols.distance(F.col("sa"), F.col("sb")).alias("dist"))
    return both.where(F.col("dist") <= most)


def nearest_entity(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(cid, cs) with the nearest of (id, s): the first of equally near ones."""
    both = pair_queries(entities, candidates).select("cid", "id", symbols.distance(F.col("cs"), F.col("s")).alias("dist"))
    return both.groupBy("cid").agg(F.min(F.struct("dist", "id")).alias("m")).select("cid", F.col("m.id").alias("id"), F.col("m.dist").alias("dist"))
