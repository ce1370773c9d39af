"""SimHash near-duplicate groups, found by the generalised pigeonhole principle.

Fingerprints are 64 bits from word shingles. Equal fingerprints are one node. The 64 bits are dealt into groups of
correlated bits; each group g gets a threshold t(g) with sum(t(g) + 1) = radius + 1, so that two fingerprints within
the radius differ in at most t(g) bits of some group. Thresholds come from dynamic programming over candidate counts
estimated on a bounded sample. Each fingerprint is filed under the keys that its groups reach; fingerprints that
share a key are compared. A walk over a key's members takes every member within the radius of one already reached out
of the rest, so a dense group costs about its size and yields a spanning forest, not its pairs.

A key that too many fingerprints share is filed anew by slices of the bits that it leaves open, as often as needed, so every
group that a task holds is bounded.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other. Repeated rows and ties add
nothing. A row whose id is null names no group: its group is that of the smallest other id, or null without one.
Columns other than the id and the text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .session import hash_sample, join_by_weight, ship, write_table

SEED = 42
BITS = 64
#: Fingerprints that the bit statistics and the estimates of candidates are taken from; a bound of the driver's memory.
SAMPLE = 4096
#: A key with more members than this is filed anew under finer keys.
FINE = 4096


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text's bytes: a bit is set where over half of the shingles' XXH64 have it set."""
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        parts = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    total, lot = np.zeros(BITS, np.int64), 1 << 14
    for i in range(0, len(hashes), lot):
        bits = np.unpackbits(hashes[i : i + lot].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int((2 * total > len(hashes)).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", tagged: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint; with ``tagged`` also t, a hash of the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.buffers(batch.column(1))
            view = memoryview(data)
            found = [fingerprint(bytes(view[s:e]), shingle) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cols = [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "t"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(id_col, text_col, *[F.xxhash64(text_col).alias("_t")] * tagged)
    return own.mapInArrow(run, f"doc_id {kind}, fp bigint" + ", t bigint" * tagged)


def correlated_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into ``m`` groups of about equal size: each takes, next to its first bit, the bits that agree
    with it or oppose it most often in the sample."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    if len(bits) > 1:
        spread = bits - bits.mean(axis=0)
        norm = np.sqrt((spread**2).sum(axis=0))
        tie = np.abs(spread.T @ spread) / np.maximum(np.outer(norm, norm), 1e-9)
    else:
        tie = np.zeros((BITS, BITS))
    free, out = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def project(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed."""
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def probes(size: int, threshold: int) -> np.ndarray:
    """Masks of at most ``threshold`` of ``size`` bits; none for a threshold of -1."""
    found = [sum(1 << b for b in some) for k in range(threshold + 1) for some in combinations(range(size), k)]
    return np.array(found, np.uint64)


def filed(size: int, threshold: int) -> np.ndarray:
    """Masks under which a fingerprint is filed and probes: two values within the threshold share a key when one is
    filed under ceil(t/2) changed bits and the other under floor(t/2); filing both under the larger serves each."""
    return probes(size, (threshold + 1) // 2) if threshold >= 0 else np.zeros(0, np.uint64)


def estimate(sample: np.ndarray, group: list[int], threshold: int, total: int) -> float:
    """Estimated rows and comparisons for each fingerprint of ``total`` when a group has a threshold: the filed keys,
    and other fingerprints that lie within the threshold in the group."""
    if threshold < 0:
        return 0.0
    size = len(group)
    keys = len(filed(size, threshold))
    near = 0.0
    if len(sample) > 1:
        values = project(sample, group)
        a, b = values, np.roll(values, 1 + len(values) // 3)
        share = np.mean(np.bitwise_count(a ^ b) <= threshold)
        floor = sum(1 for _ in probes(size, threshold)) / 2.0 ** min(size, 1000)
        near = max(share, floor) * total
    return 4.0 * keys + near


def allocate(sample: np.ndarray, groups: list[list[int]], radius: int, total: int) -> tuple[list[int], float]:
    """Thresholds of the groups (each -1 to radius) with sum(t + 1) = radius + 1, of least estimated cost, by dynamic
    programming over the groups and the sum so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        costs = [estimate(sample, group, t, total) for t in range(-1, radius + 1)]
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, radius + 1 - used):
                option = (cost + costs[t + 1], [*chosen, t])
                if used + t + 1 not in after or option < after[used + t + 1]:
                    after[used + t + 1] = option
        best = after
    return best[radius + 1][1], best[radius + 1][0]


def plan(sample: np.ndarray, total: int, radius: int = 3) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds of least estimated cost over several numbers of groups."""
    options = []
    for m in range(1, radius + 2):
        groups = correlated_groups(sample, m)
        if m == 1 and radius > 1:
            continue  # a whole fingerprint under a threshold has too many keys
        chosen, cost = allocate(sample, groups, radius, total)
        options.append((cost, m, groups, chosen))
    _, _, groups, chosen = min(options)
    return groups, chosen


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within the radius: each walk takes what it reaches out of the rest."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[i]) <= radius
            if near.any():
                got = rest[near].tolist()
                out += [(i, j) for j in got]
                front += got
                rest = rest[~near]
    return out


def open_bits(path: int, radius: int) -> list[list[int]]:
    """The slices of the bits that a path of refilings leaves open. A path is a number in base radius + 2: its digits,
    from the first, are one more than the slices that were taken."""
    digits = []
    while path:
        path, digit = divmod(path, radius + 2)
        digits.append(digit - 1)
    free = list(range(BITS))
    for digit in reversed(digits):
        taken = set(free[digit :: radius + 1])
        free = [b for b in free if b not in taken]
    return [free[i :: radius + 1] for i in range(radius + 1)]


_KEYED = "key bigint, path bigint, node bigint, fp bigint"


def links(nodes: DataFrame, groups: list[list[int]], thresholds: list[int], radius: int) -> DataFrame:
    """(a, b): links that connect what lies within the radius. ``nodes`` has node bigint and fp bigint, distinct."""
    parts = [(g, group, filed(len(group), t)) for g, (group, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            for g, group, masks in parts:
                keys = K.mix((project(fps, group)[:, None] ^ masks[None, :]).reshape(-1) + np.uint64(g << 60 | g + 1))
                take = np.repeat(np.arange(len(fps)), len(masks))
                for lo in range(0, len(keys), 100_000):
                    at = slice(lo, lo + 100_000)
                    own = pa.array(take[at])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(np.zeros(len(own), np.int64)), batch.column(0).take(own), batch.column(1).take(own)], ["key", "path", "node", "fp"])

    keyed = nodes.select("node", "fp").mapInArrow(file, _KEYED)
    found = None
    while True:
        # a group of b open bits has at most 2**b fingerprints and each round closes a slice of them, so rounds end
        walked = write_table(_walk(keyed, radius, FINE), "links")
        own = walked.where("path IS NULL").select(F.col("node").alias("a"), F.col("fp").alias("b"))
        found = own if found is None else found.union(own)
        keyed = walked.where("path IS NOT NULL")
        if keyed.isEmpty():
            return found.distinct()


def _walk(keyed: DataFrame, radius: int, fine: int) -> DataFrame:
    """Links among the members of each key (node, fp: the two nodes; key and path null). A key with more than ``fine`` members
    comes back instead: its members under finer keys, one for each of radius + 1 slices of the bits that are open,
    since two fingerprints within the radius agree in one. Little more than that many members are held at once."""

    def links_of(rows: np.ndarray) -> pa.RecordBatch:
        keys, _, nodes_, fps = rows
        prints = fps.view(np.uint64)
        edges: list[np.ndarray] = []
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius] if len(two) else two
        edges.append(np.stack([nodes_[near], nodes_[near + 1]], axis=1))
        for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = forest(prints[s : s + n], radius)
            if own:
                edges.append(nodes_[s : s + n][np.array(own)])
        both = np.unique(np.sort(np.concatenate(edges), axis=1), axis=0)
        none = pa.nulls(len(both), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "path", "node", "fp"])

    def refiled(rows: np.ndarray) -> pa.RecordBatch:
        keys, paths, nodes_, fps = rows
        out: list[list[np.ndarray]] = [[], []]
        nodes_out, prints_out = [], []
        for path in np.unique(paths).tolist():
            own = paths == path
            for i, bits in enumerate(open_bits(path, radius)):
                if bits or i == 0:
                    out[0].append(K.mix(K.mix(keys[own].view(np.uint64) + np.uint64(i + 1)) ^ project(fps[own].view(np.uint64), bits)).view(np.int64))
                    out[1].append(np.full(int(own.sum()), path * (radius + 2) + i + 1))
                    nodes_out.append(nodes_[own])
                    prints_out.append(fps[own])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (*out, nodes_out, prints_out)], ["key", "path", "node", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowd = np.zeros((4, 0), np.int64), None
        for batch in batches:
            if not len(batch):
                continue
            rows = np.array([batch.column(i).to_numpy() for i in range(4)])
            if crowd is not None:  # more of the crowded key
                n = int(np.searchsorted(rows[0], crowd, "right"))
                if n:
                    yield refiled(np.ascontiguousarray(rows[:, :n]))
                rows = rows[:, n:]
                if not rows.shape[1]:
                    continue
                crowd = None
            held = np.concatenate([held, rows], axis=1)
            keys, sizes = np.unique(held[0], return_counts=True)
            if (sizes > fine).any():
                many = np.repeat(sizes > fine, sizes)
                yield refiled(np.ascontiguousarray(held[:, many]))
                crowd = keys[-1] if sizes[-1] > fine else None
                held = held[:, ~many]
            cut = held.shape[1] if crowd is not None else int(np.searchsorted(held[0], held[0, -1]))
            done, held = held[:, :cut], held[:, cut:]
            if done.shape[1]:
                yield links_of(np.ascontiguousarray(done))
        if held.shape[1]:
            yield links_of(np.ascontiguousarray(held))

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, _KEYED)


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """fp, n (rows that have it), its group and component_id for each fingerprint of the written (doc_id, fp, ...)."""
    nodes = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    total = nodes.count()
    sample = np.array([r[0] for r in hash_sample(nodes.select("fp"), "fp", SAMPLE, total).collect()], np.int64).view(np.uint64)
    groups, thresholds = plan(sample, total, radius)
    # a fingerprint is its own node; a component's id is the smallest one of its fingerprints' rows
    found = connected_components(links(nodes.select(F.col("fp").alias("node"), "fp"), groups, thresholds, radius))
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    linked = join_by_weight(linked.select("fp", "component"), lows, ["component"], "members", total).withColumnRenamed("component_id", "joined")
    return nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("group"), F.coalesce("joined", "low").alias("component_id"))


def near_duplicates(docs: DataFrame, *, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links of at most
    ``radius`` differing bits."""
    prints = write_table(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    out = join_by_weight(prints, write_table(_grouped(prints, radius), "groups"), ["fp"], "n", prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group, with all its columns: that of the smallest id, of several rows with this
    id the one whose text has the smallest hash, and of rows that are equal in id and text one. Rows without an id stay."""
    tag = F.xxhash64(text_col)
    keyed = docs.where(F.col(id_col).isNotNull())
    prints = write_table(fingerprints(keyed, shingle=shingle, id_col=id_col, text_col=text_col, tagged=True), "fingerprints")
    each = join_by_weight(prints, write_table(_grouped(prints, radius), "groups"), ["fp"], "n", prints.count())
    first = each.where("doc_id = component_id").groupBy("group", "doc_id", "t").agg(F.count(F.lit(1)).alias("rows"))
    first = first.groupBy("group").agg(F.min(F.struct("t", "doc_id", "rows")).alias("first")).select("first.*")
    first = write_table(first, "kept")
    once = _semi(keyed, first.where("rows = 1"), id_col, tag)
    out = once
    if not first.where("rows > 1").isEmpty():
        out = once.unionByName(_semi(keyed, first.where("rows > 1"), id_col, tag).withColumn("_near_t", tag).dropDuplicates([id_col, "_near_t"]).drop("_near_t"))
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def _semi(docs: DataFrame, keys: DataFrame, id_col: str, tag) -> DataFrame:
    keys = keys.select(F.col("doc_id").alias("_near_id"), F.col("t").alias("_near_t")).hint("shuffle_hash")
    return docs.join(keys, (docs[id_col] == F.col("_near_id")) & (tag == F.col("_near_t")), "left_semi")
