"""Super-windows: the shared machinery of the two operators that remove repeated windows.

A window is ``width`` consecutive units (words or bytes) of one text. Its anchor is the k-mer in it whose hash is
smallest, the leftmost of equal ones, so equal windows have equal anchors at equal offsets. The consecutive windows of
a text that share an anchor's place make a super-window: one row stands for up to width - k + 1 windows. Super-windows
of equal content (128 bits of XXH3) form a class. A text is known by its id and a hash of its content, so rows that
repeat an id with another text are texts of their own.

1. ``paths`` lists the super-windows of all texts; classes that repeat within a block are combined there.
2. ``settle`` counts the rows of each anchor with sums before the shuffle and keeps the anchors of two rows or more. Where a
   class repeats, its windows are settled at once. Where an anchor has several classes, paths branch there, and single
   windows of the classes may still be equal.
3. ``fetch`` joins the branching rows with their texts by source coordinates, for the operator's own refinement.
4. ``cover`` gathers settled ranges by text and joins them with the texts.

Anchors of up to CROWDED rows are settled whole in one task. The rows of a more crowded one never meet: their classes are
summed up over the cluster, and ``single_windows`` compares the windows of different classes by sums of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import discard, join_by_weight, write_table

#: Rows of an anchor beyond which its windows are settled one by one over the cluster.
CROWDED = 4096
#: Crowded anchors up to this number are broadcast (24 bytes each); more of them are joined by a shuffle.
ANCHORS_MOST = 1 << 20
FULL, BRANCH, HOT = 1, 2, 3
PLACES = K.Rolling(101)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (a hash of the text), text."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))


def super_windows(values: np.ndarray, raw: memoryview, at: np.ndarray, width: int, k: int):
    """Anchor hash, two content hashes, text number, first window (within its text) and number of windows of each
    super-window of a block; ``values`` are its units as 64-bit numbers, ``raw`` their exact bytes (as many for each),
    ``at`` where its texts start."""
    n = len(values)
    if n < width:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    place = np.arange(n - k + 1)
    h = PLACES.ranges(PLACES.prefix(values), place, place + k)
    m = K.window_argmin(h, width - k + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = text[: n - width + 1]
    m[own != text[width - 1 :]] = -1
    cut = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (own[1:] != own[:-1]))))
    end = np.append(cut[1:], len(m))
    good = m[cut] >= 0
    start, end = cut[good], end[good]
    unit = raw.nbytes // n
    one, two = K.content_hashes(raw, start * unit, (end - 1 + width) * unit)
    return h[m[start]], one, two, own[start], start - at[own[start]], end - start


_PATHS = "kind tinyint, a bigint, u bigint, v bigint, doc_id bigint, t bigint, start bigint, size int, times tinyint"


def paths(docs: DataFrame, units: Callable, width: int, k: int, by_source: bool) -> DataFrame:
    """The written table of super-windows of ``docs`` (doc_id, t, text). ``units(data, at)`` gives a block's values, their
    bytes and where its texts start. ``by_source``: a window is settled by a text of smaller id, else by any other place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, at in K.blocks(batch.column(2)):
                a, u, v, text, start, size = super_windows(*units(data, at), width, k)
                if not len(a):
                    continue
                doc = ids[lo:hi][text]
                order = np.lexsort((np.arange(len(u)), v, u))
                head = np.concatenate(([True], (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])))
                first = order[np.flatnonzero(head)]
                back = np.empty(len(u), np.int64)
                back[order] = np.cumsum(head) - 1
                count = np.bincount(back)
                kind = np.zeros(len(a), np.int8)
                if by_source:
                    low = np.full(len(first), np.iinfo(np.int64).max)
                    np.minimum.at(low, back, doc)
                    kind[doc > low[back]] = FULL
                    times = np.ones(len(a), np.int64)
                else:
                    kind[count[back] > 1] = FULL
                    times = count[back]
                    kind[first[count > 1]] = 4  # settled, and sent on for all of its class in this block
                cols = [kind, a.view(np.int64), u.view(np.int64), v.view(np.int64), doc, tags[lo:hi][text], start, size.astype(np.int32), np.minimum(times, 2).astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "u", "v", "doc_id", "t", "start", "size", "times"])

    return write_table(docs.where("doc_id IS NOT NULL").select("doc_id", "t", "text").mapInArrow(run, _PATHS), "paths")


_SETTLED = "kind tinyint, a bigint, doc_id bigint, t bigint, start bigint, size int, wanted boolean"


def settle(table: DataFrame, by_source: bool) -> DataFrame:
    """The written table of settled ranges (kind FULL) and of branching rows (BRANCH, or HOT at crowded anchors):
    a, doc_id, t, start, size, wanted (whether the row's own windows are still open)."""
    sent = table.where(F.col("kind") != FULL)
    anchors = write_table(sent.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    crowded = anchors.where(F.col("n") > CROWDED)
    n_crowded = crowded.count()
    rows = _settle_whole(sent.join(anchors.where(F.col("n") <= CROWDED).select("a").hint("shuffle_hash"), "a", "left_semi"), by_source)
    if n_crowded:
        rows = rows.unionByName(_settle_crowded(sent, crowded.select("a"), n_crowded, by_source))
    local = table.where(F.col("kind").isin(FULL, 4)).select(F.lit(FULL).cast("tinyint").alias("kind"), "a", "doc_id", "t", "start", "size", F.lit(False).alias("wanted"))
    found = write_table(rows.unionByName(local), "settled")
    discard(anchors)
    discard(table)
    return found


def _settle_crowded(sent: DataFrame, crowded: DataFrame, n_crowded: int, by_source: bool) -> DataFrame:
    """``settle`` for the rows of crowded anchors, by sums over the classes and joins by weight."""
    side = F.broadcast(crowded) if n_crowded <= ANCHORS_MOST else crowded
    rows = write_table(sent.join(side, "a", "left_semi"), "crowded")
    classes = rows.groupBy("a", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("places"), F.min("doc_id").alias("low"), F.min_by(F.struct("doc_id", "t", "start"), F.struct("doc_id", "t", "start")).alias("lead"))
    classes = write_table(classes, "classes")
    # nodes with one class do not branch; there are no more of them than of crowded anchors
    degrees = classes.groupBy("a").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("a", F.lit(True).alias("branches"))
    degrees = F.broadcast(degrees) if n_crowded <= ANCHORS_MOST else degrees
    classes = classes.join(degrees, "a", "left").withColumn("branches", F.coalesce("branches", F.lit(False)))
    each = join_by_weight(rows, classes, ["a", "u", "v"], "n", rows.count())
    if by_source:
        done = F.col("doc_id") > F.col("low")
        lead = ~done
    else:
        done = F.col("places") > 1
        lead = F.struct("doc_id", "t", "start") == F.col("lead")
    each = each.withColumn("done", done).withColumn("first", lead)
    whole = each.where("done AND kind <> 4").select(F.lit(FULL).cast("tinyint").alias("kind"), "a", "doc_id", "t", "start", "size", F.lit(False).alias("wanted"))
    opened = each.where("branches AND first").select(F.lit(HOT).cast("tinyint").alias("kind"), "a", "doc_id", "t", "start", "size", (~F.col("done")).alias("wanted"))
    return whole.unionByName(opened)


def _settle_whole(sent: DataFrame, by_source: bool) -> DataFrame:
    """``settle`` for anchors of at most CROWDED rows, each whole in one task."""

    def group(rows: np.ndarray) -> pa.RecordBatch:
        """Rows of whole anchors, sorted by anchor, class, id and start."""
        a, u, v, doc, tag, start, size, times, kind = rows
        head = np.concatenate(([True], (a[1:] != a[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
        cls = np.cumsum(head) - 1
        anchor = np.cumsum(np.concatenate(([True], a[1:] != a[:-1]))) - 1
        classes = np.bincount(anchor, weights=head).astype(np.int64)[anchor]
        lead = np.flatnonzero(head)[cls]  # the class's first row, of its smallest id
        if by_source:
            settled = doc > doc[lead]
            rep = ~settled
        else:
            settled = np.bincount(cls, weights=times)[cls] > 1
            rep = head
        branching = rep & (classes > 1)
        pick, full = np.flatnonzero(branching), np.flatnonzero(settled & (kind != 4))
        every = np.concatenate([full, pick])
        kinds = np.concatenate([np.full(len(full), FULL), np.full(len(pick), BRANCH)])
        want = np.concatenate([np.zeros(len(full), bool), (branching & ~settled)[pick]])
        cols = [kinds.astype(np.int8), a[every], doc[every], tag[every], start[every], size[every].astype(np.int32), want]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "doc_id", "t", "start", "size", "wanted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from whole_groups(batches, group)

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = sent.select("a", "u", "v", "doc_id", "t", "start", F.col("size").cast("bigint"), F.col("times").cast("bigint"), F.col("kind").cast("bigint"))
    return keyed.repartition(n, "a").sortWithinPartitions("a", "u", "v", "doc_id", "t", "start").mapInArrow(run, _SETTLED)


def whole_groups(batches: Iterator[pa.RecordBatch], group: Callable, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Call ``group`` with arrays of numeric columns, cut where the first column changes, about ``most`` rows at a time."""
    parts: list[np.ndarray] = []
    have = 0
    for batch in batches:
        if not len(batch):
            continue
        parts.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]))
        have += len(batch)
        if have >= most:
            held = np.concatenate(parts, axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1]))
            if cut:
                yield group(held[:, :cut])
            parts, have = [held[:, cut:]], 0 if cut else have // 2
    if parts:
        held = np.concatenate(parts, axis=1)
        if held.shape[1]:
            yield group(held)


_FETCHED = "a bigint, kind tinyint, doc_id bigint, t bigint, start bigint, size int, wanted boolean, body binary"


def fetch(docs: DataFrame, settled: DataFrame, cut: Callable) -> DataFrame:
    """Branching rows with what ``cut(data, at, texts, starts, sizes)`` takes from their texts as ``body`` (binary):
    a join of the rows, gathered by text, with the texts."""
    rows = settled.where(F.col("kind") != FULL).groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "size", "a", "kind", "wanted")).alias("rows"))
    joined = docs.join(rows.hint("shuffle_hash"), ["doc_id", "t"]).select("doc_id", "t", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, at in K.blocks(batch.column(2)):
                part = lists.slice(lo, hi - lo)
                flat = part.flatten()
                text = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(part).to_numpy())
                start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
                bodies = cut(data, at, text, start, size)
                cols = [flat.field("a"), flat.field("kind"), pa.array(ids[lo:hi][text]), pa.array(tags[lo:hi][text]), pa.array(start), pa.array(size), flat.field("wanted"), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["a", "kind", "doc_id", "t", "start", "size", "wanted", "body"])

    return joined.mapInArrow(run, _FETCHED)


_RANGES = "doc_id bigint, t bigint, start bigint, size int"


def refine(rows: DataFrame, decide: Callable, most: int = 60_000) -> DataFrame:
    """Ranges (doc_id, t, start, size) of windows that ``decide(anchor, doc, wanted, sizes, bodies)`` finds repeated among
    an anchor's rows: for each window of each row in turn, whether it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0

        def ranges(table: pa.Table) -> pa.RecordBatch:
            a, doc, tag, start, size = (table.column(c).to_numpy() for c in ("a", "doc_id", "t", "start", "size"))
            wanted = table.column("wanted").to_numpy()
            hit = decide(a, doc, wanted, size, table.column("body"))
            row = np.repeat(np.arange(len(a)), size)
            hit &= wanted[row]
            inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            begin = hit & ~(np.concatenate(([False], hit[:-1])) & (inner > 0))
            last = np.concatenate((inner[1:] == 0, [True]))
            stop = hit & ~(np.concatenate((hit[1:], [False])) & ~last)
            b, e = np.flatnonzero(begin), np.flatnonzero(stop)
            cols = [doc[row[b]], tag[row[b]], start[row[b]] + inner[b], (e - b + 1).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "t", "start", "size"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            windows += int(batch.column("size").to_numpy().sum())
            if windows >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                a = table.column("a").to_numpy()
                cut = int(np.searchsorted(a, a[-1]))
                if cut:
                    yield ranges(table.slice(0, cut))
                    rest = table.slice(cut)
                    held = rest.to_batches()
                    windows = 0
        if held:
            yield ranges(pa.Table.from_batches(held).combine_chunks())

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where(F.col("kind") == BRANCH).repartition(n, "a").sortWithinPartitions("a").mapInArrow(run, _RANGES)


def single_windows(rows: DataFrame, hashes: Callable, by_source: bool) -> DataFrame:
    """The same for crowded anchors: a row for each window, summed by content before the shuffle.
    ``hashes(sizes, bodies)`` gives the two content hashes of each window of each row in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                size = part.column("size").to_numpy()
                one, two = hashes(size, part.column("body"))
                row = np.repeat(np.arange(len(size)), size)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                cols = [one.view(np.int64), two.view(np.int64), part.column("doc_id").to_numpy()[row], part.column("t").to_numpy()[row], part.column("start").to_numpy()[row] + inner]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(part.column("wanted").to_numpy(zero_copy_only=False)[row])], ["one", "two", "doc_id", "t", "start", "wanted"])

    hot = rows.where(F.col("kind") == HOT)
    total = hot.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = hot.mapInArrow(run, "one bigint, two bigint, doc_id bigint, t bigint, start bigint, wanted boolean")
    if not total:
        return each.select("doc_id", "t", "start", F.lit(1).alias("size")).where(F.lit(False))
    each = write_table(each, "windows")
    sums = each.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    found = join_by_weight(each.where("wanted"), write_table(sums, "window-sums"), ["one", "two"], "n", total)
    return (found.where("low < doc_id") if by_source else found).select("doc_id", "t", "start", F.lit(1).alias("size"))


def cover(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, text, starts, sizes: each text with its settled ranges of windows (null without any)."""
    own = ranges.groupBy("doc_id", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    return docs.join(own.hint("shuffle_hash"), ["doc_id", "t"], "left").select("doc_id", "text", "starts", "sizes")


def ranges_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null is empty."""
    length = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(length)))
