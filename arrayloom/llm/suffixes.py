"""Byte-level deduplication: suffixes grouped by their super-windows, then a merge that refines an interleave.

Repeated strings of ``width`` bytes are intervals of the suffix order whose members share a prefix of ``width`` bytes or
more. Suffixes whose whole super-window (see ``spans``) repeats are settled by its class, suffixes of an anchor that stands
once have no partner, and those at anchors where texts branch are merged, an anchor's together.

The merge reads eight bytes as one symbol. Shards are the branching rows of ranges of documents. Their interleave is
refined by rounds: each moves all suffixes one symbol to the left and sorts stably by that symbol, so the order
of the rounds before is kept, intervals split, and suffixes alone in an interval leave. What is together after width / 8
rounds is a repeated interval; how many rounds a suffix stays is its common prefix. Bytes are compared, not hashes.
It is the interleave refinement of a merge of Burrows-Wheeler transforms, over rows that still have their text in place of
the transforms: no shard is sorted in full (the README has the figures that decided this).

Defined cases: null and empty texts have no bytes; texts under ``width`` bytes keep all; rows that repeat an id count
as places of their own, and each is judged by its own text; a row whose id is null keeps all its bytes and removes none
elsewhere. Other columns play no part. Removed bytes may cut a character; the kept bytes are given as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import spans
from .session import discard, ship, write_table

WIDTH, KMER = 200, 64
#: Bytes that a round of the merge reads at once.
SYMBOL = 8
_VALUES = K.splitmix(77, 256)


def _bytes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, memoryview, np.ndarray]:
    return _VALUES[data], memoryview(np.ascontiguousarray(data)), at


def _strings(width: int):
    def cut(data: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        begin = at[text] + start
        return [raw[s:e] for s, e in zip(begin.tolist(), (begin + size + width - 1).tolist(), strict=True)]

    return cut


def _places(size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each row's windows start among the bytes of all rows."""
    return np.repeat(at[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _hashes(width: int):
    def both(size: np.ndarray, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = K.buffers(bodies)
        place = _places(size, at)
        return K.content_hashes(memoryview(data), place, place + width)

    return both


class Shard:
    """The suffixes that start ``width`` bytes behind the windows of some rows. ``symbols(r, some)`` are the eight bytes
    before the part of each that r rounds have sorted, as numbers that compare like the bytes."""

    def __init__(self, anchor: np.ndarray, place: np.ndarray, eights: np.ndarray, width: int):
        self.anchor, self.end, self.eights = anchor, place + width, eights

    def __len__(self) -> int:
        return len(self.anchor)

    def symbols(self, r: int, some: np.ndarray) -> np.ndarray:
        return self.eights[self.end[some] - SYMBOL * (r + 1)].byteswap()


def merge(shards: list[Shard], rounds: int) -> np.ndarray:
    """Merge shards by refining their interleave: the length of the longest common prefix of each window with any other
    of its anchor's, counted in bytes of whole symbols from its end. Windows are numbered shard by shard.

    The interleave begins shard by shard within each anchor. A round moves every suffix one symbol to the left and sorts the
    interleave stably by those symbols, so that it is in the order of all symbols read so far; neighbours that agree
    in the new symbol and were in one interval make an interval again. A suffix alone in its interval leaves.
    """
    total = sum(map(len, shards))
    common = np.zeros(total, np.int64)
    if not total:
        return common
    anchor = np.concatenate([s.anchor for s in shards])
    interleave = np.argsort(anchor, kind="stable")
    interval = np.cumsum(np.concatenate(([True], np.diff(anchor[interleave]) != 0)))
    sizes = np.cumsum([len(s) for s in shards])
    for r in range(rounds + 1):
        same = interval[1:] == interval[:-1]
        together = np.concatenate((same, [False])) | np.concatenate(([False], same))
        interleave, interval = interleave[together], interval[together]
        common[interleave] = SYMBOL * r
        if r == rounds or not len(interleave):
            return common
        symbol = np.empty(len(interleave), np.uint64)
        owner = np.searchsorted(sizes, interleave, "right")
        for i, shard in enumerate(shards):
            own = np.flatnonzero(owner == i)
            if len(own):
                symbol[own] = shard.symbols(r, interleave[own] - (sizes[i] - len(shard)))
        order = np.argsort(symbol, kind="stable")
        symbol, interval, interleave = symbol[order], interval[order], interleave[order]
        interval = np.cumsum(np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]))))
    return common


def _repeated(width: int, shard_bytes: int = 1 << 20):
    def decide(a: np.ndarray, doc: np.ndarray, wanted: np.ndarray, size: np.ndarray, bodies) -> np.ndarray:
        """Whether each window's bytes also start elsewhere among the rows."""
        bodies = bodies.combine_chunks() if isinstance(bodies, pa.ChunkedArray) else bodies
        data, at = K.buffers(bodies)
        data, at = data[at[0] : at[-1]], at - at[0]
        order = np.argsort(doc, kind="stable")  # a shard has the rows of a range of documents
        cut = np.searchsorted(np.cumsum(np.diff(at)[order]), np.arange(0, max(1, len(data)), shard_bytes))
        groups = [g for g in np.split(order, np.unique(cut[1:])) if len(g)]
        eights, ends = K.eights(data), np.cumsum(size)
        shards, numbers = [], []
        for rows in groups:
            n = size[rows]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            shards.append(Shard(np.repeat(a[rows], n), np.repeat(at[:-1][rows], n) + inner, eights, width))
            numbers.append(np.repeat((ends - size)[rows], n) + inner)
        out = np.zeros(int(size.sum()), bool)
        if numbers:
            out[np.concatenate(numbers)] = merge(shards, width // SYMBOL) == width
        return out

    return decide


def deduplicate(docs: DataFrame, *, width: int = WIDTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the kept bytes."""
    if width % SYMBOL or not 0 < kmer < width:
        raise ValueError(f"width must be a multiple of {SYMBOL} and larger than kmer")
    ship(docs.sparkSession)
    docs = spans.texts(docs, id_col, text_col)
    settled = spans.settle(spans.paths(docs, _bytes, width, kmer, False), False)
    rows = write_table(spans.fetch(docs, settled, _strings(width)), "branches")
    opened = spans.refine(rows, _repeated(width)).unionByName(spans.single_windows(rows, _hashes(width), False))
    opened = write_table(opened, "opened")
    discard(rows)
    whole = settled.where(settled["kind"] == spans.FULL).select("doc_id", "t", "start", "size")
    covered = spans.cover(docs, whole.unionByName(opened))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, where = spans.ranges_of(batch.column(2))
            sizes, _ = spans.ranges_of(batch.column(3))
            for lo, hi, data, at in K.blocks(batch.column(1)):
                text = np.repeat(np.arange(hi - lo), np.diff(where[lo : hi + 1]))
                own = slice(where[lo], where[hi])
                s = at[text] + starts[own]
                gone = K.covered(s, s + sizes[own] + width - 1, len(data))
                counts, removed, runs, sums, kept = [], [], [], [], []
                for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    flags = gone[i:j]
                    left = data[i:j][~flags].tobytes()
                    counts.append(j - i)
                    removed.append(int(flags.sum()))
                    runs.append(len(K.runs(flags)[0]))
                    sums.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
                cols = [batch.column(0).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in (counts, removed, runs)], pa.array(sums)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return covered.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
