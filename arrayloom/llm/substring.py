"""Substring deduplication over paths of word windows.

Windows of ``width`` consecutive words that follow each other in a text and share an anchor, a k-mer of words, are kept as
one row, a path (see ``spans``). Rows of equal content compact into one path whose source is its smallest document.
A join with the counted anchors drops the anchors that stand once and finds those where paths branch; only branching
paths are opened into single windows again: the source coordinates of a path are joined with the texts and
its windows compared there by 128 bits of XXH3, as paths are. A word goes if a window over it also starts in a document of
smaller id.

Defined cases: null and empty texts have no words; texts under ``width`` words keep all; rows that repeat an id never remove
each other, whether their texts are equal or not, and each row is judged by its own text; a row whose id is null keeps
all its words and removes none elsewhere. Words are compared by 64-bit hashes. Other columns play no part.
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

WIDTH, KMER = 50, 10


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, and where each text's words start."""
    starts, ends, first = K.words(data, at, K.WORD_BY_SPACE)
    return K.range_hashes(data, starts, ends, 53), first


def _units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, memoryview, np.ndarray]:
    values, first = _words(data, at)
    return values, memoryview(values).cast("B") if len(values) else memoryview(b""), first


def _edges(width: int):
    def cut(data: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The two hashes of each edge of each path."""
        _, raw, first = _units(data, at)
        begin = np.repeat(first[text] + start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        both = np.stack(K.content_hashes(raw, 8 * begin, 8 * (begin + width)), axis=1)
        ends = np.cumsum(size).tolist()
        return [both[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    return cut


def _hashes(size: np.ndarray, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = K.buffers(bodies)
    both = np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _smaller_source(a: np.ndarray, doc: np.ndarray, wanted: np.ndarray, size: np.ndarray, bodies: pa.Array) -> np.ndarray:
    """Whether each edge also starts in a document of smaller id."""
    one, two = _hashes(size, bodies)
    own = np.repeat(doc, size)
    order = np.lexsort((own, two, one))
    head = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    low = own[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
    out = np.empty(len(one), bool)
    out[order] = low < own[order]
    return out


def deduplicate(docs: DataFrame, *, width: int = WIDTH, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), and with ``with_text`` those."""
    ship(docs.sparkSession)
    docs = spans.texts(docs, id_col, text_col)
    settled = spans.settle(spans.paths(docs, _units, width, kmer, True), True)
    rows = write_table(spans.fetch(docs, settled, _edges(width)), "branches")
    opened = spans.refine(rows, _smaller_source).unionByName(spans.single_windows(rows, _hashes, True))
    opened = write_table(opened, "opened")
    discard(rows)
    whole = settled.where(settled["kind"] == spans.FULL).select("doc_id", "t", "start", "size")
    covered = spans.cover(docs, whole.unionByName(opened))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, where = spans.ranges_of(batch.column(2))
            sizes, _ = spans.ranges_of(batch.column(3))
            for lo, hi, data, at in K.blocks(batch.column(1)):
                begin, end, first = K.words(data, at, K.WORD_BY_SPACE)
                text = np.repeat(np.arange(hi - lo), np.diff(where[lo : hi + 1]))
                own = slice(where[lo], where[hi])
                s = first[text] + starts[own]  # never beyond the text, whose content the ranges were found in
                gone = K.covered(s, s + sizes[own] + width - 1, len(begin))
                raw = data.tobytes()
                counts, removed, sums, kept = [], [], [], []
                b, e, keep = begin.tolist(), end.tolist(), (~gone).tolist()
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    left = b" ".join([raw[b[x] : e[x]] for x in range(i, j) if keep[x]])
                    counts.append(j - i)
                    removed.append(int(gone[i:j].sum()))
                    sums.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        kept.append(left.decode())
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return covered.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
