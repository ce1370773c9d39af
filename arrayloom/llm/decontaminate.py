"""Benchmark decontamination by a positional inverted index of the training texts.

``build_index`` cuts documents into segments of about a megabyte and stores, for every term of a segment, the places
where it stands (a document-partitioned index, written as a table). A benchmark window is looked up in a segment by
its terms' lists, shifted by each term's offset and intersected from the rarest term on; ``phrase_matches`` gives exact
phrases, ``proximity_matches`` all terms within a span. The index is read once for each block of benchmark items;
blocks have a bounded number of words and are sent to the executors one after another.
Terms are compared by 64-bit hashes.

Words: A-Z is lower-cased, then runs of digits, a-z and characters beyond ASCII.
Defined cases: a null or empty text has no words and no hits; an item without words has no window; repeated items and
repeated windows count once for an item id, and an item whose id is null has none; repeated documents give a row each.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import ship, write_table

_SEED = 29
WINDOW = 8
#: Words of benchmark items that are sent to the executors at a time.
BLOCK_WORDS = 500_000
_INDEX = "segment string, doc_ids array<bigint>, word_at binary, terms binary, term_at binary, places binary"


def term_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block of texts, and for each text where its words start."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, at, K.WORD_ALNUM)
    return K.range_hashes(low, starts, ends, _SEED), first


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: a row for each segment, with its documents and the sorted places of each of its terms. A segment's
    name is drawn when it is written: equal segments have different names."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.blocks(batch.column(1)):
                terms, first = term_hashes(data, at)
                order = np.argsort(terms, kind="stable")
                ranked = terms[order]
                head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
                gaps = np.diff(order.astype(np.uint32), prepend=np.uint32(0))  # small within a term, wraps between terms
                ids = batch.column(0).slice(lo, hi - lo)
                row = [[uuid.uuid4().hex], [ids.cast(pa.int64()).to_pylist()], [first.astype(np.int64).tobytes()], [ranked[head].tobytes()], [head.astype(np.int64).tobytes()], [gaps.tobytes()]]
                kinds = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["segment", "doc_ids", "word_at", "terms", "term_at", "places"])

    return write_table(docs.select(id_col, text_col).mapInArrow(run, _INDEX), "postings")


class Segment:
    """A row of the index, opened."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.word_at = np.frombuffer(row["word_at"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        head = np.frombuffer(row["term_at"], np.int64)
        self.places = np.cumsum(np.frombuffer(row["places"], np.uint32), dtype=np.uint32)
        self.head = np.append(head, len(self.places))
        self.sizes = np.diff(self.head)
        self.keys = (np.repeat(np.arange(len(self.terms), dtype=np.uint64), self.sizes) << np.uint64(32)) | self.places

    @property
    def n_words(self) -> int:
        return int(self.word_at[-1])

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term, or -1 where the segment has none of it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def occurrences(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each numbered term, and which of them each place is of."""
        n = self.sizes[term]
        owner = np.repeat(np.arange(len(term)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.places[self.head[term][owner] + inner].astype(np.int64), owner

    def stands(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each numbered term stands at a place."""
        key = (term.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def one_document(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether [start, end) lies within one document."""
        fits = (start >= 0) & (end <= self.n_words)
        where = np.searchsorted(self.word_at, np.clip(start, 0, None), "right")
        return fits & (end <= self.word_at[np.minimum(where, len(self.word_at) - 1)])

    def phrases(self, phrases: np.ndarray, lot: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each occurrence of phrases of one length, given by the hashes of their terms."""
        numbers = self.find(phrases)
        live = np.flatnonzero((numbers >= 0).all(axis=1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.where(numbers[live] >= 0, self.sizes[numbers[live]], 0) if len(live) else np.zeros((0, phrases.shape[1]), np.int64)
        order = np.argsort(sizes, axis=1, kind="stable")  # the rarest term first
        load = np.cumsum(sizes.min(axis=1)) if len(live) else np.zeros(0)
        lo = 0
        while lo < len(live):
            hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + lot, "right")))
            ids, by = live[lo:hi], order[lo:hi]
            lead = by[:, 0]
            place, owner = self.occurrences(numbers[ids, lead])
            start = place - lead[owner]
            keep = self.one_document(start, start + phrases.shape[1])
            start, owner = start[keep], owner[keep]
            for k in range(1, phrases.shape[1]):
                if not len(start):
                    break
                slot = by[owner, k]
                keep = self.stands(numbers[ids[owner], slot], start + slot)
                start, owner = start[keep], owner[keep]
            found.append((ids[owner], start))
            lo = hi
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def near(self, phrases: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each span of length + slop words of one document that has every term, in any order."""
        numbers, span = self.find(phrases), phrases.shape[1] + slop
        out = []
        for p in np.flatnonzero((numbers >= 0).all(axis=1)).tolist():
            own = numbers[p]
            rare = own[np.argmin(self.sizes[own])]
            start = np.unique(self.occurrences(np.array([rare]))[0][:, None] - np.arange(span)[None, :])
            start = start[start >= 0]
            doc = np.searchsorted(self.word_at, start, "right") - 1
            stop = np.minimum(start + span, self.word_at[doc + 1])
            for term in own.tolist():
                low = np.uint64(term) << np.uint64(32)
                has = np.searchsorted(self.keys, low | stop.astype(np.uint64)) > np.searchsorted(self.keys, low | start.astype(np.uint64))
                start, stop = start[has], stop[has]
            out += [(p, s) for s in start.tolist()]
        both = np.array(out, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def item_windows(items: list[tuple[int, bytes]], window: int = WINDOW) -> dict[int, tuple[np.ndarray, list[list[int]]]]:
    """By length: the distinct windows (hashes of their terms) and the sorted ids of the items that have each. ``items``
    have runs of terms that overlap by a window less one."""
    owners: dict[int, dict[bytes, set[int]]] = {}
    for item, raw in items:
        n = len(raw) // 8
        size = min(window, n)
        for i in range(n - size + 1) if size else ():
            owners.setdefault(size, {}).setdefault(raw[8 * i : 8 * (i + size)], set()).add(item)
    return {size: (np.frombuffer(b"".join(own), np.uint64).reshape(-1, size), [sorted(x) for x in own.values()]) for size, own in owners.items()}


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of items of about BLOCK_WORDS words each, as hashes of their terms, collected one block at a time. The words
    are counted; an item of more than a piece's words is cut into pieces that overlap by a window less one word, so a
    block's size does not depend on the longest item."""
    ship(items.sparkSession)
    piece = max(window, min(BLOCK_WORDS // 8, 1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.blocks(batch.column(1)):
                terms, first = term_hashes(data, at)
                ids, own, bodies = batch.column(0).slice(lo, hi - lo).to_pylist(), [], []
                for item, s, e in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for p in range(s, max(s + 1, e - window + 1), piece) if e > s and item is not None else ():
                        own.append(item)
                        bodies.append(terms[p : min(e, p + piece + window - 1)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([len(x) // 8 for x in bodies], pa.int64()), pa.array(bodies, pa.binary())], ["item", "n", "body"])

    pieces = items.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "item bigint, n bigint, body binary")
    pieces = write_table(pieces, "items")
    n = 1 + int(pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BLOCK_WORDS
    for k in range(n):
        own = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k)
        yield [(r[0], bytes(r[1])) for r in own.select("item", "body").collect()]


def _search(index: DataFrame, windows: dict, finish: bool) -> DataFrame:
    """One block's hits for every document of the index: its address, and its digest or its raw hits."""
    shared = index.sparkSession.sparkContext.broadcast(windows)  # bounded by BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = shared.value
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                seg = Segment(row)
                n = len(seg.doc_ids)
                pairs: set[tuple[int, int]] = set()
                depth = np.zeros(seg.n_words + 1, np.int64)
                for size, (phrases, owners) in by_size.items():
                    which, start = seg.phrases(phrases)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + size, -1)
                    doc = np.searchsorted(seg.word_at, start, "right") - 1
                    for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                        pairs.update((d, item) for item in owners[w])
                hit = np.cumsum(depth[:-1]) > 0
                items: list[list[int]] = [[] for _ in range(n)]
                for d, item in pairs:
                    items[d].append(item)
                n_words = np.diff(seg.word_at)
                if finish:
                    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[seg.word_at])
                    cols = [pa.array(seg.doc_ids, pa.int64()), *digest(n_words, n_hit, items)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                else:
                    places = [np.packbits(hit[s:e]).tobytes() for s, e in zip(seg.word_at[:-1].tolist(), seg.word_at[1:].tolist(), strict=True)]
                    cols = [pa.array([row["segment"]] * n), pa.array(range(n), pa.int32()), pa.array(seg.doc_ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(places, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["segment", "slot", "doc_id", "n_words", "hits", "items"])

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" if finish else "segment string, slot int, doc_id bigint, n_words bigint, hits binary, items array<bigint>"
    return index.mapInArrow(run, schema)


def digest(n_words, n_hit, items: list[list[int]]) -> list[pa.Array]:
    """The result's columns after the id; ``items`` are the distinct item ids of each document."""
    sums = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
    count = [len(x) for x in items]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sums), pa.array([c >= 2 for c in count])]


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: n_words, n_hit (words inside an occurring window), n_items, items_sha256, contaminated
    (windows of two items or more)."""
    index = build_index(docs, id_col=id_col, text_col=text_col)
    parts, blocks = [], item_blocks(items, item_col, item_text)
    held = next(blocks)
    for block in blocks:
        parts.append(_search(index, item_windows(held), False))
        held = block
    if not parts:
        return _search(index, item_windows(held), True)
    parts.append(_search(index, item_windows(held), False))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            n_hit = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(h, np.uint8) for h in r["hits"]], axis=0)).sum()) if r["n_words"] else 0 for r in rows]
            found = [sorted({i for x in r["items"] for i in x}) for r in rows]
            cols = [batch.column(0), *digest([r["n_words"] for r in rows], n_hit, found)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    grouped = every.groupBy("segment", "slot", "doc_id", "n_words").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    return grouped.select("doc_id", "n_words", "hits", "items").mapInArrow(merge, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def keep_clean(docs: DataFrame, items: DataFrame, *, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which windows of fewer than ``least`` items stand, with all their columns. Documents are told apart by
    a hash of id and text, so rows with one id and different texts are judged by their own."""
    row = F.xxhash64(id_col, text_col)
    found = contamination(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), items, id_col="_row", text_col="_text")
    hit = write_table(found.where(F.col("n_items") >= least).select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return docs.join(hit, row == hit["_row"], "left_anti")


def _locate(index: DataFrame, phrases: dict[int, str], find) -> DataFrame:
    """Rows (doc_id, phrase_id, position) of what ``find`` gives for phrases of one length at a time."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for name, text in phrases.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        terms, _ = term_hashes(raw, np.array([0, len(raw)]))
        if len(terms):
            by_size.setdefault(len(terms), []).append((name, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                seg = Segment(row)
                for own in by_size.values():
                    which, start = find(seg, np.stack([t for _, t in own]))
                    doc = np.searchsorted(seg.word_at, start, "right") - 1
                    cols = [pa.array([seg.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array([own[w][0] for w in which.tolist()], pa.int64()), pa.array(start - seg.word_at[doc], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "phrase_id", "position"])

    return index.mapInArrow(run, "doc_id bigint, phrase_id bigint, position bigint")


def phrase_matches(index: DataFrame, phrases: dict[int, str]) -> DataFrame:
    """Every exact occurrence of each phrase: doc_id, phrase_id, position (a word's number in its document)."""
    return _locate(index, phrases, lambda seg, terms: seg.phrases(terms))


def proximity_matches(index: DataFrame, phrases: dict[int, str], slop: int) -> DataFrame:
    """Every span of a phrase's length plus ``slop`` words that has all of its terms, in any order."""
    return _locate(index, phrases, lambda seg, terms: seg.near(terms, slop))
