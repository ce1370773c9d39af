"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash of the vocabulary: whole pre-tokens that are tokens already are resolved for a
block of texts at once. Tier two merges the other pre-tokens with a heap of ranked pairs over linked bytes; each
distinct pre-token is merged once and remembered by the Python worker, in a store of bounded size. Both look-ups go by a
64-bit hash and then compare the bytes; a pre-token whose hash is another's is merged by itself.

Defined cases: a null or empty text has no tokens; hashes of nothing are those of the empty string. Columns other than
the id and the text play no part. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .session import ship

_SEED = 71
_EMPTY = 0xFFFFFFFF
#: Merged pre-tokens that a worker's store may hold before it starts anew with those of the block at hand.
STORE_ENTRIES = 2_500_000
#: Bytes of pre-tokens that it may hold, likewise; a block's own always fit.
STORE_BYTES = 64 << 20
#: Code points with Unicode's White_Space property (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of 64-bit keys by hash and displace: as many slots as keys, one probe for a lookup."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        assert len(np.unique(keys)) == n, "keys must be distinct"
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        self.index = np.full(n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(first)
        taken = np.zeros(n, bool)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[first[b] : first[b + 1]]
            if not len(members):
                break
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = 0
            while True:
                tries = self._slots(keys[members], np.arange(d, d + 64)[:, None])
                ordered = np.sort(tries, axis=1)
                good = ~taken[tries].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    d, slots = d + int(np.argmax(good)), tries[np.argmax(good)]
                    break
                d += 64
            taken[slots], self.shift[b], self.index[slots] = True, d, members
        for (b, member), slot in zip(singles, np.flatnonzero(~taken), strict=True):
            self.shift[b], self.index[slot] = -1 - slot, member  # a free slot, named directly
        self.keys = keys[self.index] if n else keys

    def _slots(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (K.mix(keys ^ (d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, or -1."""
        if not self.n:
            return np.full(len(keys), -1)
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            mixed = K.mix(keys ^ (np.maximum(shift, 0).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        slots = np.where(shift < 0, -1 - shift, (mixed % np.uint64(self.n)).astype(np.int64))
        return np.where(self.keys[slots] == keys, self.index[slots], -1)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start()] : points[m.end() - 1] + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[WHITE_SPACE] = SPACE
    return out


def pre_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens of a block of texts (a pre-token ends where the next or its text ends), and for
    each text where its pre-tokens start among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(lead, at)] = True  # first characters of texts, and the end
    first = head[:n]
    space = kind == SPACE
    blank = points == 0x20
    last = head[1:]
    start = first.copy()
    start[1:] |= space[1:] & ~space[:-1]
    start[:-1] |= space[:-1] & ~last[:-1] & ~space[1:]
    start[1:] |= ~space[1:] & (kind[1:] != kind[:-1]) & ~blank[:-1]
    marks = np.flatnonzero((points == 0x27) & start)
    for i in marks.tolist():
        tail = points[i + 1 : i + 3].tolist()
        ends = int(np.argmax(last[i : i + 3])) if last[i : i + 3].any() else 3  # characters of the text after this one
        if tail and ends >= 1 and tail[0] in (0x73, 0x74, 0x6D, 0x64):
            size = 2
        elif len(tail) == 2 and ends >= 2 and tuple(tail) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            size = 3
        else:
            continue
        start[i + 1 : i + size] = False
        if i + size < n:
            start[i + size] |= kind[i + size] == LETTER or bool(first[i + size])
    where = lead[np.flatnonzero(start)]
    return where, np.searchsorted(where, at)


def merge(piece: bytes, pairs: list[int], ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: a heap yields the pair of lowest rank, leftmost first, over linked byte ranges.

    ``pairs`` has the rank of each pair of neighbouring bytes, or -1. Heap entries are integers: rank, start, end.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    bits = n.bit_length()
    low, wide = (1 << bits) - 1, 2 * bits
    after = list(range(1, n + 2))  # where the part that starts here ends
    before = list(range(-1, n))
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [r << wide | i << bits | i + 2 for i, r in enumerate(pairs) if r >= 0]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        end, i = entry & low, entry >> bits & low
        mid = after[i]
        if mid < 0 or after[mid] != end or mid == n:
            continue  # one of the two parts has been merged since
        after[i] = end
        after[mid] = -1
        if end < n:
            before[end] = i
            far = after[end]
            rank = get(piece[i:far])
            if rank is not None:
                push(heap, rank << wide | i << bits | far)
        if i:
            j = before[i]
            rank = get(piece[j:end])
            if rank is not None:
                push(heap, rank << wide | j << bits | end)
    out, i = [], 0
    while i < n:
        e = after[i]
        out.append(ranks[piece[i:e]])
        i = e
    return out


def perfect_hash(tokens: list[bytes]) -> PerfectHash:
    """The perfect hash of a vocabulary."""
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    return PerfectHash(K.range_hashes(data, np.concatenate(([0], ends[:-1])), ends, _SEED))


class Encoder:
    """Encodes and decodes blocks of texts with one vocabulary; keeps what it has merged, within STORE_ENTRIES."""

    def __init__(self, tokens: list[bytes], perfect: PerfectHash | None = None):
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.perfect = perfect or perfect_hash(tokens)
        self.lengths = np.array([len(t) for t in tokens])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pair = np.full(65536, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank
        spelt = [f"{i},".encode() for i in range(len(tokens))]
        self.spelt = np.frombuffer(b"".join(x.ljust(len(spelt[-1]), b"\0") for x in spelt), np.uint8).reshape(len(spelt), -1)
        self.spelt_len = np.array([len(x) for x in spelt])
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)
        self.text = np.zeros(0, np.uint8)  # the known pre-tokens themselves
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _merge(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> list[list[int]]:
        raw = data.tobytes()
        pair = self.pair[data[:-1].astype(np.int32) << 8 | data[1:]]
        return [merge(raw[s:e], pair[s : e - 1].tolist(), self.ranks) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _learn(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> None:
        found = self._merge(starts, ends, data)
        counts = np.fromiter(map(len, found), np.int32, len(found))
        place = len(self.pool) + np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.pool = np.concatenate([self.pool, np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))])
        size = ends - starts
        at = len(self.text) + np.cumsum(size) - size
        self.text = np.concatenate([self.text, *[data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]])
        into = np.searchsorted(self.known, keys)
        self.known, self.place, self.count = np.insert(self.known, into, keys), np.insert(self.place, into, place), np.insert(self.count, into, counts)
        self.at, self.size = np.insert(self.at, into, at), np.insert(self.size, into, size)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block of texts, and where each text's ids start."""
        starts, first = pre_tokens(data, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        keys = K.range_hashes(data, starts, ends, _SEED)
        ids = self.perfect.find(keys)
        ids[self.lengths[ids] != size] = -1
        hit = np.flatnonzero(ids >= 0)
        ids[hit[~K.same_bytes(data, starts[hit], self.bytes, self.starts[ids[hit]], size[hit])]] = -1
        missed = np.flatnonzero(ids < 0)
        counts = np.ones(len(starts), np.int64)
        odd = np.zeros(0, np.int64)  # pre-tokens whose hash is that of another one in the store
        if len(missed):
            own, one, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            spot = np.searchsorted(self.known, own)
            new = self.known[np.minimum(spot, len(self.known) - 1)] != own if len(self.known) else np.ones(len(own), bool)
            if new.any():
                if len(self.known) + int(new.sum()) > STORE_ENTRIES or len(self.text) + int(size[missed[one[new]]].sum()) > STORE_BYTES:
                    self._forget()
                    new[:] = True
                at_new = missed[one[new]]
                self._learn(own[new], starts[at_new], ends[at_new], data)
                spot = np.searchsorted(self.known, own)
            spot = spot[back]
            same = self.size[spot] == size[missed]
            same[same] = K.same_bytes(data, starts[missed[same]], self.text, self.at[spot[same]], size[missed[same]])
            odd, missed, spot = missed[~same], missed[same], spot[same]
            counts[missed] = self.count[spot]
        merged = self._merge(starts[odd], ends[odd], data) if len(odd) else []
        counts[odd] = [len(x) for x in merged]
        total = np.cumsum(counts)
        begin = total - counts
        out = np.empty(int(total[-1]), np.int32)
        hit = ids >= 0
        out[begin[hit]] = ids[hit]
        if len(missed):
            n, place = counts[missed], self.place[spot]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(begin[missed], n) + inner] = self.pool[np.repeat(place, n) + inner]
        for i, found in zip(odd.tolist(), merged, strict=True):
            out[begin[i] : begin[i] + len(found)] = found
        return out, np.append(begin, total[-1])[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.starts[ids] - end + size, size) + np.arange(int(size.sum()))]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the decimal ids, each with a comma behind it."""
        rows = self.spelt[ids].reshape(-1)
        return rows[rows > 0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, shared) -> Encoder:
    """The worker's encoder of a vocabulary, built once; ``shared`` is a broadcast of its tokens and perfect hash."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(*shared.value)
    return _ENCODERS[name]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each text by the rank file at ``path`` (read by the driver) and decode the ids again.

    Returns the id, n_tokens, ids_sha256 (hex of the decimal ids joined by commas), decoded_sha256 (hex of the decoded
    bytes), and with ``with_ids`` the ids themselves.
    """
    spark = docs.sparkSession
    ship(spark)
    tokens = load_ranks(path)
    name = hashlib.sha256(b"\0".join(tokens)).hexdigest()
    shared = spark.sparkContext.broadcast((tokens, perfect_hash(tokens)))  # as large as the vocabulary
    text = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, shared)
        for batch in batches:
            for lo, hi, data, at in K.blocks(batch.column(1)):
                ids, first = enc.encode(data, at)
                spelt, plain = memoryview(enc.spell(ids)), memoryview(enc.decode(ids))
                ends = np.concatenate(([0], np.cumsum(enc.spelt_len[ids])))[first].tolist()
                stops = np.concatenate(([0], np.cumsum(enc.lengths[ids])))[first].tolist()
                count = np.diff(first)
                one = [hashlib.sha256(spelt[s : max(s, e - 1)]).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                two = [hashlib.sha256(plain[s:e]).hexdigest() for s, e in zip(stops[:-1], stops[1:], strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(one), pa.array(two)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = text.schema[id_col].dataType.simpleString()
    return text.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
