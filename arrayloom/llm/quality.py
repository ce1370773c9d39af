"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over every byte of a text. Their rectified activations are averaged within overlapping chunks of
256 bytes (a step of 128, the whole text covered); a hidden layer judges each chunk, the largest value of each hidden
unit over all chunks is kept, and a logistic unit combines them into one probability. Filters, byte embedding and
layers are trained by back-propagation; a final scaling fits the probability to the classes' real shares.

Learning uses at most SAMPLE_PER_CLASS labelled documents of each class, by hash order, from outside the held-out fold, and
of those the ones of at most LEARN_BYTES bytes, read whole; that bounds what the driver holds. Scoring covers every text
whole.
Defined cases: null and empty texts get the score of a text without evidence; without labels of both classes every
score is the share of label 1 (0.5 without any label); of repeated labels the smallest counts, of several texts of one
id one is learnt from (the smallest), and each is scored by itself; a row whose id is null is scored, and not held out;
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import hash_sample, ship

CELL = 128
WIDTH = 4
#: Labelled rows of each class that the network learns from.
SAMPLE_PER_CLASS = 700
#: Bytes of the longest text that it learns from.
LEARN_BYTES = 1 << 16
#: Bytes of average text that a chunk's average is shrunk towards, for short texts.
PRIOR_BYTES = 64.0
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


@dataclass
class Network:
    """Weights; ``embed`` and ``filters`` make up a table of filter responses for each byte at each offset."""

    embed: np.ndarray  # 256 x E
    filters: np.ndarray  # WIDTH x E x F
    bias: np.ndarray  # F
    mean: np.ndarray  # F, average response
    scale: np.ndarray  # F
    hidden: np.ndarray  # F x H
    hidden_bias: np.ndarray  # H
    out: np.ndarray  # H
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, seed: int = 5, e: int = 8, f: int = 16, h: int = 24) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 1, (256, e)).astype(np.float32), rng.normal(0, 0.35, (WIDTH, e, f)).astype(np.float32), np.zeros(f, np.float32),
            np.zeros(f, np.float32), np.ones(f, np.float32), rng.normal(0, 0.4, (f, h)).astype(np.float32), np.full(h, -0.5, np.float32), np.full(h, -0.2, np.float32), 2.0,
        )

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to pairs of bytes, for the first and the second two offsets."""
        t = self.tables()
        f = t.shape[2]
        return (t[0][:, None] + t[1][None] + self.bias).reshape(-1, f), (t[2][:, None] + t[3][None]).reshape(-1, f)


def layout(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in cells of CELL bytes, padded with zeros: the bytes, where each text's cells start, and bytes per cell."""
    size = np.diff(at)
    cells = (size + WIDTH - 1) // CELL + 1
    first = np.concatenate(([0], np.cumsum(cells)))
    padded = np.zeros(int(first[-1]) * CELL + WIDTH, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first[:-1] * CELL - at[:-1], size)] = data
    number = np.arange(int(first[-1])) - np.repeat(first[:-1], cells)
    return padded, first, np.clip(np.repeat(size, cells) - number * CELL, 0, CELL)


def responses(padded: np.ndarray, cells: np.ndarray, count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rectified filter responses at each byte of the given cells; zero on padding."""
    place = cells[:, None] * CELL + np.arange(CELL)
    two = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    act = pairs[0][two[place]]
    act += pairs[1][two[place + 2]]
    np.maximum(act, 0, out=act)
    short = np.flatnonzero(count[cells] < CELL)
    act[short] *= (np.arange(CELL) < count[cells[short]][:, None])[:, :, None]
    return act


def chunk_sums(padded: np.ndarray, first: np.ndarray, count: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the chunk that starts at each cell: summed responses, bytes, and whether it counts (the last cell of a
    longer text is part of the chunk before it)."""
    n = len(count)
    sums = np.empty((n, pairs[0].shape[1]), np.float32)
    lot = 256
    for lo in range(0, n, lot):
        own = np.arange(lo, min(lo + lot, n))
        sums[lo : lo + lot] = responses(padded[lo * CELL : (lo + len(own)) * CELL + WIDTH], own - lo, count[lo : lo + lot], pairs).sum(axis=1)
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    both, size = sums.copy(), count.astype(np.float32)
    joined = np.flatnonzero(~last)
    both[joined] += sums[joined + 1]
    size[joined] += count[joined + 1]
    alone = np.zeros(n, bool)
    alone[first[:-1]] = True
    return both, size, ~last | alone


def judge(net: Network, sums: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised chunk averages and hidden activations."""
    z = ((sums + PRIOR_BYTES * net.mean) / (size + PRIOR_BYTES)[:, None] - net.mean) / net.scale
    h = np.maximum(z @ net.hidden + net.hidden_bias, 0)
    h[~counts] = 0
    return z, h


def logits(net: Network, data: np.ndarray, at: np.ndarray, pairs=None) -> np.ndarray:
    """The network's raw output for each text of a block."""
    padded, first, count = layout(data, at)
    sums, size, counts = chunk_sums(padded, first, count, pairs or net.pairs())
    _, h = judge(net, sums, size, counts)
    return np.maximum.reduceat(h, first[:-1], axis=0) @ net.out + net.out_bias


def score(net: Network, data: np.ndarray, at: np.ndarray, pairs=None) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * logits(net, data, at, pairs).astype(np.float64) + net.shift, -60, 60)))


def train(texts: list[bytes], labels: np.ndarray, share: float, *, epochs: int = 8, seed: int = 5, rate: float = 0.01) -> Network:
    """Learn a network; ``share`` is label 1's share among all labelled rows, which the probabilities are fitted to."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias")
    first_m = {k: np.zeros_like(getattr(net, k), dtype=np.float32) for k in names}
    second_m = {k: np.zeros_like(getattr(net, k), dtype=np.float32) for k in names}
    sizes = np.array([len(t) for t in texts])
    held = [layout(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    step, batch = 0, 32

    def gather(own: np.ndarray):
        padded = np.concatenate([held[i][0][:-WIDTH] for i in own] + [np.zeros(WIDTH, np.uint8)])
        first = np.concatenate(([0], np.cumsum([len(held[i][2]) for i in own])))
        return padded, first, np.concatenate([held[i][2] for i in own])

    for epoch in range(epochs):
        probe = rng.permutation(len(texts))[:200]
        padded, first, count = gather(probe)
        sums, size, counts = chunk_sums(padded, first, count, net.pairs())
        full = counts & (size >= CELL) if (counts & (size >= CELL)).any() else counts & (size > 0) if (size > 0).any() else counts
        average = sums[full] / np.maximum(size[full], 1)[:, None]
        net.mean, net.scale = average.mean(axis=0), np.maximum(average.std(axis=0), 1e-2)
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            padded, first, count = gather(own)
            pairs = net.pairs()
            sums, size, counts = chunk_sums(padded, first, count, pairs)
            z, h = judge(net, sums, size, counts)
            top = np.stack([h[s:e].argmax(axis=0) + s for s, e in zip(first[:-1], first[1:], strict=True)])
            pooled = np.take_along_axis(h, top, axis=0)
            raw = pooled @ net.out + net.out_bias
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            grads = {"out": pooled.T @ error + 1e-4 * net.out, "out_bias": error.sum()}
            dpool = error[:, None] * net.out * (pooled > 0)
            dh = np.zeros_like(h)
            np.add.at(dh, (top, np.arange(h.shape[1])[None, :]), dpool)
            used = np.flatnonzero(np.abs(dh).sum(axis=1))
            dh = dh[used]
            grads |= {"hidden": z[used].T @ dh, "hidden_bias": dh.sum(axis=0)}
            dsum = (dh @ net.hidden.T) / net.scale / (size[used] + PRIOR_BYTES)[:, None]
            dcell = np.zeros_like(sums)
            np.add.at(dcell, used, dsum)
            inner = used[~np.isin(used, first[1:] - 1)]
            np.add.at(dcell, inner + 1, dsum[np.isin(used, inner)])
            cells = np.flatnonzero(np.abs(dcell).sum(axis=1))
            act = responses(padded, cells, count, pairs)
            dact = ((act > 0) * dcell[cells][:, None, :]).reshape(-1, act.shape[2])
            place = (cells[:, None] * CELL + np.arange(CELL)).reshape(-1)
            dtable = np.stack([np.stack([np.bincount(padded[place + w], dact[:, k], 256) for k in range(dact.shape[1])], axis=1) for w in range(WIDTH)]).astype(np.float32)
            grads |= {"bias": dact.sum(axis=0), "embed": np.einsum("wbf,wef->be", dtable, net.filters), "filters": np.einsum("be,wbf->wef", net.embed, dtable)}
            step += 1
            for k, g in grads.items():
                first_m[k] = 0.9 * first_m[k] + 0.1 * g
                second_m[k] = 0.99 * second_m[k] + 0.01 * g * g
                move = rate * (0.5 ** (epoch / 3)) * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second_m[k] / (1 - 0.99**step)) + 1e-8)
                setattr(net, k, np.asarray(getattr(net, k) - move, np.float32) if k != "out_bias" else float(net.out_bias - move))
    raw = np.concatenate([logits(net, np.frombuffer(t, np.uint8), np.array([0, s])) for t, s in zip(texts, sizes, strict=True)]).astype(np.float64)
    net.slope, net.shift = fit_scale(raw, labels, np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum())))
    return net


def fit_scale(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least weighted log loss, by Newton's steps with a slight pull towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([(weight * (p - labels) * raw).sum() + 1e-3 * (a - 1), (weight * (p - labels)).sum() + 1e-3 * b])
        v = weight * p * (1 - p)
        hess = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        move *= min(1.0, 1.0 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """The network, or a constant score where one class has no row."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.min("quality").alias("quality")).where(~held_out(id_col))
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes))) if sizes else 0.5
    share = sizes[1] / (sizes[0] + sizes[1])
    chosen = [hash_sample(known.where(F.col("quality") == q), id_col, SAMPLE_PER_CLASS, sizes[q]) for q in (0, 1)]
    picked = chosen[0].union(chosen[1]).select(F.col(id_col).alias("_id"), F.col("quality").alias("_quality"))  # bounded by SAMPLE_PER_CLASS
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text).where(F.octet_length("_text") <= LEARN_BYTES).join(F.broadcast(picked), "_id")
    rows = sorted(rows.groupBy("_id", "_quality").agg(F.min("_text").alias("_text")).select("_id", "_text", "_quality").collect())
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() == y.max():
        return float(share)
    return train([r[1].encode() for r in rows], y, float(share))


def scores(net: Network | float, column: pa.Array) -> np.ndarray:
    """The score of each text of a column."""
    if not isinstance(net, Network):
        return np.full(len(column), float(net))
    pairs = net.pairs()
    found = [score(net, data, at, pairs) for _, _, data, at in K.blocks(column)]
    return np.concatenate(found) if found else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    ship(docs.sparkSession)
    net = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_col).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    ship(docs.sparkSession)
    net = fit(docs, labels, id_col=id_col, text_col=text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(net, batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
