"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three characters (code points; letters in lower case, marks as they are, everything else a
blank), hashed to FEATURES places. Document frequencies are counted over all documents that may be learnt from. Weights are
trained with follow-the-regularised-leader (per-coordinate steps) under an elastic net: the L1 part keeps only weights that
earn their place. A temperature, fitted on learning rows that the weights did not see, calibrates the probability.

Learning rows are at most SAMPLE labelled documents of each language by hash order, outside the held-out fold, read
whole, for the LANGUAGES most frequent languages (of equally frequent ones those first in order). They are chosen by hashes of id
and text, so rows that repeat both count once and texts are not shuffled. Prediction covers every text whole.
Defined cases: a null text and one without a letter (Unicode category L) get ``und`` with score 0, and so does every text
where no label can be learnt; a single label is predicted with score 1; of equally likely languages the first in order
wins; repeated rows are predicted alike; a row whose id is null is not held out and may be learnt from; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import LETTER, char_classes
from .quality import held_out
from .session import ship

FEATURES = 1 << 15
GRAM = 3
#: Learning rows of each language, and languages that are learnt.
SAMPLE, LANGUAGES = 600, 1000
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(1)
def folds() -> np.ndarray:
    """The character that stands for each code point: lower case of letters, marks, or a blank."""
    import regex

    out = np.full(0x110000, 0x20, np.uint32)
    letters = np.flatnonzero(char_classes() == LETTER)
    out[letters] = letters
    for i in letters.tolist():
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    points = [i for i in range(0x300, 0x110000) if not 0xD800 <= i < 0xE000]
    for m in regex.finditer(r"\p{M}", "".join(map(chr, points))):
        out[points[m.start()]] = points[m.start()]
    return out


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of UTF-8 texts, and where each text starts among them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.searchsorted(lead, at)


def places(points: np.ndarray) -> np.ndarray:
    """Feature places of the grams of one, two and three characters that start at each character (3 x n)."""
    n = len(points)
    low = np.zeros(n + GRAM - 1, np.uint32)
    low[:n] = folds()[points]
    out = np.empty((GRAM, n), np.uint16)
    h = np.zeros(n, np.uint32)
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    for k in range(GRAM):
        h = (h ^ (low[k : k + n] + np.uint32(k + 1))) * _MIX[k]
        h ^= h >> np.uint32(15)
        out[k] = (h * np.uint32(0x27D4EB2F)) >> shift
    return out


def counts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Feature counts of each text of a block, and whether it has a letter."""
    points, first = characters(data, at)
    every = places(points)
    letters = np.concatenate(([0], np.cumsum(char_classes()[points] == LETTER)))[first]
    for s, e, some in zip(first[:-1].tolist(), first[1:].tolist(), np.diff(letters).tolist(), strict=True):
        own = np.concatenate([every[k, s : max(s, e - k)] for k in range(GRAM)])  # no gram reaches beyond its text
        yield np.bincount(own, minlength=FEATURES), some > 0


def tf_idf(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequency, of length one."""
    x = np.log1p(count) * idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, count: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(count)
        x = np.log1p(count[used]) * self.idf[used]
        norm = np.sqrt(x @ x)
        return (x / norm if norm else x) @ self.weights[used] + self.bias

    def predict(self, count: np.ndarray) -> tuple[str, float]:
        z = self.logits(count) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def train(rows: list[np.ndarray], labels: list[str], idf: np.ndarray, *, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 9) -> Model:
    """Follow the regularised leader over feature counts; every fifth row is kept for the temperature."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = [(np.flatnonzero(r), tf_idf(r, idf)[np.flatnonzero(r)]) for r in rows]
    n = len(languages)
    z, g2, w = np.zeros((FEATURES + 1, n)), np.zeros((FEATURES + 1, n)), np.zeros((FEATURES + 1, n))
    order = np.random.default_rng(seed).permutation(len(x))
    calibration, learning = order[::5], order[np.arange(len(order)) % 5 > 0]

    def proximal(i: np.ndarray) -> np.ndarray:
        own = z[i]
        free = np.abs(own) > l1
        return np.where(free, -(own - np.sign(own) * l1) / ((beta + np.sqrt(g2[i])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for r in learning if len(learning) else order:
            i, v = x[r]
            i, v = np.append(i, FEATURES), np.append(v, 1.0)
            w[i] = own = proximal(i)
            s = v @ own
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = v[:, None] * p
            old = g2[i]
            z[i] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * own
            g2[i] = old + g * g
    everything = np.arange(FEATURES + 1)
    w = proximal(everything)
    model = Model(languages, idf, w[:FEATURES], w[FEATURES])
    if n > 1 and len(calibration):
        raw = np.stack([model.logits(rows[r]) for r in calibration])

        def loss(t: float) -> float:
            s = raw / t
            top = s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(s)), y[calibration]]).mean()) + 1e-4 * np.log(t) ** 2

        grid = np.exp(np.linspace(-3, 3, 121))
        model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, and the number of texts; summed up in each partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, _, data, at in K.blocks(batch.column(0)):
                for row, _ in counts(data, at):
                    total += row > 0
                    n += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["feature", "n"])

    sums = docs.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most FEATURES + 1 rows
    out = np.zeros(FEATURES, np.int64)
    n = 0
    for feature, k in sums:
        if feature < 0:
            n = k
        else:
            out[feature] = k
    return out, n


def learning_rows(own: DataFrame) -> DataFrame:
    """(lang, key): at most SAMPLE keys of each language of ``own`` (lang, key, text), those of smallest hash. Rows are thinned
    out by a threshold for each language first, so that no task gets a language's rows."""
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("key").alias("keys")).orderBy(F.desc("keys"), "lang").limit(LANGUAGES).collect()
    h = F.pmod("key", F.lit(1 << 40))
    most = own.sparkSession.createDataFrame([(r[0], int(min(1.0, (2 * SAMPLE + 200) / r[1]) * (1 << 40))) for r in sizes], "lang string, most bigint")
    thin = own.select("lang", "key").join(F.broadcast(most), "lang").where(h <= F.col("most")).select("lang", "key").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "key"))
    return thin.withColumn("r", rank).where(F.col("r") <= SAMPLE).select("lang", "key")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model, or None where there is no labelled row."""
    ship(docs.sparkSession)
    own = docs.where(~F.coalesce(held_out(id_col), F.lit(False))).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    own = own.where("lang IS NOT NULL AND text IS NOT NULL")
    picked = own.join(F.broadcast(learning_rows(own)), ["lang", "key"]).select("lang", "key", "text")  # SAMPLE rows of each of LANGUAGES languages

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, at in K.blocks(batch.column(2)):
                for row, _ in counts(data, at):
                    used = np.flatnonzero(row)
                    out.append(used.astype(np.uint16).tobytes() + row[used].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "key", "packed"])

    packed = picked.mapInArrow(features, "lang string, key bigint, packed binary").groupBy("lang", "key").agg(F.min("packed").alias("packed"))
    rows = sorted((r[0], r[1], bytes(r[2])) for r in packed.collect())  # at most FEATURES counts each
    if not rows:
        return None
    seen, n = frequencies(own)
    idf = np.log((1 + n) / (1 + seen)) + 1
    unpacked = []
    for _, _, raw in rows:
        k = len(raw) // 6
        count = np.zeros(FEATURES, np.int32)
        count[np.frombuffer(raw[: 2 * k], np.uint16)] = np.frombuffer(raw[2 * k :], np.uint32)
        unpacked.append(count)
    return train(unpacked, [r[0] for r in rows], idf)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    ship(docs.sparkSession)
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for _, _, data, at in K.blocks(batch.column(2)):
                for count, letters in counts(data, at):
                    name, p = model.predict(count) if model is not None and letters else (UNKNOWN, 0.0)
                    lang.append(name)
                    score.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_col).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
