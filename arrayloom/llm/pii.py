"""Personal data: exact rules for four kinds, and a character-level bidirectional LSTM with CRF transitions.

The rules give base spans, which always stay. The network, trained in numpy from labelled spans, adds spans that the
rules miss. Every kind has digits or an at sign, so windows of WINDOW characters, half overlapping, are laid over all
of a text that lies within REACH characters of one or in one word with it; the rest of a text can hold no span. Windows are decoded by Viterbi; a
character takes its label from the window in whose middle it lies most, and spans are then read off the whole text.
An added span must have its kind's marks and must not touch a base span.

Learning uses at most LEARN_WINDOWS windows of about SAMPLE documents (both by hash order), labelled with their base spans, and
SYNTHETIC invented ones, which also hold forms that the rules do not know. Windows are cut and labelled on the executors.
Defined cases: null and empty texts have no spans and hashes of the empty string; offsets count code points; repeated
rows give a row each; ids may be null; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import hash_sample, ship, write_table

KINDS = ("email", "ip", "card", "phone")
WINDOW, REACH = 80, 24
#: Documents whose windows may be learnt from, windows that are, and invented lines beside them.
SAMPLE, LEARN_WINDOWS, SYNTHETIC = 3000, 500, 900
LABELS = 1 + 2 * len(KINDS)  # outside, then first and later characters of each kind
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_SPACE = re.compile(r"\s")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fail the kind's test are dropped."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def codes(text: str) -> np.ndarray:
    """Characters as small numbers: ASCII as it is, one for what lies beyond; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points, 1).astype(np.int64)


class Tagger:
    """Embedding, an LSTM in each direction, label scores and CRF transitions."""

    NAMES = ("embed", "wf", "bf", "wb", "bb", "out", "out_bias", "trans")

    def __init__(self, seed: int = 11, e: int = 12, h: int = 16):
        rng = np.random.default_rng(seed)
        self.h = h
        self.embed = rng.normal(0, 0.5, (128, e))
        self.wf, self.wb = (rng.normal(0, 0.3, (e + h, 4 * h)) for _ in range(2))
        self.bf, self.bb = np.zeros(4 * h), np.zeros(4 * h)
        self.bf[h : 2 * h] = self.bb[h : 2 * h] = 1.0  # the forget gate starts open
        self.out, self.out_bias = rng.normal(0, 0.3, (2 * h, LABELS)), np.zeros(LABELS)
        self.trans = np.zeros((LABELS, LABELS))
        self.allowed = np.zeros((LABELS, LABELS))
        for k in range(len(KINDS)):
            bad = [i for i in range(LABELS) if i not in (1 + 2 * k, 2 + 2 * k)]
            self.allowed[bad, 2 + 2 * k] = -1e4  # a later character follows its own kind
        self.start = np.where((np.arange(LABELS) % 2 == 0) & (np.arange(LABELS) > 0), -1e4, 0.0)
        self.start[2::2] = -2.0  # a window may begin within a span

    def _lstm(self, x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
        """x: time x batch x e; the states, and what the way back needs."""
        n, h = x.shape[1], self.h
        state, cell, states, kept = np.zeros((n, h)), np.zeros((n, h)), [], []
        for t in range(len(x)):
            both = np.concatenate([x[t], state], axis=1)
            a = both @ w + b
            gates, g = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            old, cell = cell, f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            states.append(state)
            kept.append((both, i, f, o, g, old, tc))
        return np.stack(states), kept

    def _lstm_back(self, dstates: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = w.shape[0] - self.h
        dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1]), np.zeros((*dstates.shape[:2], e))
        dstate, dcell = np.zeros(dstates.shape[1:]), np.zeros(dstates.shape[1:])
        for t in range(len(kept) - 1, -1, -1):
            both, i, f, o, g, old, tc = kept[t]
            ds = dstates[t] + dstate
            dcell = dcell + ds * o * (1 - tc * tc)
            da = np.concatenate([dcell * g * i * (1 - i), dcell * old * f * (1 - f), ds * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
            dw += both.T @ da
            db += da.sum(axis=0)
            dboth = da @ w.T
            dx[t], dstate, dcell = dboth[:, :e], dboth[:, e:], dcell * f
        return dx, dw, db

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores: time x batch x label, for codes of time x batch."""
        v = self.embed[x]
        ahead, _ = self._lstm(v, self.wf, self.bf)
        back, _ = self._lstm(v[::-1], self.wb, self.bb)
        return np.concatenate([ahead, back[::-1]], axis=2) @ self.out + self.out_bias

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best labels by Viterbi, time x batch."""
        em = self.emissions(x)
        trans = self.trans + self.allowed
        best, way = em[0] + self.start, []
        for t in range(1, len(em)):
            every = best[:, :, None] + trans
            way.append(every.argmax(axis=1))
            best = every.max(axis=1) + em[t]
        labels = [best.argmax(axis=1)]
        rows = np.arange(x.shape[1])
        for w in reversed(way):
            labels.append(w[rows, labels[-1]])
        return np.stack(labels[::-1])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the label paths of a batch, and its gradients."""
        n_t, n = x.shape
        v = self.embed[x]
        ahead, kept_f = self._lstm(v, self.wf, self.bf)
        back, kept_b = self._lstm(v[::-1], self.wb, self.bb)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        em = both @ self.out + self.out_bias
        trans = self.trans + self.allowed

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)

        alpha = np.empty_like(em)
        alpha[0] = em[0] + self.start
        for t in range(1, n_t):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + em[t]
        beta = np.zeros_like(em)
        for t in range(n_t - 2, -1, -1):
            beta[t] = lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        rows = np.arange(n)
        dem = np.exp(alpha + beta - log_z[None, :, None])
        dtrans = np.zeros_like(trans)
        gold = self.start[y[0]] + em[0, rows, y[0]]
        for t in range(1, n_t):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (em[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(axis=0)
            np.add.at(dtrans, (y[t - 1], y[t]), -1.0)
            gold += trans[y[t - 1], y[t]] + em[t, rows, y[t]]
        for t in range(n_t):
            dem[t, rows, y[t]] -= 1
        dem /= n
        dboth = dem @ self.out.T
        dxf, dwf, dbf = self._lstm_back(dboth[:, :, : self.h], kept_f, self.wf)
        dxb, dwb, dbb = self._lstm_back(dboth[::-1, :, self.h :], kept_b, self.wb)
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, x.reshape(-1), (dxf + dxb[::-1]).reshape(-1, self.embed.shape[1]))
        flat = both.reshape(-1, 2 * self.h)
        found = {"embed": dembed, "wf": dwf, "bf": dbf, "wb": dwb, "bb": dbb, "out": flat.T @ dem.reshape(-1, LABELS), "out_bias": dem.sum(axis=(0, 1)), "trans": dtrans / n}
        return float((log_z - gold).mean()), found

    def learn(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over windows of codes and labels (batch x time); the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        s = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step, told = 0, []
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                loss, grads = self.gradients(x[own].T, y[own].T)
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    setattr(self, k, getattr(self, k) - rate * 0.5 ** (epoch / 5) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8))
            told.append(float(np.mean(losses)))
        return told


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges of a text within REACH characters of a digit or an at sign, or in one word (without white space) with it."""
    out: list[list[int]] = []
    head = end = 0  # the last mark's word
    for m in _MARK.finditer(text):
        if m.start() >= end:
            head = m.start()
            while head > end and not text[head - 1].isspace():
                head -= 1
        if m.end() > end:
            space = _SPACE.search(text, m.end())
            end = space.start() if space else len(text)
        s, e = min(head, max(0, m.start() - REACH)), max(end, min(len(text), m.end() + REACH))
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def windows(text: str) -> list[tuple[int, int]]:
    """Half overlapping windows over the regions of a text."""
    out = []
    for s, e in regions(text):
        while e - s > WINDOW:
            out.append((s, s + WINDOW))
            s += WINDOW // 2
        out.append((s, e))
    return out


def predict(tagger: Tagger, texts: list[str], lot: int = 512) -> list[list[Span]]:
    """The network's spans in each text: windows are decoded together, then reconciled over each whole text."""
    spans: list[list[Span]] = [[] for _ in texts]
    todo = [(i, s, e) for i, t in enumerate(texts) for s, e in windows(t)]
    label: dict[int, dict[int, tuple[int, int]]] = {}
    for lo in range(0, len(todo), lot):
        own = todo[lo : lo + lot]
        x = np.zeros((WINDOW, len(own)), np.int64)
        for j, (i, s, e) in enumerate(own):
            x[: e - s, j] = codes(texts[i][s:e])
        found = tagger.decode(x)
        for j, (i, s, e) in enumerate(own):
            mine = label.setdefault(i, {})
            for p in np.flatnonzero(found[: e - s, j]).tolist():
                mine.setdefault(s + p, (-1, 0))
            for p in [q for q in range(s, e) if q in mine]:
                depth = min(p - s, e - 1 - p)
                if depth >= mine[p][0]:
                    mine[p] = (depth, int(found[p - s, j]))
            # a window that calls a character outside speaks for it too, where another has named it
    for i, mine in label.items():
        start, kind, last = -1, -1, -2
        for p in [*sorted(q for q, (_, y) in mine.items() if y), len(texts[i]) + 2]:
            y = mine[p][1] if p in mine else 0
            k = (y - 1) // 2 if y else -1
            if start >= 0 and (p != last + 1 or k != kind or (y % 2 == 1 and y)):
                spans[i].append((kind, start, last + 1))
                start = -1
            if y and start < 0:
                start, kind = p, k
            last = p
    return spans


def plausible(text: str, span: Span) -> bool:
    """Whether a span has the marks of its kind."""
    k, s, e = span
    own = text[s:e]
    digits = len(_digits(own))
    if k == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", own))
    if k == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", own)) and all(int(p) <= 255 for p in own.split("."))
    if k == 2:
        return 16 <= digits <= 19 and bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", own)) and luhn(_digits(own))
    return 8 <= digits <= 15 and bool(re.fullmatch(r"\(?[0-9][0-9 ().-]*[0-9]", own)) and any(c in own for c in " ()-.") and not re.search(r"[\s.()-]{3}", own)


def all_spans(tagger: Tagger, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text; a network's span is added where it touches no other."""
    base = [base_spans(t) for t in texts]
    every = []
    for text, own, more in zip(texts, base, predict(tagger, texts), strict=True):
        kept = list(own)
        for span in sorted(more, key=lambda x: (x[1], x[2])):
            k, s, e = span
            around = text[s - 1 : s] + text[e : e + 1]
            if plausible(text, span) and not any(c.isalnum() or c in "@+" for c in around) and not any(s < b and a < e for _, a, b in kept):
                kept.append(span)
        every.append(kept)
    return base, every


def labels_of(text: str, spans: list[Span]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for k, s, e in spans:
        out[s:e] = 2 + 2 * k
        out[s] = 1 + 2 * k
    return out


def synthetic(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Invented lines with labelled spans of every kind, and look-alikes without one."""
    rng = np.random.default_rng(seed)
    pick = lambda some: some[int(rng.integers(len(some)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("abcdefghijklmnoprstuvwz") for _ in range(int(rng.integers(2, 9))))

    def card() -> str:
        body = pick("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return pick(["", " ", "-"]).join(body[i : i + 4] for i in range(0, 16, 4))

    make = [
        lambda: f"{word()}{pick(['', '.', '_'])}{pick([word(), num(2)])}@{word()}{pick(['', num(1)])}.{pick(['com', 'org', 'net', 'example.com'])}",
        lambda: ".".join(str(int(rng.integers(1, 256))) for _ in range(4)),
        card,
        lambda: pick([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", *[f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"] * 3]),  # more of those that the rules do not know
    ]
    other = [lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(2)}", lambda: num(int(rng.integers(1, 12))), lambda: f"{word()}={num(3)}{word()}{num(4)}", lambda: f"AKIA{num(6)}{word().upper()}{num(4)}", lambda: f"{num(2)}.{num(2)}.", lambda: f"@{word()}", lambda: "".join(pick("0123456789abcdef") for _ in range(32))]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(rng.integers(1, 5)))), []
        for _ in range(int(rng.integers(1, 3))):
            k = int(rng.integers(0, 7))
            own = make[k]() if k < 4 else pick(other)()
            text += pick([" ", " ", "\n", ": "])
            if k < 4:
                spans.append((k, len(text), len(text) + len(own)))
            text += own + pick(["", ".", ",", ""]) + "".join(" " + word() for _ in range(int(rng.integers(0, 4))))
        out.append((text, spans))
    return out


def train(own: list[tuple[str, np.ndarray]], *, seed: int = 3) -> Tagger:
    """A tagger from labelled windows and synthetic ones."""
    rng, own = np.random.default_rng(seed), list(own)
    for text, spans in synthetic(seed, SYNTHETIC):
        s = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        own.append((text[s : s + WINDOW], labels_of(text, spans)[s : s + WINDOW]))
    x, y = np.zeros((len(own), WINDOW), np.int64), np.zeros((len(own), WINDOW), np.int64)
    for i, (text, mark) in enumerate(own):
        x[i, : len(text)], y[i, : len(text)] = codes(text), mark
    tagger = Tagger(seed)
    tagger.learn(x, y)
    return tagger


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger for the documents."""
    ship(docs.sparkSession)
    own = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = own.count()
    if total > SAMPLE:
        own = own.where(F.pmod("key", F.lit(1 << 40)) < int(SAMPLE / total * (1 << 40)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _MARK.search(text):
                    mark = labels_of(text, base_spans(text)).astype(np.uint8)
                    places = windows(text)
                    for lo in range(0, len(places), 10_000):
                        some = places[lo : lo + 10_000]
                        cols = [pa.array([key] * len(some), pa.int64()), pa.array([s for s, _ in some], pa.int64()), pa.array([text[s:e] for s, e in some]), pa.array([mark[s:e].tobytes() for s, e in some], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["key", "start", "text", "labels"])

    found = write_table(own.mapInArrow(cut, "key bigint, start bigint, text string, labels binary").distinct(), "pii-windows")
    found = found.withColumn("h", F.xxhash64("key", "start", "text"))
    rows = sorted((r.h, r.text, bytes(r.labels)) for r in hash_sample(found, "h", LEARN_WINDOWS).collect())
    return train([(text, np.frombuffer(mark, np.uint8)) for _, text, mark in rows])


def find(docs: DataFrame, *, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans for every document. Without a tagger one is
    learnt from the documents."""
    ship(docs.sparkSession)
    tagger = tagger or fit(docs, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = _spans_of(tagger, batch.column(1))
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            sums = pa.array([hashlib.sha256(spell(own).encode()).hexdigest() for own in base])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sums, pa.array([spell(x) for x in every])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def _spans_of(tagger: Tagger, column: pa.Array) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base and all spans of a column's texts; texts without a digit or an at sign have none."""
    n = len(column)
    base: list[list[Span]] = [[] for _ in range(n)]
    every: list[list[Span]] = [[] for _ in range(n)]
    marked, texts = [], []
    for i in range(n):
        text = column[i].as_py() or ""
        if _MARK.search(text):
            marked.append(i)
            texts.append(text)
    for i, b, e in zip(marked, *all_spans(tagger, texts), strict=True):
        base[i], every[i] = b, e
    return base, every


def redact(docs: DataFrame, *, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets, and their length renewed."""
    ship(docs.sparkSession)
    tagger = tagger or fit(docs, id_col=id_col, text_col=text_col)
    place = docs.columns.index(text_col)
    size = docs.columns.index(length_col) if length_col in docs.columns else -1
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, every = _spans_of(tagger, batch.column(place))
            texts = batch.column(place).to_pylist()
            sizes = batch.column(size).to_pylist() if size >= 0 else []
            for i, spans in enumerate(every):
                if not spans:
                    continue
                text, out, last = texts[i], [], 0
                for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= last:
                        out += [text[last:s], f"<{KINDS[k].upper()}>"]
                    last = max(last, e)
                texts[i] = "".join([*out, text[last:]])
                if size >= 0:
                    sizes[i] = len(texts[i])
            cols = [batch.column(j) for j in range(len(names))]
            cols[place] = pa.array(texts, batch.column(place).type)
            if size >= 0:
                cols[size] = pa.array(sizes, batch.column(size).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
