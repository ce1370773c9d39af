"""Learning containers: organic writes of templates into saturating bytes, whose order matters.

One container's history is folded in order within a group; containers run in parallel. Templates and patterns are small
tables that every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Fixed value: one divided by the golden ratio.
GOLDEN = 0.618033988749895


def channel_of(j: Column, channels: int) -> Column:
    """The channel of a position."""
    turn = j * F.lit(GOLDEN)
    return F.least(F.lit(channels - 1), F.floor((turn - F.floor(turn)) * channels).cast("int"))


def xtrans(spark: SparkSession, d: int, channels: int) -> DataFrame:
    """(j, channel) for positions 0 to d - 1."""
    return spark.range(d).select(F.col("id").alias("j"), channel_of(F.col("id"), channels).alias("channel"))


def channel_positions(d: int, channels: int) -> list[np.ndarray]:
    j = np.arange(d)
    turn = j * GOLDEN
    channel = np.minimum(channels - 1, np.floor((turn - np.floor(turn)) * channels).astype(int))
    return [j[channel == c] for c in range(channels)]


def receptivity(v: Column) -> Column:
    return F.lit(1.0) - F.abs(v.cast("double")) / 127


def away(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    return np.trunc(x + np.copysign(0.5, x))


def organic_write(container: np.ndarray, template: np.ndarray, amplitude: float, positions: np.ndarray) -> float:
    """Write into the container; the share of the write that it had room for."""
    room = 1 - np.abs(container[positions].astype(float)) / 127
    full = amplitude * template[positions]
    actual = full * room
    container[positions] = np.minimum(np.maximum(away(container[positions] + actual), -128), 127)
    total = np.abs(full).sum()
    return float(np.abs(actual).sum() / total) if total > 1e-10 else 1.0


def organic_read(df: DataFrame, by: list[str], container: str = "c", template: str = "t") -> DataFrame:
    """(by, similarity, amplitude) over the positions of each group."""
    c, t = F.col(container).cast("double"), F.col(template).cast("double")
    sums = df.groupBy(*by).agg(F.sum(c * t).alias("dot"), F.sum(c * c).alias("e"), F.sum(t * t).alias("te"))
    return sums.select(*by, (F.col("dot") / F.greatest(F.sqrt("e") * F.sqrt("te"), F.lit(1e-10))).alias("similarity"), (F.col("dot") / F.greatest(F.col("te"), F.lit(1e-10))).alias("amplitude"))


def read_all(containers: DataFrame, templates: DataFrame, channels: int) -> DataFrame:
    """(id, concept, similarity, amplitude) for containers (id, j, c) and templates (concept, j, t): each concept at its
    channel's positions. Templates are a small table that joins by position."""
    own = templates.where(channel_of(F.col("j"), channels) == F.col("concept") % channels)
    return organic_read(containers.join(own, "j"), ["id", "concept"])


def residual(containers: DataFrame, templates: DataFrame, coefficients: DataFrame, channels: int) -> DataFrame:
    """(id, j, rest): containers (id, j, c) less each concept's coefficient (id, concept, k) times its template at the
    positions of its channel."""
    own = templates.where(channel_of(F.col("j"), channels) == F.col("concept") % channels).join(coefficients, "concept")
    known = own.groupBy("id", "j").agg(F.sum(F.col("k") * F.col("t")).alias("known"))
    return containers.join(known, ["id", "j"], "left").select("id", "j", (F.col("c").cast("double") - F.coalesce("known", F.lit(0.0))).alias("rest"))


def channel_masks(spark: SparkSession, d: int, channels: int) -> DataFrame:
    """(channel, mask): for each channel, which of the positions are its own."""
    each = xtrans(spark, d, channels)
    every = spark.range(channels).select(F.col("id").cast("int").alias("channel"))
    own = each.groupBy("channel").agg(F.collect_set("j").alias("own"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(d - 1).cast("bigint"))
    return every.join(own, "channel", "left").select("channel", F.transform(places, lambda j: F.coalesce(F.array_contains("own", j), F.lit(False))).alias("mask"))


def write_expr(container: Column, template: Column, amplitude: float) -> Column:
    """One write at all positions of two arrays, as a column."""
    return F.zip_with(container, template, lambda c, t: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(c + F.lit(amplitude) * t * receptivity(c)))).cast("int"))


@dataclass
class Plasticity:
    """Write counts and a clock; how much each concept may still change."""

    decay_window: int
    scale: float = 1.0
    counts: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    clock: int = 0

    def add(self) -> None:
        self.counts.append(0)
        self.last.append(self.clock)

    def record(self, i: int) -> float:
        self.clock += 1
        self.counts[i] += 1
        self.last[i] = self.clock
        return self.of(i)

    def of(self, i: int) -> float:
        if self.clock - self.last[i] > self.decay_window:
            return 0.3
        steps = ((2, min(1.0, max(0.15, 0.5 * self.scale))), (5, min(1.0, max(0.3, 0.8 * self.scale))), (20, 1.0), (50, 0.5), (200, 0.2))
        return next((v for most, v in steps if self.counts[i] <= most), 0.1)


@dataclass
class Wal:
    """Registered templates, their channels, and running coefficients."""

    d: int
    channels: int
    templates: list[np.ndarray] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.positions = channel_positions(self.d, self.channels)
        self._orthogonal: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def register(self, concept: int, template) -> int:
        self._orthogonal.clear()
        self.templates.append(np.asarray(template, float))
        self.coefficients.append(0.0)
        self.ids.append(concept)
        return len(self.ids) - 1

    def orthogonal(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The template less its projections on the others, one after the other, and those; worked out once while the
        templates stay."""
        if i not in self._orthogonal:
            self._orthogonal[i] = self._projected(i)
        return self._orthogonal[i]

    def _projected(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        out, shares = self.templates[i].copy(), np.zeros(len(self.ids))
        for k, t in enumerate(self.templates):
            norm = t @ t
            if k != i and norm >= 1e-10:
                shares[k] = out @ t / norm
                out = out - shares[k] * t
        return out, shares

    def write(self, container: np.ndarray, i: int, amplitude: float, rate: float, plasticity: Plasticity | None = None) -> float:
        size = amplitude * (plasticity.record(i) if plasticity else 1.0)
        template, shares = self.orthogonal(i)
        absorbed = organic_write(container, template, size, self.positions[i % self.channels])
        for k in range(len(self.ids)):
            if k == i:
                self.coefficients[k] += size * absorbed
            else:
                self.coefficients[k] += rate * (plasticity.of(k) if plasticity else 1.0) * shares[k]
        return absorbed

    def read(self, container: np.ndarray, i: int) -> tuple[float, float]:
        p = self.positions[i % self.channels]
        c, t = container[p].astype(float), self.templates[i][p]
        return float(c @ t / max(np.sqrt(c @ c) * np.sqrt(t @ t), 1e-10)), float(c @ t / max(t @ t, 1e-10))

    def extract(self, container: np.ndarray) -> np.ndarray:
        """Coefficients that explain the container: a Gram system by channel, solved by Cholesky with small pivots lifted."""
        k = len(self.ids)
        masked = np.zeros((k, self.d))
        for i in range(k):
            p = self.positions[i % self.channels]
            masked[i, p] = self.templates[i][p]
        gram, right = masked @ masked.T, masked @ container.astype(float)
        low = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                rest = gram[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = rest / low[j, j] if i != j else (np.sqrt(rest) if rest > 1e-12 else 1e-6)
        from .linalg import cholesky_solve

        return cholesky_solve(low, right) if k else np.zeros(0)

    def read_all(self, container: np.ndarray) -> list[tuple[int, float, float]]:
        """(concept, similarity, amplitude) of every concept."""
        return [(self.ids[i], *self.read(container, i)) for i in range(len(self.ids))]

    def update(self, i: int, template) -> None:
        """Another template of the same size for a concept."""
        template = np.asarray(template, float)
        if len(template) != len(self.templates[i]):
            raise ValueError("a template keeps its size")
        self.templates[i] = template
        self._orthogonal.clear()

    def residual(self, container: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, float]:
        """What is left of the container without each concept's share at its own channel's positions, and its mean square."""
        rest = container.astype(float)
        for i, c in enumerate(coefficients[: len(self.ids)]):
            p = self.positions[i % self.channels]
            rest[p] -= c * self.templates[i][p]
        return rest, float(np.mean(rest * rest)) if self.d else 0.0

    def flush(self, container: np.ndarray, keep: int | None = None) -> dict:
        """Extract, blend with the running coefficients, keep the largest, clear, and write the survivors again."""
        found = self.extract(container)
        self.coefficients = [0.8 * f + 0.2 * c for f, c in zip(found.tolist(), self.coefficients, strict=True)]
        gone: list[int] = []
        if keep is not None and len(self.ids) > keep:
            order = sorted(range(len(self.ids)), key=lambda i: -abs(self.coefficients[i]))
            for i in order[keep:]:
                gone.append(self.ids[i])
                self.coefficients[i] = 0.0
        container[:] = 0
        shares = [organic_write(container, self.templates[i], c, self.positions[i % self.channels]) for i, c in enumerate(self.coefficients) if abs(c) >= 1e-6]
        return {"extracted": found, "pruned": gone, "rewritten": len(shares), "absorption": float(np.mean(shares)) if shares else 1.0}


def wal_sequence(events: DataFrame, templates: list[list[int]], *, key: str, order: str, d: int, channels: int, rate: float = 0.1, decay: int | None = None, flush_keep: int | None = None) -> DataFrame:
    """Fold each container's writes (key, order, concept, amplitude) in order: (key, order, concept, absorbed), or with
    ``flush_keep`` one row for each container after a flush: (key, rewritten, pruned, absorption). Writes stream through a
    task in order, a container after the other; a task holds one container and one batch."""
    ship(events.sparkSession)
    kind, order_kind = (events.schema[c].dataType.simpleString() for c in (key, order))

    known = Wal(d, channels)  # its templates and their projections serve all containers of a task
    for i, t in enumerate(templates):
        known.register(i, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, container, plastic, last = None, None, None, None

        def told() -> tuple:
            end = known.flush(container, flush_keep)
            return (own[0], end["rewritten"], len(end["pruned"]), end["absorption"])

        for batch in batches:
            concepts, amplitudes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("concept", "amplitude"))
            absorbed, out = [], []
            for group, c, a in zip(batch.column(key).to_pylist(), concepts, amplitudes, strict=True):
                if own is None or group != own[0]:
                    if own is not None and flush_keep is not None:
                        out.append(told())
                    own, container, known.coefficients = (group,), np.zeros(d), [0.0] * len(templates)
                    plastic = Plasticity(decay) if decay is not None else None
                    for _ in templates if plastic else ():
                        plastic.add()
                absorbed.append(known.write(container, int(c), float(a), rate, plastic))
            if flush_keep is None:
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(concepts, pa.int32()), pa.array(absorbed, pa.float64())], [key, order, "concept", "absorbed"])
            else:
                yield rows_of(out, batch)
                last = batch
        if own is not None and flush_keep is not None:
            yield rows_of([told()], last)

    def rows_of(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 4
        kinds = (batch.column(key).type, pa.int32(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [key, "rewritten", "pruned", "absorption"])

    schema = f"{key} {kind}, rewritten int, pruned int, absorption double" if flush_keep is not None else f"{key} {kind}, {order} {order_kind}, concept int, absorbed double"
    placed = events.select(key, order, "concept", "amplitude").repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order), "concept")
    return placed.mapInArrow(run, schema)
