"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

A document becomes a short vector of statistics of its whole text (length, shares of character
classes and marks, distinct words and lines).  Random Fourier features of the standardised
vector approximate a Gaussian kernel; each partition adds up its normal equations, their sum is
solved once, and the scores are made probabilities by isotonic regression on a fold of its own.

The fit uses at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id, and holds them
only as sums.  Scoring reads every whole text once, moves none and joins nothing.

Defined cases: null and empty texts have the statistics of an empty text and a score like any
other; several labels of one id count as their mean, null labels and ids not at all; without
any label every score is 0.5; repeated rows score alike; an empty table gives no rows; extra
columns never matter, and ``keep_good`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import added, crc_fold, octets, query, small_batches, table, unit, written

#: Most labelled rows of a fit.
TRAIN_ROWS = 200_000
FEATURES, SEED, RIDGE = 384, 7, 1e-3
#: Width of the kernel, in root mean squares of a standardised vector.
WIDTH = 1.0
#: Bins of the raw score that the calibration pools, between these ends.
BINS, LOW, HIGH = 2000, -0.75, 1.75
THRESHOLD = 0.3
MARKS = [b"." , b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"_", b"=", b"/", b"-", b"\n"]
MARK_CODES = np.array([m[0] for m in MARKS])
WIDE = 19 + len(MARKS)


def statistics(text: bytes) -> np.ndarray:
    """Statistics of a whole UTF-8 text."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words = text.split()
    w = len(words)
    per = max(1, w)
    sizes = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1, np.int64)
    lines = text.split(b"\n")
    sentences = text.split(b".")
    lower, upper, digits = int(count[97:123].sum()), int(count[65:91].sum()), int(count[48:58].sum())
    wide = int(count[128:].sum())
    letters = max(1, lower + upper + wide)
    marks = int(count[33:127].sum()) - lower - upper - digits
    distinct = len(set(words))
    out = [
        np.log1p(w), np.log1p(len(text)), sizes.mean(), sizes.std(), (sizes > 14).mean(), (sizes < 4).mean(), upper / letters, wide / letters,
        digits / n, marks / n, marks / per, distinct / per, np.log1p(distinct) / np.log(w + 2), len(set(lines)) / len(lines),
        np.log1p(len(lines)), len(set(sentences)) / len(sentences), per / len(sentences), np.log1p(count.max()) / np.log(n + 2), count[32] / per,
    ]
    return np.concatenate([out, np.log1p(100.0 * count[MARK_CODES] / per)])


@dataclass
class Model:
    """Standardisation, ridge weights over the Fourier features, and the calibration steps."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.spread)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score keeps the order within a step."""
        if not len(self.at):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def features(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised statistics, and the statistics themselves."""
    rng = np.random.default_rng(SEED)
    z = np.clip((x - mean) / spread, -5, 5)
    frequency = rng.normal(0, 1 / (WIDTH * np.sqrt(WIDE)), (WIDE, FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ frequency + phase) * 8, z, np.ones((len(z), 1))])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py()).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "check"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, WIDE)


def _sums(rows: DataFrame, part, slots: int = 1) -> np.ndarray | None:  # noqa: ANN001
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                add = part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "data"])

    return added(rows.select("x", "y").mapInArrow(task, "slot int, data binary"), slots).get(0)


def _isotonic(n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over bins with n rows and y positives: centres and values of the pools."""
    centre = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    pools: list[list[float]] = []
    for c, k, s in zip(centre[n > 0], n[n > 0], y[n > 0], strict=True):
        pools.append([k, s, c * k])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> Model:
    """Fit on the documents of ``labels`` (key, label), of which at most about ``most`` take part."""
    small_batches(docs.sparkSession)
    known = written(labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("_y")))
    draw = unit(F.xxhash64("_key", F.lit("fit")))
    known = known.where(draw < min(1.0, most / max(1, known.count())))
    rows = docs.select(F.col(key).alias("_key"), octets(F.col(text)).alias("x")).join(F.broadcast(known), "_key")
    rows = rows.select("x", F.col("_y").alias("y"), F.pmod(F.xxhash64("_key"), F.lit(4)).alias("check"))
    rows = written(rows.mapInArrow(_measured, "x binary, y double, check long"))
    moments = _sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    none = np.zeros(0)
    if moments is None:
        return Model(np.zeros(WIDE), np.ones(WIDE), np.zeros(WIDE + FEATURES + 1), none, none)
    mean = moments[1 : WIDE + 1] / moments[0]
    spread = np.sqrt(np.maximum(moments[WIDE + 1 :] / moments[0] - mean**2, 0)) + 1e-6
    size = FEATURES + WIDE + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = features(x, mean, spread)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(z)]])

    total = _sums(rows.where("check > 0"), normal)
    if total is None:
        total = _sums(rows, normal)
    gram = total[: size * size].reshape(size, size)
    weights = np.linalg.solve(gram + RIDGE * total[-1] * np.eye(size), total[size * size : -1])
    model = Model(mean, spread, weights, none, none)

    def pooled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.clip(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, y, minlength=BINS)])

    held = _sums(rows.where("check = 0"), pooled)
    if held is None:
        held = _sums(rows, pooled)
    model.at, model.value = _isotonic(held[:BINS], held[BINS:])
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["key", "score"])

    return docs.select(F.col(key).alias("key"), octets(F.col(text)).alias("text")).mapInArrow(task, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns unchanged."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t.as_py()) for t in batch.column(0)])
                row = batch.column(1)
                kept = pa.RecordBatch.from_arrays(row.flatten(), names).filter(pa.array(model.score(x) >= threshold))
                yield kept

    rows = docs.select(octets(F.col(text)).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    return rows.mapInArrow(task, docs.schema)


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels that a fit may see: those of documents that are not held out."""
    return labels.where(crc_fold(F.col(key), 5) != 0)


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, training_labels(table(spark, folder, "labels")))
    return scored(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
