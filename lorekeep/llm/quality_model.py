"""Quality classifier on random Fourier features (operator 8).

Each text is reduced to a few statistics. Random Fourier features of the standardised statistics approximate a Gaussian
kernel; a ridge regression on them is fitted from normal equations that partitions sum, and its scores are calibrated by
isotonic regression on labelled rows that the ridge hasn't seen. The statistics read nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, scratch, table, text_or_empty, written

#: Labelled rows that a fit uses at most, those whose doc_ids have the smallest hashes.
MAX_LABELLED = 20_000
#: Partitions whose sums are added on the driver.
PARTS = 16
FEATURES = 256
RIDGE = 1.0
SEED = 8
CUTOFF = 0.3
_CLASSES = ("upper", "lower", "digit", "symbol", "bang", "stop", "punctuation", "space", "line", "other")


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.uint8)
    sets = {
        "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "bang": b"!",
        "stop": b".,;:?", "punctuation": b"\"'()[]{}/\\+-=_@^`~", "space": b" \t\x0b\x0c\r", "line": b"\n",
    }
    for name, members in sets.items():
        out[list(members)] = _CLASSES.index(name)
    return out


_CLASS_OF = _byte_classes()


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; those of an empty text are zeros."""
    raw = text.encode()
    n = dict(zip(_CLASSES, np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES)).tolist()))
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w, c, letters = max(len(words), 1), max(len(raw), 1), max(n["upper"] + n["lower"], 1)
    capitals = sum(map(str.isupper, words))
    return [
        float(np.log1p(len(words))), float(np.log1p((c - n["space"] - n["line"]) / w)), len(set(words)) / w, n["symbol"] / c, float(np.log1p(n["symbol"] / w)),
        n["upper"] / letters, capitals / w, n["digit"] / c, n["bang"] / w, n["stop"] / w, n["punctuation"] / c, raw.count(b"|") / w,
        1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(w / max(len(lines), 1))), n["other"] / c,
    ]


N_STATISTICS = len(statistics(""))


@dataclass(frozen=True)
class Model:
    """Bounded by FEATURES, N_STATISTICS and the calibration's steps, of which there are MAX_LABELLED at most."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.prior)
        return np.interp(features(stats, self.mean, self.scale) @ self.weights, *self.steps)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES) -> np.ndarray:
    """Random Fourier features for a Gaussian kernel whose width is the root of the number of statistics; and a constant."""
    rng = np.random.default_rng(SEED)
    d = len(mean)
    turn, shift = rng.standard_normal((d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n)
    # far outliers are drawn in, else their features are noise
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / n) * np.cos(z @ turn + shift), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: increasing x and non-decreasing y that np.interp reads, within 0 and 1."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, number, sum of x
    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, 1.0, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    at, level = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
    keep = np.concatenate([[True], np.diff(at) > 0])
    return at[keep], np.clip(level[keep], 0, 1)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row may not be learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _with_statistics(rows: DataFrame, keep: str) -> DataFrame:
    """`rows` (text last) with their statistics in place of the text; `keep` is the schema of the other columns."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], [*batch.schema.names[:-1], "stats"])

    return in_arrow(rows, measured, f"{keep}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most `max_labelled` rows of `labels` (doc_id, quality) that aren't held out, and their documents.

    A fifth of them calibrates, the rest fits the ridge. Null labels and labels without a document are passed over; with
    labels of one kind only, or none, every score is their mean, or 0.5. The sample's statistics are kept until the fit stands.
    """
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, max_labelled)


def _fitted(docs: DataFrame, labels: DataFrame, max_labelled: int) -> Model:
    chosen = (
        labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # the sample has max_labelled rows of two numbers at most
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    known = written(_with_statistics(rows.select("doc_id", "y", "text"), "doc_id long, y double").repartition(PARTS), "labelled")
    known = known.withColumn("tuning", F.pmod(F.xxhash64("doc_id", F.lit("tuning")), F.lit(5)) == 0)
    each = [F.col("stats")[k] for k in range(N_STATISTICS)]
    seen = known.agg(F.avg("y").alias("y"), F.min("y").alias("low"), F.max("y").alias("high"), F.array(*map(F.avg, each)).alias("mean"), F.array(*map(F.stddev_pop, each)).alias("scale")).first()
    if seen.y is None or seen.low == seen.high:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), (np.zeros(0), np.zeros(0)), 0.5 if seen.y is None else float(seen.y))
    mean, scale = np.array(seen.mean), np.maximum(np.array(seen.scale), 1e-9)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = features(np.array(batch.column(0).to_pylist(), float).reshape(-1, len(mean)), mean, scale)
            total += x.T @ np.column_stack([x, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    parts = known.where(~F.col("tuning")).select("stats", "y").mapInArrow(sums, "total binary").collect()
    total = sum(np.frombuffer(p.total).reshape(FEATURES + 1, FEATURES + 2) for p in parts)
    weights = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(FEATURES + 1), total[:, -1])
    tuning = known.where("tuning").select("stats", "y").orderBy("doc_id").toArrow()
    x = features(np.array(tuning.column(0).to_pylist(), float).reshape(-1, len(mean)), mean, scale) @ weights
    y = tuning.column(1).to_numpy()
    return Model(mean, scale, weights, isotonic(x, y) if len(y) else (np.array([0.0, 1.0]), np.array([0.0, 1.0])), float(seen.y))


def score_documents(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text).

    A null or empty text is scored by its statistics, all zeros. Equal texts have equal scores. A row with a null doc_id
    is held out. Repeated rows give a row each; other columns are not read; an empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(stats))], ["doc_id", "score"])

    rows = in_arrow(docs.select("doc_id", text_or_empty().alias("text")), scored, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs`, all their columns, whose score reaches the cutoff."""
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t or "") for t in batch.column(place).to_pylist()], float).reshape(-1, N_STATISTICS)
            yield batch.filter(pa.array(model.scores(stats) >= cutoff))

    return in_arrow(docs, kept, docs.schema)


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_fourier_quality": op8_fourier_quality}
ORACLE_SQL: dict[str, str] = {}
