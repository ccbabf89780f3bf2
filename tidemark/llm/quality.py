"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

A text is described by statistics of its characters, words and lines. Cosines of random projections of the scaled
statistics approximate a Gaussian kernel, so a linear fit on them is a kernel fit. The normal equations of the ridge fit
are sums over rows: each partition sums its own, groups of partitions are summed by Spark, and the driver solves one
system whose size is the number of features. Scores are then made probabilities by an isotonic fit on labelled rows that
the ridge fit didn't see, counted in a fixed number of bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_below, emit, give_back, stash, text_bytes
from tidemark.session import materialise

FEATURES = 256
_BINS = 1000
_GROUPS = 16  # of partitions whose sums are added before the driver gets them

STATISTICS = [
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "punctuation", "symbol", "other", "mean_word",
    "sd_word", "long_words", "distinct", "top_word", "top_ten", "same_as_last", "no_letter", "symbol_end", "all_upper",
    "log_lines", "line_words", "repeated_lines", "stops", "commas", "bigram_distinct",
]
_STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

# Classes of bytes: upper, lower, digit, white space, common punctuation, other symbols, beyond ASCII.
_CLASS = np.array([
    6 if b >= 128 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b == 32 or 9 <= b <= 13
    else 4 if chr(b) in ".,;:'\"!?()-" else 5 for b in range(256)
])


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a text, from all of it; an empty text has zeros but for those that are one minus a share."""
    data = text or b""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, words = max(1, len(data)), data.split()
    kinds = np.bincount(_CLASS, weights=counts, minlength=7) / size
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    common = Counter(words)
    top = [c for _, c in common.most_common(10)] or [0]
    ends = Counter(w[-1] for w in words)
    no_letter = upper = 0
    for w, c in common.items():
        if not w[:1].isalpha() and w[0] < 128 and not any(x >= 128 or 65 <= x <= 90 or 97 <= x <= 122 for x in w):
            no_letter += c
        elif len(w) > 1 and w.isupper():
            upper += c
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(len(data)), np.log1p(len(words)), *kinds.tolist(), float(lengths.mean()), float(lengths.std()),
        float((lengths > 15).mean()), len(common) / n, top[0] / n, sum(top) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n, no_letter / n,
        sum(c for x, c in ends.items() if _CLASS[x] == 5 or x == 33) / n, upper / n,
        np.log1p(len(lines)), len(words) / max(1, len(lines)) / 100, 1 - len(set(lines)) / max(1, len(lines)),
        int(counts[46]) / n, int(counts[44]) / n, len(set(zip(words, words[1:]))) / n,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row's whole text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], schema=_STATS)
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``values`` in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # middles of the calibration bins that had rows
    levels: np.ndarray  # the calibrated share of good rows there

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.projection + self.phase
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def _summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The two sides of the normal equations over all ``rows`` (``x, y``), summed by partition and by group."""
    size = len(model.phase) + 1

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, some = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                z, some = model.features(_matrix(batch.column("x"))), True
                left += z.T @ z
                right += z.T @ batch.column("y").to_numpy()
        if some:
            sums = np.concatenate([left.ravel(), right]).tobytes()
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums], pa.binary())})

    def by_group(group: pa.Table) -> pa.Table:
        total = np.zeros(size * size + size)
        for chunk in group.column("sums"):
            total += np.frombuffer(chunk.as_buffer(), np.float64)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", "y").mapInArrow(by_partition, "sums binary").withColumn("g", F.spark_partition_id() % _GROUPS)
    total = np.zeros(size * size + size)
    for r in parts.groupBy("g").applyInArrow(by_group, "sums binary").collect():  # _GROUPS rows at most
        total += np.frombuffer(r["sums"], np.float64)
    return total[: size * size].reshape(size, size), total[size * size :]


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = 1e-4, width: float = 6.0, seed: int = 7) -> Model:
    """Fit on ``labelled`` (``x, y, calibrate``): rows without ``calibrate`` make the ridge fit, those with it the
    calibration. ``width`` is that of the Gaussian kernel, in standard deviations of the statistics."""
    dims = range(len(STATISTICS))
    moments = labelled.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in dims], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in dims]).first()
    random = np.random.default_rng(seed)
    projection = random.standard_normal((len(STATISTICS), features)) / width
    phase = random.uniform(0, 2 * np.pi, features)
    if not moments["n"]:  # nothing to learn from: every text is as good as any other
        nothing = np.zeros(len(STATISTICS))
        return Model(nothing, nothing + 1, projection, phase, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([moments[f"m{i}"] for i in dims])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in dims])
    model = Model(mean, scale, projection, phase, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    left, right = _summed(labelled.filter("NOT calibrate"), model)
    n = max(1.0, left[-1, -1])
    model.weights = np.linalg.solve(left + ridge * n * np.eye(features + 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column("x"))) + 1) / 3 * _BINS, 0, _BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    rows = labelled.filter("calibrate").select("x", "y").mapInArrow(binned, "bin int, y double")
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # _BINS rows at most
    if bins:
        weight, level = np.array([b["n"] for b in bins], float), np.array([b["y"] for b in bins])
        model.edges = (np.array([b["bin"] for b in bins]) + 0.5) / _BINS * 3 - 1
        model.levels = pool_adjacent(level, weight)
    else:
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Rows whose ``crc32(doc_id) mod folds`` is 0 are held out: their labels are not used. Remainder 1 calibrates, the
    others fit. A label is the mean of a document's non-null ``quality`` values in ``labels``. ``score`` is the calibrated
    probability of quality 1, ``predicted`` says whether it reaches ``threshold``.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``; other columns are not looked at. Null
    and empty texts are scored as empty ones. A row without id is scored, is not held out, and has no label. Rows come
    back as often as they come; rows that repeat weigh as often in the fit. Without labels every score is 0.5.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = stash(describe(docs)).withColumn("fold", fold)
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    labelled = rows.filter("fold <> 0").join(marks, "doc_id").select("x", "y", (F.col("fold") == 1).alias("calibrate"))
    model = fit(labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
        for batch in batches:
            score = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.empty(0)
            yield emit({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= threshold).astype(np.int32)}, schema)

    return rows.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "x").mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be of low quality, with all their columns. Rows of one id go
    together if any is; a row without id stays."""
    away = materialise(quality_scores(docs, labels, folds, threshold).filter("predicted = 0").select(F.col("doc_id").alias("_away")))
    return docs.join(broadcast_if_below(away, away.count(), 64), F.col("doc_id").cast("long") == F.col("_away"), "left_anti").select(*docs.columns)
