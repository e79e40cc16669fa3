"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of whole texts (lengths, shares of kinds of characters, repetition
of words and lines) are standardised over all documents and mapped to random
cosine features, whose inner products approximate a Gaussian kernel. Every
task adds up the normal equations of its labelled rows; the sums, whose size
is fixed by the number of features, are solved on the driver. Raw scores of a
further fifth of the labelled rows are counted in ``BINS`` bins, and the
least-squares non-decreasing curve through the bins maps raw scores to scores
in 0..1.

Of the five parts by hash of the id, part 0 is held out and never learnt from,
parts 1 to 3 give the weights and part 4 the curve. Scores depend on the text
alone.

Defined cases: a null text is an empty one and is scored like any text; rows
of one doc_id are scored each; label rows without a quality or without a
document are left out, and of several label rows each counts; without any
label every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.support import raw_texts, stored, text_slices

FEATURES = 256
RIDGE = 1e-3
BANDWIDTH = 4.0
SEED = 11
BINS = 1000
FOLDS = 5
THRESHOLD = 0.3
# So much of a score comes from the raw score, which orders rows of equal calibrated score.
TIE_SHARE = 1e-3
_GROUPS = [bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".", b",", b"!?", b"%&#$*@^~+=", b"|<>{}[]()_/\\",
           b"'\"-:;`", bytes(range(128, 256))]
_MARKS = np.zeros((256, len(_GROUPS)))
for _i, _group in enumerate(_GROUPS):
    _MARKS[list(_group), _i] = 1


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def statistics(raw: bytes) -> list[float]:
    """Numbers that describe a whole UTF-8 text."""
    words, lines = raw.split(), raw.split(b"\n")
    size, count = max(1, len(raw)), max(1, len(words))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MARKS / size
    used = Counter(words)
    most = max(used.values(), default=0)
    letters = shares[0] + shares[1] + shares[-1]
    return [math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / count, most / count,
            len(used) / count, math.log1p(len(used)), len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)),
            shares[0] / max(letters, 1e-9), math.log1p(100 * shares[3]), *shares.tolist()]


class Model:
    """What scoring needs; its size does not depend on the data."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = random.normal(size=(len(mean), FEATURES)) / BANDWIDTH
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = self.curve = None

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -10, 10)
        waves = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        raw = self.raw(rows)
        return (1 - TIE_SHARE) * np.interp(raw, *self.curve) + TIE_SHARE * np.clip((raw + 1) / 3, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the non-decreasing curve nearest to the points, which come in order of ``x``."""
    blocks: list[list[float]] = []
    for point in zip(x, y, weight, strict=True):
        blocks.append([*point, point[0], point[0]])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a, b = blocks[-2], blocks.pop()
            total = a[2] + b[2]
            blocks[-1] = [0.0, (a[1] * a[2] + b[1] * b[2]) / total, total, a[3], b[4]]
    corners = [(at, b[1]) for b in blocks for at in ((b[3], b[4]) if b[3] < b[4] else (b[3],))]
    return np.array([c[0] for c in corners]), np.array([c[1] for c in corners])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of its text."""
    def run(batches):
        for batch in text_slices(batches):
            rows = [statistics(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, stats array<double>")


def train(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit a model to ``document_statistics`` of all documents and the labels outside the held-out part."""
    width = len(statistics(b""))
    moments = stats.select([F.get("stats", F.lit(i)).alias(f"s{i}") for i in range(width)]).agg(
        *[F.avg(f"s{i}").alias(f"m{i}") for i in range(width)], *[F.stddev_pop(f"s{i}").alias(f"d{i}") for i in range(width)]).first()
    numbers = np.array([0.0 if v is None else v for v in moments])
    model = Model(numbers[:width], np.maximum(numbers[width:], 1e-6))
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("label")).filter(
        F.col("label").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    rows = stored(stats.join(known, F.col("doc_id") == F.col("_id")).select("stats", "label", (fold(F.col("doc_id")) == FOLDS - 1).alias("later")), "labelled")
    state = stats.sparkSession.sparkContext.broadcast(model)

    def add_up(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = state.value.features(_matrix(batch.column(0)))
            total += x.T @ np.column_stack([x, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array([r.tobytes() for r in total])], names=["row", "sums"])

    def add_rows(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(s.as_buffer()) for s in table.column("sums"))
        return pa.table({"row": table.column("row")[:1], "sums": pa.array([sums.tobytes()])})

    sums = rows.filter("NOT later").mapInArrow(add_up, "row long, sums binary").groupBy("row").applyInArrow(add_rows, "row long, sums binary")
    equations = np.array([np.frombuffer(r.sums) for r in sums.orderBy("row").collect()])
    if not len(equations) or not equations[-1, -2]:
        return model
    count = equations[-1, -2]
    left = equations[:, :-1] + np.eye(FEATURES + 1) * RIDGE * count / FEATURES
    model.weights = np.linalg.solve(left, equations[:, -1])
    state = stats.sparkSession.sparkContext.broadcast(model)

    def score_raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(state.value.raw(_matrix(batch.column(0)))), batch.column(1)], names=["raw", "label"])

    place = F.floor((F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) + 1) / 3 * BINS)
    bins = rows.filter("later").mapInArrow(score_raw, "raw double, label double").groupBy(place.alias("bin")).agg(
        F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n")).orderBy("bin").collect()
    model.curve = isotonic(*np.array([(b.raw, b.label, b.n) for b in bins]).T) if bins else (np.array([0.0, 1.0]),) * 2
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of ``document_statistics``."""
    state = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = state.value.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each text as a further column; no shuffle."""
    state = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in text_slices(batches, at):
            rows = np.array([statistics(t) for t in raw_texts(batch.column(at))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state.value.score(rows))], names=[*names, "score"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return docs.toDF(*names).mapInArrow(run, f"{kinds}, score double").toDF(*docs.columns, score)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = stored(document_statistics(docs), "statistics")
    scored = score_statistics(stats, train(stats, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
