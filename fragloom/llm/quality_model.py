"""Quality scores: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration.

The features approximate a Gaussian kernel.  Each task adds up its rows' normal equations, so that one matrix of a fixed size
for each task, then their sum, is all that leaves it; all labelled rows of the training folds count.  Calibration pools adjacent violators on the counts of binned scores in a
fold of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, collect_sum, held_out, keep, lean, masked, only, with_id

UPPERS = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
STOPS = b".,;:?"
MARKS = b"!"
WIDE = bytes(range(0x80, 0x100))
#: Words in a window of the rate of near repeats.
WINDOW = 64
SYMBOLS = b"#*$%&|<>@^~=+_\\{}[]"
STATS = (
    "chars", "words", "word_length", "uppers", "digits", "stops", "marks", "symbols", "bars", "wide", "distinct", "repeats", "words_per_line", "same_lines",
    "ended_lines", "long_word", "near_repeats",
)


def statistics(text: str | None) -> list[float]:
    """Fixed-length statistics of a whole text; null counts as empty, whose statistics are all 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [np.log1p(len(data)), *[0.0] * (len(STATS) - 1)]
    size, n = len(data), len(words)
    without = lambda chars: size - len(data.translate(None, chars))
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = len(lines) - len(set(lines))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b":")) and not x.rstrip().endswith(b"!!") for x in lines)
    fresh = sum(len(set(words[k : k + WINDOW])) for k in range(0, n, WINDOW))  # all words, in windows one after another
    return [
        np.log1p(size), np.log1p(n), min(30.0, sum(map(len, words)) / n), without(UPPERS) / size, without(DIGITS) / size, without(STOPS) / n, min(3.0, without(MARKS) / n),
        min(3.0, without(SYMBOLS) / n), min(1.0, data.count(b"|") / n), without(WIDE) / size,
        distinct / n**0.85, sum(map(eq, words, words[1:])) / n, np.log1p(n / max(1, len(lines))), same / len(lines), ended / len(lines), np.log1p(max(map(len, words))),
        1 - fresh / n,
    ]


class Model:
    """Means and scales of the statistics, the kernel's directions, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.directions = rng.standard_normal((len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """0 to 1; rounded, so that the order of sums cannot show."""
        if not len(stats):
            return np.zeros(0)
        raw = np.clip(self.raw(stats), -0.5, 1.5)
        return np.round(np.interp(raw, *self.steps) if self.steps is not None else np.clip(raw, 0, 1), 6)


def pooled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means ``y`` with weights ``n`` at ascending ``x``: (centres, values) of the pooled blocks."""
    blocks: list[list[float]] = []  # sum of x, sum of y, weight
    for a, b, w in zip(x, y, n, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([a / w for a, _, w in blocks]), np.array([b / w for _, b, w in blocks])


def with_stats(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with ``stats`` (array of doubles) of each text."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([statistics(t) for t in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and stats, written to the shared folder."""
    return keep(with_stats(with_id(only(docs, doc_id=id_col, text=text_col))).select("doc_id", "stats"), "stats")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 0.7, ridge: float = 1e-3, bins: int = 2000, seed: int = 5) -> Model | None:
    """Learn from ``labels`` (doc_id, quality) of rows outside the held-out fold; None without any.

    Null labels and ids count for nothing; a document labelled more than once has the mean of its labels, and repeated rows count each.  A
    quarter of the documents (by a hash of the id) calibrates; if there are none, scores are not calibrated.
    """
    quality = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(stats.schema["doc_id"].dataType).alias("doc_id")).agg(F.avg("quality").alias("y"))
    joined = stats.join(quality, "doc_id").filter(~held_out(F.col("doc_id")))
    table = keep(joined.select("stats", "y", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).alias("calibrate")), "labelled")
    train = table.filter(~F.col("calibrate"))
    columns = [F.col("stats")[i] for i in range(len(STATS))]
    facts = train.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    if not facts["n"]:
        return None
    mean = np.round([facts[f"m{i}"] for i in range(len(STATS))], 9)
    scale = np.round([facts[f"s{i}"] for i in range(len(STATS))], 9)
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), features, width, seed)
    side = features + 1

    @lean
    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.expand(_matrix(batch.column(0)))
                total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    total = collect_sum(train.select("stats", "y").mapInArrow(equations, "value binary")).reshape(side, side + 1)
    penalty = ridge * facts["n"] / features * np.eye(side)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :side] + penalty + 1e-9 * np.eye(side), total[:, side])

    @lean
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.clip(model.raw(_matrix(batch.column(0))), -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(x * bins / 2).astype(np.int64)), batch.column(1)], names=["bin", "y"])

    binned = table.filter("calibrate").select("stats", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    rows = sorted((r.bin, r.y, r.n) for r in binned.collect())  # `bins` rows at most
    if rows:
        x, y, n = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
        model.steps = pooled(x * 2 / bins, y / n, n)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted.

    Null and empty texts are scored by their statistics, which are all 0.  Without any usable label every score is 0.5.  Rows with equal or null ids are
    scored each for themselves; an empty table gives no rows.  Other columns are not read.
    """
    stats = stats_table(docs)
    model = fit(stats, labels)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns and in their order, without the documents whose score is under ``threshold``.

    Null and empty texts are judged by their statistics; of repeated rows all go or all stay; an empty table gives no rows; without any usable label all stay; names of
    other columns cannot clash.  Documents are written once beside their statistics, which serve both the fit and the scores.
    """
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = keep(with_stats(masked(docs), own_text), "documents-stats")
    model = fit(with_id(rows.select(F.col(own_id).alias("doc_id"), "stats")), labels)
    if model is None:
        return docs
    at = len(docs.columns)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = pa.array(model.score(_matrix(batch.column(at))) >= threshold)
                yield pa.RecordBatch.from_arrays(batch.columns[:at], names=batch.schema.names[:at]).filter(good)

    return rows.mapInArrow(run, rows.drop("stats").schema).toDF(*docs.columns)
