"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams are of one to three characters (code points) of the lower-cased text, hashed to a fixed number of features.  Document frequencies cover all rows that
may be learned from.  The weights are trained by follow-the-regularised-leader with elastic-net penalties (many stay exactly 0)
on a bounded sample of each language's different texts, a second bounded sample sets the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, collect_sum, held_out, id_type, lean, only, with_id

FEATURES = 1 << 14


def has_letter(text: str) -> bool:
    """Whether any character is a letter in Unicode's sense; figures and enclosed signs are none."""
    return any(map(str.isalpha, text))


def ngrams(text: str, features: int = FEATURES, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the n-grams of a whole text, in blocks, so that memory is bounded for any length."""
    text = text.lower()
    total = np.zeros(features, dtype=np.int64)
    for a in range(0, len(text), block):
        # Blocks overlap by two characters; an n-gram belongs to the block where it begins.
        c = np.frombuffer(text[a : a + block + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = min(len(c), block)
        for k in (1, 2, 3):
            m = min(n, len(c) - k + 1)
            if m > 0:
                h = np.full(m, k, dtype=np.uint32)
                for i in range(k):
                    h *= np.uint32(0x01000193)
                    h ^= c[i : i + m]
                h *= np.uint32(0x9E3779B1)
                total += np.bincount((h >> np.uint32(8)) % np.uint32(features), minlength=features)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length 1, with the logarithm of a count for it."""
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Leader:
    """Follow-the-regularised-leader, one learning rate for each weight, L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.temperature = langs, idf.astype(np.float32), weights.astype(np.float32), temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        at, counts = ngrams(text)
        p = softmax((weighted(at, counts, self.idf) @ self.weights[at]).astype(float) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], round(float(p[k]), 6)


def fit(docs: DataFrame, per_language: int = 300, calibrate: int = 100, epochs: int = 3) -> Model:
    """Learn from text and lang of rows outside the held-out fold whose lang isn't null.

    ``per_language`` different texts of each language at most (the least by a hash of the text) train, the next ``calibrate`` set the temperature; document
    frequencies cover all rows.  However often a text is repeated, it is drawn once, so a language of copies is learned like any other.  Texts that are null
    or without a letter teach nothing.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "text", F.xxhash64(F.lit("sample"), "text").alias("order"), F.hash("text").alias("more"))
    want = per_language + calibrate
    # Texts without a letter are left out first, so they take no places.  Equal texts meet as hashes; row_number keeps `want` of each task before the shuffle.
    texts = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", "order", "more").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "more"))
    drawn = texts.withColumn("place", place).filter(F.col("place") <= want).select("lang", "order", "more").collect()  # `want` rows of numbers for each language
    langs = sorted({r.lang for r in drawn})

    @lean
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
                df[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], names=["value"])

    df = collect_sum(rows.select("text").mapInArrow(frequencies, "value binary")) if langs else None
    if df is None or not df[-1]:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), 1.0)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    @lean
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            new = {key: k for k, key in reversed(list(enumerate(keys))) if key not in seen}
            seen.update(new)
            found = [ngrams(batch.column(3)[k].as_py()) for k in new.values()]
            columns = [pa.array([key[k] for key in new], batch.column(k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k].astype("<i8").tobytes() for x in found], pa.binary()) for k in (0, 1))], names=["lang", "order", "more", "at", "counts"])

    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], "lang string, order long, more int")
    sample = rows.join(F.broadcast(wanted), ["lang", "order", "more"]).select("lang", "order", "more", "text")
    once = sample.mapInArrow(sparse, "lang string, order long, more int, at binary, counts binary").groupBy("lang", "order", "more").agg(F.min(F.struct("at", "counts")).alias("x"))
    taken: dict[str, list] = {lang: [] for lang in langs}
    for r in once.select("lang", "order", "more", "x.at", "x.counts").collect():
        at, counts = np.frombuffer(r.at, "<i8"), np.frombuffer(r.counts, "<i8")
        taken[r.lang].append((r.order, r.more, at, weighted(at, counts, idf)))
    train, tune = [], []
    for k, lang in enumerate(langs):
        own = sorted(taken[lang], key=lambda x: x[:2])
        held = min(calibrate, len(own) // 4)
        tune += [(at, x, k) for _, _, at, x in own[:held]]
        train += [(o, at, x, k) for o, _, at, x in own[held:]]
    leader = Leader(FEATURES, len(langs))
    train.sort(key=lambda x: (x[0], x[3]))
    for _ in range(epochs):
        for _, at, x, k in train:
            leader.learn(at, x, k)
    weights = leader.weights(slice(None))
    logits = [(x @ weights[at], k) for at, x, k in tune]

    def loss(t: float) -> float:
        return -sum(np.log(max(1e-12, softmax(v / t)[k])) for v, k in logits)

    temperature = min(np.geomspace(0.05, 5, 41).tolist(), key=loss) if logits else 1.0
    return Model(langs, idf, weights, temperature)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score.

    ``lang_pred`` is a lang value that was learned, or ``und`` with a score of 0 where the text is null or has no letter, or where nothing could be
    learned.  Rows with equal or null ids are judged each for themselves; an empty table gives no rows.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = with_id(rows)
    model = fit(rows, **sizes)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = rows.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", id_type(rows, "doc_id")), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
