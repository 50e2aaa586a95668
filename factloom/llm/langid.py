"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import text as T
from factloom.llm.runtime import id_text, ship

#: Character n-grams of one to ORDERS letters are hashed to this many features.
FEATURES = 1 << 15
ORDERS = 3
#: Bound of the training sample: labelled rows of a language that the classifier sees at most (about).
TRAIN_ROWS = 1000
#: Languages that can be learned at most: the sample and the weights are held by the driver.
MOST_LANGUAGES = 500
FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"

_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    temperature: float


def _term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, features, counts) of every text with a letter; all of its n-grams count."""
    row = 0
    while row < len(column):
        stop, size, lowered = row, 0, []
        while stop < len(column) and (not lowered or size < T.CHUNK_BYTES // 4):
            lowered.append((column[stop].as_py() or "").lower())
            size += len(lowered[-1])
            stop += 1
        points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        grams, running = [], np.zeros(len(points), dtype=np.uint64)
        for order in range(1, ORDERS + 1):
            running = running[: len(points) - order + 1] * T.BASE + points[order - 1 :] if len(points) >= order else running[:0]
            grams.append((T.mix(running, order) >> np.uint64(64 - 15)).astype(np.int32))
        at = 0
        for i, one in enumerate(lowered):
            end = at + len(one)
            if _letter(one):
                own = np.concatenate([g[at : max(at, end - k)] for k, g in enumerate(grams)])
                if len(own) < 4000:
                    yield row + i, *np.unique(own, return_counts=True)
                else:
                    counts = np.bincount(own, minlength=FEATURES)
                    features = np.flatnonzero(counts)
                    yield row + i, features, counts[features]
            at = end
        row = stop


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for _, features, _ in _term_counts(batch.column("text")):
            total[features] += 1
            n += 1
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int32()), pa.array([n, *total[there]], pa.int64())], ["feature", "df"])


def _weighted(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(counts)) * idf[features]
    return value / np.sqrt((value * value).sum())


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, features, counts in _term_counts(batch.column("text")):
            lists = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (features, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, 1), batch.column("tie").slice(row, 1), *lists], ["lang", "tie", "features", "counts"])


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005) -> np.ndarray:
    """Weights (features x classes) by follow-the-regularised-leader with per-coordinate rates and an elastic net."""
    z = np.zeros((FEATURES, classes))
    n = np.zeros((FEATURES, classes))

    def weights(at) -> np.ndarray:
        pull = np.where(np.abs(z[at]) > l1, z[at] - np.sign(z[at]) * l1, 0)
        return -pull / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for label, features, values in rows:
            w = weights(features)
            score = values @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p[None, :]
            step = (np.sqrt(n[features] + g * g) - np.sqrt(n[features])) / alpha
            z[features] += g - step * w
            n[features] += g * g
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores, out of a geometric grid, under which the labels are most likely."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return float(min(np.geomspace(0.05, 5, 81), key=loss))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and non-null lang of the ``docs`` (doc_id, text, lang) outside the held-out fold.

    Document frequencies come from all of these texts. The regression itself is fitted on a bounded
    sample, about ``rows`` of each language and the same whichever way the table is partitioned; a
    fifth of the sample is kept for the temperature. The driver holds the sample's n-gram counts, so more
    than ``MOST_LANGUAGES`` values of lang are a ValueError. An empty table gives a model without languages.
    """
    ship(docs.sparkSession)
    learn = docs.filter((F.crc32(id_text()) % FOLDS != HELD_OUT) & F.col("lang").isNotNull())
    learn = learn.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit(5), id_text(), "text").alias("tie"))
    df = learn.select("text").mapInArrow(_document_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    total = sum(r.df for r in df if r.feature == -1)
    seen = np.zeros(FEATURES)
    for r in df:
        if r.feature >= 0:
            seen[r.feature] = r.df
    idf = np.log((1 + total) / (1 + seen)) + 1

    counts = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    languages = sorted(counts)
    shares = docs.sparkSession.createDataFrame([(x, int(min(1.0, rows / counts[x]) * (1 << 30))) for x in languages], "lang string, share long")
    take = learn.join(F.broadcast(shares), "lang").filter(F.pmod("tie", F.lit(1 << 30)) < F.col("share")).select(*learn.columns)
    sample = []
    for r in take.mapInArrow(_sample_vectors, "lang string, tie long, features array<int>, counts array<int>").toLocalIterator():
        features = np.array(r.features, dtype=np.int32)
        sample.append((r.tie, languages.index(r.lang), features, _weighted(features, np.array(r.counts, dtype=np.float64), idf)))
    sample.sort(key=lambda x: x[0])
    fitted = [x[1:] for i, x in enumerate(sample) if i % 5]
    kept = [x[1:] for i, x in enumerate(sample) if i % 5 == 0]
    weights = fit_ftrl(fitted, max(1, len(languages)))
    scores = np.array([v @ weights[f] for _, f, v in kept]).reshape(len(kept), max(1, len(languages)))
    temperature = fit_temperature(scores, np.array([x[0] for x in kept], dtype=int))
    return Model(languages, idf, weights, temperature)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score in place of columns of these names.

    lang_pred is the likeliest learned language of the whole text and score its calibrated
    probability; a text that is null or has no letter is ``und`` with score 0, as is every text if no
    language was learned. Only the text is looked at, so rows with equal text agree; ties between
    languages go to the first by code point.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if model.languages:
                for row, features, counts in _term_counts(batch.column("text")):
                    s = _weighted(features, counts, model.idf) @ model.weights[features] / model.temperature
                    p = np.exp(s - s.max())
                    best = int(p.argmax())
                    lang[row], score[row] = model.languages[best], p[best] / p.sum()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang), pa.array(score)], [*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema.fields)
    return docs.withColumn("text", F.col("text").cast("string")).select(kept).mapInArrow(run, f"{fields}, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, by a model trained on the others' folds; see ``train`` and ``identify``."""
    held = F.crc32(id_text()) % FOLDS == HELD_OUT
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
