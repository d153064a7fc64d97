"""Quality scores by co-training a text view and a metadata view.

The text view is a naive Bayes classifier over hashed words, as they stand in the text;
a text's score is its mean log ratio.  The metadata view is naive Bayes over source, language and
length class, hashed too.  Both start from the labelled documents.  In each round every other document is scored
by both views, and each view's sure labels go to the other view, which learns from them in the next round.
Last, both views' log odds are calibrated and combined by logistic regression on
labelled documents that no view was fitted on, and every document is scored.

Only the labelled documents are a bounded sample, of about ``max_labelled``, drawn by id hash.  The rounds read all documents, and
add up counts per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .wordhash import text_slices, word_hashes

BUCKETS, META_BUCKETS = 1 << 16, 1 << 12
META = ("source", "lang", "n_chars")
MAX_LABELLED = 12_000
ROUNDS = 3
#: Probability from which a view is sure.
SURE = 0.95
HOLD_BACK = 0.3
_SMOOTHING, _META_SMOOTHING = 1.0, 2.0


def _draw(id_col: str, salt: int, share: float):
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, by Newton steps.  With one class only, its log odds alone."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in text_slices(column):
        hashes, rows = word_hashes(data, offsets, lower=False)
        yield a, b, (hashes >> np.uint64(48)).astype(np.int64), rows


def _text_scores(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for a, b, buckets, rows in _buckets(column):
        sums = np.concatenate([[0.0], np.cumsum(weights[buckets])])
        out[a:b] = (sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(np.diff(rows), 1)
    return out


def _meta_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Buckets (fields x rows) of source, language and length class; null is a class of its own."""
    frame = pa.Table.from_batches([batch.select(list(META))]).to_pandas()
    length = np.floor(np.log2(frame["n_chars"].astype("float64").clip(lower=1))).fillna(-1).astype(int).astype(str)
    texts = [frame["source"].fillna("\0").astype(str), frame["lang"].fillna("\0").astype(str), length]
    return np.stack([(pd.util.hash_array(t.to_numpy(object), categorize=True) % np.uint64(META_BUCKETS)).astype(np.int64) for t in texts])


def _log_ratio(counts: np.ndarray, smoothing: float, kinds: int) -> np.ndarray:
    """Log ratio of each bucket's share among good (row 1) and among bad (row 0)."""
    total = counts.sum(axis=1, keepdims=True)
    return np.diff(np.log(counts + smoothing) - np.log(total + smoothing * kinds), axis=0)[0]


@dataclass
class Views:
    """Weights of both views, each with the scale and offset that calibrate it."""

    words: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    @classmethod
    def of_counts(cls, words: np.ndarray, meta: np.ndarray) -> Views:
        """words: (bad, good) x buckets; meta: fields x (bad, good) x buckets."""
        per_field = [_log_ratio(m, _META_SMOOTHING, max(int((m.sum(axis=0) > 0).sum()), 1)) * (m.sum(axis=0) > 0) for m in meta]
        good, bad = (max(meta[0][y].sum(), 1) for y in (1, 0))
        return cls(_log_ratio(words, _SMOOTHING, BUCKETS), np.stack([*per_field, np.full(META_BUCKETS, np.log(good / bad))]))

    def raw(self, text: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of both views before calibration."""
        meta = sum(t[k] for t, k in zip(self.meta, keys, strict=False)) + self.meta[-1][0]
        return _text_scores(self.words, text), meta

    def odds(self, text: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.raw(text, keys)
        return a * self.text_scale[0] + self.text_scale[1], b * self.meta_scale[0] + self.meta_scale[1]


@dataclass
class QualityModel:
    views: Views
    combined: np.ndarray

    def combine(self, text_odds: np.ndarray, meta_odds: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([text_odds, meta_odds, np.ones(len(text_odds))]) @ self.combined)


def _sure(odds: np.ndarray) -> np.ndarray:
    """1 or 0 where a view is sure of it, else -1."""
    p = sigmoid(odds)
    return np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))


def _counts(shared):
    """Counts of words and of metadata by label that a task has read (columns source, lang, n_chars, text, y).

    Without views, y labels for both; with them, rows without y (-1) are labelled by either view for the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, meta = np.zeros((2, BUCKETS), np.int64), np.zeros((len(META), 2, META_BUCKETS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            keys, text = _meta_keys(batch), batch.column("text")
            for_text = for_meta = y
            if shared.value is not None:
                by_text, by_meta = shared.value.odds(text, keys)
                for_text, for_meta = np.where(y < 0, _sure(by_meta), -1), np.where(y < 0, _sure(by_text), -1)
            for label in (0, 1):
                for f in range(len(META)):
                    meta[f, label] += np.bincount(keys[f][for_meta == label], minlength=META_BUCKETS)
            used = np.flatnonzero(for_text >= 0)
            if len(used):
                labels = for_text[used]
                for a, b, buckets, rows in _buckets(text.take(pa.array(used))):
                    each = np.repeat(labels[a:b], np.diff(rows))
                    for label in (0, 1):
                        words[label] += np.bincount(buckets[each == label], minlength=BUCKETS)
        for table, counts in enumerate((words, *meta)):
            seen = np.flatnonzero(counts.sum(axis=0))
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), table, np.int32)), pa.array(seen.astype(np.int32)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], ["part", "bucket", "bad", "good"])

    return run


def _count(rows: DataFrame, views: Views | None) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(views)
    found = rows.select(*META, "text", "y").mapInArrow(_counts(shared), "part int, bucket int, bad long, good long")
    found = found.groupBy("part", "bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # at most BUCKETS + 3 * META_BUCKETS rows
    tables = [np.zeros((2, BUCKETS)), *(np.zeros((2, META_BUCKETS)) for _ in META)]
    for part, own in found.groupby("part"):
        tables[part][0, own["bucket"]], tables[part][1, own["bucket"]] = own["bad"], own["good"]
    return tables[0], np.stack(tables[1:])


def _raw_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = shared.value.raw(batch.column("text"), _meta_keys(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(a), pa.array(b)], ["id", "y", "a", "b"])

    return run


def _fields(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, length_col: str, id_type: str) -> DataFrame:
    return docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(length_col).cast("long").alias("n_chars"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", label_col: str = "quality", rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """A model from labels 0 and 1 of ``labels``.  Null labels are left out; a document with labels of both kinds is labelled by most, then by 1.

    Ids are whole numbers.  Of several texts of one labelled id, that of the least hash counts; a labelled document beyond the sample is one without a label.
    Documents with a null text teach nothing.
    """
    rows = _fields(docs, id_col, text_col, source_col, lang_col, length_col, "long").where("text is not null")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    drawn = written(known.where(_draw("id", 1, min(1.0, max_labelled / max(known.count(), 1)))), "drawn")  # about max_labelled rows
    one = Window.partitionBy("id").orderBy(F.xxhash64("text"), "n_chars", "source", "lang")
    labelled = rows.join(F.broadcast(drawn), "id").withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
    held = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1000)) < int(HOLD_BACK * 1000)
    labelled = written(labelled.withColumn("held", held), "labelled")
    others = rows.join(F.broadcast(drawn.select("id")), "id", "left_anti").withColumn("y", F.lit(-1))
    own_words, own_meta = _count(labelled.where("not held"), None)

    def calibrated(words: np.ndarray, meta: np.ndarray) -> tuple[Views, np.ndarray, np.ndarray]:
        """Views of these counts, calibrated, and the held-back documents' odds and labels."""
        views = Views.of_counts(own_words + words, own_meta + meta)
        raw = labelled.where("held").select("id", *META, "text", "y").mapInArrow(_raw_scores(docs.sparkSession.sparkContext.broadcast(views)), "id long, y int, a double, b double")
        found = raw.toPandas().sort_values("id")  # a share of the sample
        y = found["y"].to_numpy()
        views.text_scale, views.meta_scale = logistic(found[["a"]].to_numpy(), y), logistic(found[["b"]].to_numpy(), y)
        odds = np.column_stack([found["a"] * views.text_scale[0] + views.text_scale[1], found["b"] * views.meta_scale[0] + views.meta_scale[1]])
        return views, odds, y

    words, meta = np.zeros_like(own_words), np.zeros_like(own_meta)
    for _ in range(rounds):
        views, _, _ = calibrated(words, meta)
        words, meta = _count(others, views)
        if not words.any() and not meta.any():
            break
    views, odds, y = calibrated(words, meta)
    return QualityModel(views, logistic(odds, y))


def _judged(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text_odds, meta_odds = model.views.odds(batch.column("text"), _meta_keys(batch))
            score = model.combine(text_odds, meta_odds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(text_odds)), pa.array(sigmoid(meta_odds)), pa.array(score), pa.array(score >= threshold)], ["id", "text_score", "meta_score", "score", "kept"])

    return run


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, text_score, meta_score, score (all probabilities of good) and kept.

    A null or blank text has the text view's score for no evidence; values of metadata that were never seen add nothing.  Ids of any kind pass through.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _fields(docs, id_col, text_col, source_col, lang_col, length_col, id_type)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_judged(shared, threshold), f"id {id_type}, text_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", id_col)
