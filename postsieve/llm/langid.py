"""Language identification with interpolated Kneser-Ney character models.

``fit`` counts character 4-grams of a bounded sample of labelled texts, per language,
and turns them into Kneser-Ney models whose grams, contexts and continuation counts
are sorted arrays of 64-bit gram hashes (four 16-bit letter ids).  ``predict`` scores
every whole text under every model and takes the language of the least cross-entropy
per character.  A share of the sample is held back from counting: on it the softmax
temperature behind ``score`` and the rejection limits are set.

Texts are lower-cased; each run of characters that are not letters is one space.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workers
from .columns import beside_text
from .store import written
from .wordhash import text_slices

ORDER = 4
#: Distinct labelled texts of one language that a model is fitted on, at most; and the share of them kept for calibration.
SAMPLE_PER_LANG = 1500
CALIBRATION_SHARE = 0.25
#: Texts of a language that are learned from before any is kept back.
LEAST_LEARNED = 5
#: A text is rejected if its cross-entropy lies further above its language's mean than this times the furthest calibration
#: text of at least ``STEADY`` characters, and more than halfway to chance; shorter texts have 4 standard deviations more.
REJECT_SLACK = 1.5
STEADY = 50

_BITS = np.uint64(16)
_table: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Letter id of each code point of the basic plane: that of its lower case, 0 for what is no letter."""
    global _table
    if _table is None:
        ids = np.zeros(1 << 16, np.uint16)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                ids[cp] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else cp
        _table = ids
    return _table


def _letters(cps: np.ndarray) -> np.ndarray:
    low = _letter_table()[np.minimum(cps, 0xFFFF)]
    far = np.flatnonzero(cps > 0xFFFF)
    for cp in np.unique(cps[far]).tolist():  # beyond the basic plane letters share private ids
        low[far[cps[far] == cp]] = 0xE000 + cp % 0x1900 if unicodedata.category(chr(cp))[0] == "L" else 0
    return low


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram code at every character of the rows of a byte slice, the rows' offsets into the codes, and their numbers of letters."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    ids = _letters(cps)
    start = np.zeros(len(ids) + 1, bool)
    start[begins[:-1]] = True
    space_before = np.ones(len(ids), bool)
    space_before[1:] = (ids[:-1] == 0) | start[1:-1]
    keep = (ids != 0) | ~space_before
    rows = np.concatenate([[0], np.cumsum(keep)])[begins]
    n_letters = np.concatenate([[0], np.cumsum(ids != 0)])[begins]
    ids = ids[keep].astype(np.uint64)
    at = np.arange(len(ids)) - np.repeat(rows[:-1], np.diff(rows))
    codes = ids.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(ids), np.uint64)
        before[k:] = ids[:-k] if k < len(ids) else 0
        before[at < k] = 0
        codes |= before << (_BITS * np.uint64(k))
    return codes, rows, np.diff(n_letters)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Level:
    """One order of one language: sorted grams with their counts, sorted contexts with the sum and number of what follows."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    sums: np.ndarray
    kinds: np.ndarray
    discount: float


class KneserNey:
    def __init__(self, codes: np.ndarray, counts: np.ndarray, alphabet: int):
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        self.alphabet, self.levels = alphabet, []
        for n in range(ORDER, 0, -1):
            contexts, index = np.unique(codes >> _BITS, return_inverse=True)
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones + twos else 0.5
            self.levels.append(Level(codes, counts, contexts, np.bincount(index, counts), np.bincount(index).astype(np.float64), discount))
            if n > 1:  # below the highest order a gram counts once for each character that comes before it
                mask = np.uint64((1 << 16 * (n - 1)) - 1)
                codes, counts = np.unique(codes & mask, return_counts=True)
                counts = counts.astype(np.float64)

    def prob(self, codes: np.ndarray, depth: int = 0) -> np.ndarray:
        if depth == ORDER:
            return np.full(len(codes), 1 / self.alphabet)
        level = self.levels[depth]
        lower = self.prob(codes & np.uint64((1 << 16 * (ORDER - depth - 1)) - 1), depth + 1)
        at, known = _find(level.contexts, codes >> _BITS)
        total, kinds = level.sums[at], level.kinds[at]
        where, seen = _find(level.grams, codes)
        own = np.where(seen, np.maximum(level.counts[where] - level.discount, 0), 0)
        return np.where(known, (own + level.discount * kinds * lower) / total, lower)


class LanguageModels:
    """All languages' models, with their log probabilities side by side for every gram that any of them knows."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        everything = np.unique(np.concatenate([c for c, _ in counts.values()])) if counts else np.zeros(0, np.uint64)
        alphabet = len(np.unique(everything & np.uint64(0xFFFF))) + 1
        self.models = [KneserNey(*counts[lang], alphabet) for lang in self.langs]
        self.grams = everything
        self.table = np.stack([np.log(m.prob(everything)) for m in self.models], axis=1).astype(np.float32) if self.models else np.zeros((0, 0), np.float32)
        n = len(self.langs)
        self.chance = math.log(alphabet)
        self.temperature, self.limits, self.spreads = 1.0, np.full(n, math.inf), np.zeros(n)

    def cross_entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows x languages) nats per character, characters and letters of each row; rows without characters are 0."""
        codes, rows, n_letters = grams(data, offsets)
        n = np.diff(rows)
        out = np.zeros((len(n), len(self.langs)))
        if not len(codes) or not self.langs:
            return out, n, n_letters
        at, known = _find(self.grams, codes)
        logs = self.table[at]
        missing = np.flatnonzero(~known)
        if len(missing):
            kinds, index = np.unique(codes[missing], return_inverse=True)
            logs[missing] = np.stack([np.log(m.prob(kinds)) for m in self.models], axis=1).astype(np.float32)[index]
        full = np.flatnonzero(n)
        out[full] = -np.add.reduceat(logs, rows[full], axis=0, dtype=np.float64) / n[full, None]
        return out, n, n_letters

    def judge(self, entropy: np.ndarray, n: np.ndarray, n_letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each row."""
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(n)), best]
        weight = np.exp(-self.temperature * np.sqrt(n)[:, None] * (entropy - least[:, None]))
        score = 1 / weight.sum(axis=1)
        far = least > self.limits[best] + 4 * self.spreads[best] / np.sqrt(np.maximum(n, 1))
        none = n_letters == 0
        langs = ["und" if x else self.langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
        return langs, np.where(none, 0.0, score), none | far

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """truth: index of each row's language."""
        used = n > 0
        entropy, n, truth = entropy[used], n[used], truth[used]
        if not len(n):
            return
        gap = np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))

        def loss(t: float) -> float:
            z = -t * gap
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(n)), truth]).mean())

        self.temperature = min(np.geomspace(0.05, 10, 60).tolist(), key=loss)
        own = entropy[np.arange(len(n)), truth]
        for k in range(len(self.langs)):
            mine = truth == k
            if mine.sum() >= 10:
                mean = np.average(own[mine], weights=n[mine])
                furthest = max((own[mine & (n >= STEADY)] - mean).max(initial=0.0), 0.0)
                self.spreads[k] = float(np.sqrt(np.mean((own[mine] - mean) ** 2 * n[mine])))
                self.limits[k] = mean + max(REJECT_SLACK * furthest, 0.5 * (self.chance - mean))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-gram counts of each language in the texts that a task has read."""
    workers.begin("langid")
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, index = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(index, np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, data, offsets in text_slices(batch.column(1)):
            codes, rows, _ = grams(data, offsets)
            for lang in set(langs[a:b]):
                own = [codes[rows[i] : rows[i + 1]] for i in range(b - a) if langs[a + i] == lang]
                held.setdefault(lang, []).append(np.unique(np.concatenate(own), return_counts=True))
                if len(held[lang]) > 16:
                    held[lang] = [merged(held[lang])]
    for lang, parts in held.items():
        codes, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def _entropies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("langid")
        models = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                entropy, n, _ = models.cross_entropy(data, offsets)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(entropy.ravel()), len(models.langs)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(n, pa.int64())], ["lang", "entropy", "n"])

    return run


def _predictions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("langid")
        models = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                entropy, n, letters = models.cross_entropy(data, offsets)
                langs, score, rejected = models.judge(entropy, n, letters)
                kept = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                least = entropy.min(axis=1) if models.langs else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(score), pa.array(least), pa.array(rejected)], [*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModels:
    """Models of the languages of ``labelled``, from at most ``per_lang`` distinct texts of each, those of the least hashes.

    Rows with a null text or language are left out; every other language with a character in its texts is learned.  Texts are kept back for calibration
    only of languages that have ``LEAST_LEARNED`` others.  Without rows there is no language, and ``predict`` rejects all.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a language
    if not sizes:
        return LanguageModels({})
    # About a fifth more than asked for are drawn by hash, one row a text is kept of those, and the least of them make the sample.
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(1.2 * per_lang / max(n, 1)))])
    drawn = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    first = Window.partitionBy("lang").orderBy("u", "h")
    sample = rows.withColumn("u", drawn).where(F.col("u") < share[F.col("lang")]).dropDuplicates(["lang", "h"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_lang)
    drawn_back = F.pmod(F.xxhash64("h"), F.lit(1000)) < int(CALIBRATION_SHARE * 1000)
    others = F.count_if(~drawn_back).over(Window.partitionBy("lang"))  # at most per_lang rows
    sample = written(sample.select("lang", "text", (drawn_back & (others >= LEAST_LEARNED)).alias("back")), "sample")
    counted = sample.where("not back").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    langs, codes, n = table.column("lang").to_pandas().to_numpy(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    models = LanguageModels({sys.intern(lang): (codes[langs == lang], n[langs == lang]) for lang in set(langs)})
    spark = labelled.sparkSession
    held = sample.where("back").select("lang", "text").mapInArrow(_entropies(spark.sparkContext.broadcast(models)), "lang string, entropy array<double>, n long").toArrow()
    known = [i for i, lang in enumerate(held.column("lang").to_pylist()) if lang in models.langs]
    if known:
        entropy = np.array([held.column("entropy")[i].as_py() for i in known])
        models.calibrate(entropy, held.column("n").to_numpy()[known], np.array([models.langs.index(held.column("lang")[i].as_py()) for i in known]))
    return models


def predict(docs: DataFrame, models: LanguageModels, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row (all but the text if None), with lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.  Texts may be of any length.  Kept columns can't be named like an output.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    outputs = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}
    given = beside_text(docs, keep, text_col, outputs)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), *(f"{k} {v}" for k, v in outputs.items())])
    return given.mapInArrow(_predictions(shared), schema).toDF(*keep, *outputs)
