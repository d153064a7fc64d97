"""Quality rules under weak supervision.

Each rule votes for or against a document, or abstains.  How often a rule votes either
way on good and on bad documents, and how many are good, is estimated by
expectation-maximisation over the counts of all vote patterns (at most 3**rules rows).
A document is kept if its posterior probability of being good reaches ``threshold``.

Everything on the documents is DataFrame functions; the estimation runs in the driver over the pattern table, whose size the number of rules bounds.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import BLANKS, let, words
from .store import written

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Rules: an expression, and the bounds below or above which it votes bad or good: (bad below, good from, good to, bad above).
RULES: dict[str, tuple[str, tuple[float, float, float, float]]] = {
    "length": ("n_words", (50, 80, math.inf, math.inf)),
    "word_length": ("word_chars / n_words", (2, 3, 9, 13)),
    "symbols": ("n_symbols / n_words", (-1, 0, 0.02, 0.1)),
    "dup_lines": ("n_dup_lines / n_lines", (-1, 0, 0.1, 0.3)),
    "repeats": ("n_repeat_words / n_words", (-1, 0, 0.15, 0.3)),
    "capitals": ("n_capitals / n_letters", (-1, 0, 0.2, 0.5)),
    "letters": ("n_letters / word_chars", (0.6, 0.85, 1, 2)),
    "sentences": ("n_marks / n_words", (0.01, 0.04, 0.3, 0.6)),
}
#: Shares of votes (bad, abstain, good) of bad and of good documents that name the two classes and that estimation starts from: a rule
#: hardly ever votes against a good document.  Afterwards they weigh as much as ``PRIOR_COUNT`` documents of a class, whatever the table's size.
PRIOR = {"bad": (0.3, 0.1, 0.6), "good": (0.004, 0.1, 0.896)}
PRIOR_COUNT = 20.0
ROUNDS, SETTLED = 40, 1e-2


def _repeated(word_list: Column) -> Column:
    """Words in windows of three that occur twice or more, the first included."""

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        grams = F.transform(F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return let(grams, of_grams)

    def of_grams(g: Column) -> Column:
        """Positions in the order of their windows' hashes, so that equal windows stand together."""
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(F.transform(pairs, lambda p: p["i"]), lambda order: of_order(order, g))

    def of_order(order: Column, g: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce(F.get(g, x) == F.get(g, y), F.lit(False))

        again = F.filter(order, lambda x, i: same(x, F.get(order, i + 1)) | same(x, F.get(order, i - 1)))
        return let(F.sort_array(again), covered)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), of_hashes)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and counts of each whole text; a null text has none of anything."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("repeated")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, "")).cast("long")

    n = F.length(text).cast("long")
    found = docs.select(
        F.col(id_col).alias("id"), of_words.alias("w"), of_lines.alias("l"), without(BLANKS).alias("word_chars"), (n - without(SYMBOLS)).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"), F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"), (n - without(".!?")).alias("n_marks"),
    )
    return found.select("id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals", "n_letters", "n_marks")


def _vote(value: str, bounds: tuple[float, float, float, float]) -> Column:
    """0 against, 2 for, 1 neither or not defined."""
    numerator, _, denominator = value.partition(" / ")
    x = F.col(numerator).cast("double")
    if denominator:
        x = F.try_divide(x, F.col(denominator).cast("double"))
    low, good_low, good_high, high = bounds
    return F.when((x < low) | (x > high), 0).when((x >= good_low) & (x <= good_high), 2).otherwise(1)


def votes(measured: DataFrame, rules: Mapping[str, tuple[str, tuple[float, float, float, float]]] = RULES) -> DataFrame:
    return measured.select("*", F.array(*[_vote(*rule) for rule in rules.values()]).alias("votes"))


def _log_odds(weights: list[float]) -> Column:
    """weights: the prior's log odds, then one for each rule and vote.  A literal array, so that steps share compiled code."""
    w = F.lit(weights)
    return F.aggregate(F.transform(F.col("votes"), lambda v, j: F.get(w, 1 + 3 * j + v)), F.get(w, F.lit(0)), lambda s, x: s + x)


def _posterior(weights: list[float]) -> Column:
    return 1 / (1 + F.exp(-_log_odds(weights)))


def fit_votes(patterns: DataFrame, n_rules: int) -> list[float]:
    """Log odds weights from the (votes, n) counts of all documents."""

    def weights_of(good: float, total: float, by_good: list[list[float]], by_all: list[list[float]]) -> list[float]:
        def share(counts: list[float], prior: tuple[float, ...]) -> list[float]:
            whole = [c + PRIOR_COUNT * p for c, p in zip(counts, prior, strict=True)]
            return [x / sum(whole) for x in whole]

        out = [math.log((good + 8) / (total - good + 2))]
        for g, a in zip(by_good, by_all, strict=True):
            for_good, for_bad = share(g, PRIOR["good"]), share([max(y - x, 0.0) for x, y in zip(g, a, strict=True)], PRIOR["bad"])
            out += [math.log(x / y) for x, y in zip(for_good, for_bad, strict=True)]
        return out

    rows = patterns.groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 3**n_rules
    n = np.array([float(r.n) for r in rows])
    cells = np.array([r.votes for r in rows], int).reshape(len(n), n_rules) + 3 * np.arange(n_rules)  # of each pattern, the cell of each rule's vote
    hot = np.zeros((len(n), 3 * n_rules))
    hot[np.arange(len(n))[:, None], cells] = 1.0
    by_all, weights = (n @ hot).reshape(n_rules, 3).tolist(), weights_of(0.0, 0.0, [[0.0] * 3] * n_rules, [[0.0] * 3] * n_rules)
    for _ in range(ROUNDS if n.sum() else 0):
        good = n / (1 + np.exp(-(weights[0] + hot @ np.array(weights[1:]))))
        before, weights = weights, weights_of(float(good.sum()), float(n.sum()), (good @ hot).reshape(n_rules, 3).tolist(), by_all)
        if max(abs(x - y) for x, y in zip(before, weights, strict=True)) < SETTLED:
            break
    return weights


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the counts of ``measures``, base_failed, quality (posterior probability) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows; such documents are never kept.
    A rule whose denominator is 0 abstains.  Rows that repeat an id are judged each on its own; an empty table gives none.
    """
    voted = written(votes(measures(docs, id_col=id_col, text_col=text_col)), "votes")
    patterns = written(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "patterns")  # at most 3**rules rows
    quality = _posterior(fit_votes(patterns, len(RULES)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.withColumn("quality", quality).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))
    return judged.drop("votes").withColumnRenamed("id", id_col)
