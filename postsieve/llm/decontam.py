"""Benchmark decontamination with spaced seeds.

Words are lower-cased runs of letters and digits.  A mask such as ``1101011`` lays its
ones over a run of words and hashes those, so that words under its zeros may differ.
The training texts' seed hashes meet those of the benchmark; a hit fixes an alignment
of text and item.  Along it the words of the two are compared, and the alignment counts
if some ``window`` of them (the whole item if that is shorter) agrees in at least
``percent`` of its words.

Everything is DataFrame functions.  The benchmark's seeds are broadcast while their
number is at most ``broadcast_seeds``; beyond that both sides are shuffled by hash, with
frequent seeds, counted before, dealt out to several tasks.  So are the ids of texts with
hits, up to ``broadcast_ids``, so that texts without one stay where they are.  Hits meet
items and texts in joins that deal out an item or a text of many hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let
from .skew import dealt_join, hot_parts
from .store import written

#: Weight five each; under them every 5th word may differ, wherever the first of these is.
MASKS = ("1110011", "11010101")
#: Weight four, for items shorter than the window: with any one of 5 to 9 words replaced, or any two of 10 to 12, one of these fits between.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
BROADCAST_SEEDS = 500_000
#: Ids of texts with a hit, 8 bytes each, up to which they are broadcast to the texts.
BROADCAST_IDS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(words: Column, masks: Sequence[str]) -> Column:
    """For each word, one hash per mask of the words under the mask's ones from there on; flat, null where the mask reaches past the end."""
    offsets = [[i for i, bit in enumerate(mask) if bit == "1"] for mask in masks]

    def at(hashes: Column) -> Column:
        return F.flatten(F.transform(hashes, lambda h, i: F.array(*[F.when(i + own[-1] < F.size(hashes), F.xxhash64(F.lit(k), h, *[F.get(hashes, i + o) for o in own[1:]])) for k, own in enumerate(offsets)])))

    return let(F.transform(words, lambda w: F.xxhash64(w)), at)


def _best(words: Column, item: Column, start: Column, window: Column) -> Column:
    """The largest number of equal words in any ``window`` along the alignment (item word j, text word start + j), and where it begins in the item."""

    def of_matches(same: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.size(same) - window), lambda a: F.struct(F.aggregate(F.slice(same, a + 1, window), F.lit(0), lambda s, x: s + x).alias("matches"), (-a).alias("at")))
        return F.array_max(sums)

    return let(F.transform(item, lambda w, j: F.coalesce((F.get(words, F.when(start + j >= 0, start + j)) == w).cast("int"), F.lit(0))), of_matches)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: Sequence[str] = MASKS, short_masks: Sequence[str] = SHORT_MASKS, window: int = 13, percent: int = 80, min_words: int = 5, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per (document, benchmark item) that overlap: ids, text_word (where the best window begins in the text), n_words (its length) and n_same.

    Items of fewer than ``min_words`` words are never found; null or empty texts and null ids overlap with nothing.  Rows that repeat an id count as one
    document, which overlaps where any of them does.  At the defaults no overlap of items of five words or more is missed.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    texts = texts.select("id", F.xxhash64("text").alias("digest"), "text")  # texts of one id meet their own hits only
    items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(item_text_col).cast("string")).alias("item_words")).where(F.col("item").isNotNull() & (F.size("item_words") >= min_words))
    items = written(items, "items")
    short = F.size("item_words") < window
    n_long = len(masks)
    if not items.where(short).isEmpty():
        masks = (*masks, *short_masks)
    k = len(masks)
    item_seeds = items.select("item", short.alias("short"), F.posexplode(_seeds(F.col("item_words"), masks)).alias("q", "seed"))
    item_seeds = item_seeds.where(F.col("short") | (F.expr(f"q % {k}") < n_long)).select("seed", "item", F.expr(f"q div {k}").cast("int").alias("item_at"))
    item_seeds = written(item_seeds.where("seed is not null").distinct(), "seeds")
    text_seeds = texts.select("id", "digest", F.posexplode(_seeds(_words(F.col("text")), masks)).alias("p", "seed")).where("seed is not null")
    if item_seeds.count() <= broadcast_seeds:
        met = text_seeds.join(F.broadcast(item_seeds), "seed")
    else:
        counted = text_seeds.groupBy("seed").agg(F.count("*").alias("m"))  # summed before the shuffle
        counted = written(counted.join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "seed-counts")
        total = counted.agg(F.sum("m")).first()[0] or 0
        met = dealt_join(text_seeds, item_seeds, ["seed"], hot_parts(counted, ["seed"], count="m", total=total), spread=["id", "digest", "p"])
    hits = met.select("id", "digest", "item", (F.expr(f"p div {k}").cast("int") - F.col("item_at")).alias("start")).distinct()
    hits = written(hits, "hits")

    n_hits = hits.count()
    of_item = hits.groupBy("item").agg(F.count("*").alias("m"))
    of_text = written(hits.groupBy("id", "digest").agg(F.count("*").alias("m")), "hit-texts")
    ids = of_text.select("id", "digest")
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    hit_texts = texts.join(ids, ["id", "digest"], "left_semi").select("id", "digest", _words(F.col("text")).alias("words"))
    aligned = dealt_join(hits, items, ["item"], hot_parts(of_item, ["item"], count="m", total=n_hits), spread=["id", "digest", "start"])
    aligned = dealt_join(aligned, hit_texts, ["id", "digest"], hot_parts(of_text, ["id", "digest"], count="m", total=n_hits), spread=["item", "start"])
    length = F.least(F.lit(window), F.size("item_words"))
    judged = aligned.select("id", "item", "start", length.alias("n_words"), _best(F.col("words"), F.col("item_words"), F.col("start"), length).alias("best"))
    judged = judged.where(100 * F.col("best.matches") >= percent * F.col("n_words"))
    best = judged.groupBy("id", "item").agg(F.max(F.struct(F.col("best.matches").alias("n_same"), (-(F.col("start") - F.col("best.at"))).alias("at"), "n_words")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.at")).cast("long").alias("text_word"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.n_same").cast("long").alias("n_same"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without those that overlap with the benchmark; rows with a null id stay."""
    return docs.join(find_leaks(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), id_col, "left_anti").select(docs.columns)
