"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its lower-cased words.  The edit bound is one word inserted, deleted or
replaced, for lines of at least ``min_words`` words (five: a similarity of 0.8 or more);
shorter lines must be equal.  A line goes if an earlier one, by document id and line
number, is equal or within the bound.  Lines without a word always stay.

1. Equal lines become one, by a 128-bit hash, with the place of the first.
2. Within one edit, either the first or the last half of the words is the same in both
   lines, so a line none of whose halves occurs in another has no neighbour.
3. The others emit their variants, themselves and one for each deleted word, as hashed keys.
   Lines of equal length meet in the variant without the same word, and the earliest of
   each such group stands for it; lines whose lengths differ by one meet where the variant of one is
   the other.  No pair is made within a group, so a frequent variant costs no more than its rows.
4. Candidates are compared word by word.

Counts are taken before each join, and a frequent line, half or variant is dealt out to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import BLANKS, let
from .skew import dealt_join, hot_parts
from .store import written

MIN_WORDS = 5
_MASK = (1 << 44) - 1
_PLACE = ["id", "digest", "line"]
_KEY = ["k1", "k2"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return rows.select("id", F.xxhash64("text").alias("digest"), "text")


def _lines(text: Column) -> Column:
    """The lower-cased lines of a text, with blanks for all other characters between words."""
    return F.split(F.regexp_replace(F.lower(text), r"[\x09\x0B-\x0D]", " "), "\n")


def _words(line: Column) -> Column:
    """The words of one of ``_lines``: one character splits faster than a pattern."""
    return F.array_remove(F.split(line, " "), "")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the text, line number and words of every line that has any."""
    lines = _texts(docs, id_col, text_col).select("id", "digest", F.posexplode(_lines(F.col("text"))).alias("line", "text"))
    # Of the line and not of its words, which the optimizer would else look for twice.
    return lines.where(F.btrim("text", F.lit(BLANKS)) != "").select("id", "digest", "line", _words(F.col("text")).alias("words"))


def _halves(w: Column, min_words: int) -> Column:
    n = F.size(w)

    def ends(t: Column) -> Column:
        return F.array(F.xxhash64(F.lit(1), t, F.slice(w, 1, t)), F.xxhash64(F.lit(2), t, F.slice(w, n - t + 1, t)))

    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(n < min_words, F.lit(None)).when(half == less, ends(half)).otherwise(F.concat(ends(half), ends(less)))


def _variants(w: Column) -> Column:
    """(length, gap, place_key, place_check, order_key) of the line (gap -1) and of every deletion.

    place_key and place_check are exclusive ors of 64-bit hashes of (word, place) without the gap's: equal for equal lines with any word at
    the gap, and only for those, at 128 bits.  order_key sums hashes of adjacent words after the deletion, whatever the places; as its candidates are
    all compared, one too many does no harm.
    """
    n = F.size(w)

    def small(*parts: Column) -> Column:
        return F.xxhash64(*parts).bitwiseAND(F.lit(_MASK))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)

    def edge(left: Column, right: Column) -> Column:
        return small(F.lit(3), F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))

    def whole(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))

    placed = F.transform(w, lambda x, i: F.xxhash64(x, i))
    edges = F.transform(F.sequence(F.lit(0), n), lambda i: edge(F.get(w, i - 1), F.get(w, i)))

    def build(v: Column) -> Column:
        p, q, e, all_p, all_q, sum_e = v["p"], v["q"], v["e"], v["all_p"], v["all_q"], v["sum_e"]

        def variant(i: Column, key: Column, check: Column, order: Column) -> Column:
            return F.struct(n.alias("length"), i.alias("gap"), key.alias("place_key"), check.alias("place_check"), order.alias("order_key"))

        cut = F.transform(
            w,
            lambda x, i: variant(i, all_p.bitwiseXOR(F.get(p, i)), all_q.bitwiseXOR(F.get(q, i)), sum_e - F.get(e, i) - F.get(e, i + 1) + edge(F.get(w, i - 1), F.get(w, i + 1))).withField("length", n - 1),
        )
        return F.concat(F.array(variant(F.lit(-1), all_p, all_q, sum_e)), cut)

    def totals(v: Column) -> Column:
        return let(F.struct(v["p"].alias("p"), v["q"].alias("q"), v["e"].alias("e"), whole(v["p"]).alias("all_p"), whole(v["q"]).alias("all_q"), total(v["e"]).alias("sum_e")), build)

    return let(F.struct(placed.alias("p"), edges.alias("e")), lambda v: let(F.struct(v["p"].alias("p"), F.transform(v["p"], lambda h, i: F.xxhash64(F.lit(5), h, F.get(w, i))).alias("q"), v["e"].alias("e")), totals))


def _near(a: Column, b: Column) -> Column:
    """Whether two different word lists are one inserted, deleted or replaced word apart: the words before the first difference and after it agree."""

    def one_apart(shorter: Column, longer: Column) -> Column:
        differ = F.filter(F.transform(longer, lambda x, i: F.when(x.eqNullSafe(F.get(shorter, i)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())

        def rest(at: Column) -> Column:
            tail = F.slice(longer, at + 2, F.size(longer))
            return tail == F.slice(shorter, at + 1 + F.when(F.size(shorter) == F.size(longer), 1).otherwise(0), F.size(longer))

        return let(F.get(differ, F.lit(0)), rest)

    return F.when(F.size(a) <= F.size(b), one_apart(a, b)).otherwise(one_apart(b, a))


def line_decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, digest, line, near) of every line with words, near null where it stays, else false (equal to an earlier line) or true.

    Lines are counted from 0 within the text; digest tells texts apart that repeat an id, and rows that repeat both are
    one document.  Null texts and rows with a null id have no lines here.  Ids are whole numbers; an id that does not read as one raises
    CAST_INVALID_INPUT.  ``min_words`` belongs to the bound: one edit in fewer than five words is a similarity of less than 0.8; at 1 the bound holds for lines of any length.
    """
    numbered = _numbered(docs, id_col, text_col)
    w = F.col("words")
    lines = written(numbered.select(*_PLACE, F.xxhash64(w).alias("k1"), F.xxhash64(F.lit(7), w).alias("k2"), _halves(w, min_words).alias("halves")), "lines")
    n_lines = lines.count()
    classes = written(lines.groupBy(*_KEY).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("copies")), "classes")

    halves = lines.where("halves is not null").select("k1", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("k1").alias("least"), F.max("k1").alias("most"), F.count("*").alias("m")).where("least <> most")
    met = written(met.select("half", "m"), "met")
    meeting = dealt_join(halves, met.select("half"), ["half"], hot_parts(met, ["half"], count="m", total=4 * n_lines), spread=["k1"]).select("k1").distinct()
    # Their texts are joined by document, so that no other line is taken apart again.
    places = classes.join(meeting, "k1", "left_semi").select("first.*", *_KEY).groupBy("id", "digest").agg(F.collect_list(F.struct("line", *_KEY)).alias("places"))
    found = _texts(docs, id_col, text_col).join(places, ["id", "digest"])
    found = found.select("id", "digest", F.explode(let(_lines(F.col("text")), lambda x: F.transform("places", lambda p: F.struct(p["line"].alias("line"), p["k1"].alias("k1"), p["k2"].alias("k2"), _words(F.get(x, p["line"])).alias("words"))))).alias("p"))
    active = written(found.select("id", "digest", "p.*").dropDuplicates(_KEY), "active")

    variants = written(active.select(*_PLACE, *_KEY, F.explode(_variants(w)).alias("v")).select(*_PLACE, *_KEY, "v.*"), "variants")
    variants = variants.select(F.struct(*_PLACE, *_KEY).alias("at"), "length", "gap", "place_key", "place_check", "order_key")
    gaps = variants.where("gap >= 0")
    group = ["length", "gap", "place_key", "place_check"]
    n_gaps = gaps.count()
    earliest = gaps.groupBy(*group).agg(F.min("at").alias("other"), F.max("at").alias("last"), F.first("order_key").alias("order_key"), F.count("*").alias("m"))
    earliest = written(earliest.where("other <> last").select(*group, "order_key", "other", "m"), "earliest")
    replaced = dealt_join(gaps, earliest.select(*group, "other"), group, hot_parts(earliest, group, count="m", total=n_gaps), spread=["at"]).select("at", "other")
    whole = variants.where("gap < 0").select("length", "order_key", F.col("at").alias("other"))
    # The variants of an order key are one group for each gap, and only groups of one row are not counted here: at most a line's length of them.
    orders = earliest.groupBy("length", "order_key").agg(F.sum("m").alias("m"))
    inserted = dealt_join(gaps, whole, ["length", "order_key"], hot_parts(orders, ["length", "order_key"], count="m", total=n_gaps), spread=["at"]).select("at", "other")
    pairs = replaced.union(inserted).select(F.greatest("at", "other").alias("a"), F.least("at", "other").alias("b"))
    # "Later" is by place alone; the keys behind it only settle equal places.
    pairs = pairs.where(F.struct("a.id", "a.digest", "a.line") != F.struct("b.id", "b.digest", "b.line")).select(F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")).distinct()
    texts = active.select(*_KEY, "words")
    pairs = pairs.join(texts.toDF("a1", "a2", "words_a"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "words_b"), ["b1", "b2"])
    near = pairs.where(_near(F.col("words_a"), F.col("words_b"))).select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).distinct().withColumn("near", F.lit(True))

    verdicts = classes.drop("copies").join(near, _KEY, "left")
    judged = dealt_join(lines.select(*_PLACE, *_KEY), verdicts, _KEY, hot_parts(classes, _KEY, count="copies", total=n_lines), spread=_PLACE)
    later = F.struct(*_PLACE) != F.col("first")
    return judged.select(*_PLACE, F.coalesce("near", F.when(later, False)).alias("near"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that ``line_decisions`` drops taken out of the text; other columns, nulls and rows with a null id as they are."""
    gone = line_decisions(docs, id_col=id_col, text_col=text_col, min_words=min_words).where("near is not null").distinct()
    gone = gone.groupBy("id", "digest").agg(F.collect_set("line").alias("lines")).alias("g")
    rows, text = docs.alias("d"), F.col(f"d.`{text_col}`")
    joined = rows.join(gone, (F.col(f"d.`{id_col}`").cast("long") == F.col("g.id")) & (F.xxhash64(text.cast("string")) == F.col("g.digest")), "left")
    left = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains("g.lines", i), x)), lambda x: x.isNotNull())
    cut = F.when(F.col("g.lines").isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
