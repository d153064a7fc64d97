"""Column functions on text."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that Java's case-sensitive, Unicode-aware classes need a flag for.
_U = "(?U)"


def quote(literal: str) -> str:
    """``literal`` as a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~<>!=:-])", r"\\\1", literal)


def py_strip(c: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(c, _U + r"^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    """Whether there is anything but white space of any Unicode kind; false for null.  The search ends at the first such character."""
    return F.coalesce(c.rlike(_U + r"\S"), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(py_strip(c), F.lit(""))


def fingerprint(company: Column, title: Column) -> Column:
    """A posting's identity; where it is has no part in it.  Null parts count as empty."""
    return F.concat_ws("||", F.lower(py_strip(F.coalesce(company, F.lit("")))), F.lower(py_strip(F.coalesce(title, F.lit("")))))


def word_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword stands in ``text`` between word boundaries; false for no keyword or a null text."""
    if not keywords:
        return F.lit(False)
    return F.coalesce(text.rlike(_U + r"\b(?:" + "|".join(map(quote, keywords)) + r")\b"), F.lit(False))


def contains_any(text: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return F.coalesce(text.rlike("|".join(map(quote, patterns))), F.lit(False))


def first_word(text: Column, keywords: Sequence[tuple[str, str]]) -> Column:
    """Of (name, word) pairs, the name of the first whose word stands in ``text``; null for none."""
    if not keywords:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(word_any(text, [word]), F.lit(name)) for name, word in keywords])


def first_contained(text: Column, patterns: Sequence[str]) -> Column:
    if not patterns:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in patterns])


def md_unescape(c: Column) -> Column:
    """Markdown's backslash before ASCII punctuation taken out."""
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def norm_title(c: Column) -> Column:
    """Lower case, without bracketed parts, letters and digits only, single spaces."""
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]", " "), " +", " "))


def slugify(c: Column, length: int = 50) -> Column:
    """For file names: reserved characters out, white space to single hyphens, cut, no hyphen, dot or space at the end."""
    kept = F.regexp_replace(c, r'[<>:"/\\|?*]', "")
    joined = F.regexp_replace(F.regexp_replace(py_strip(kept), _U + r"\s+", "-"), "-+", "-")
    return F.regexp_replace(F.substring(joined, 1, length), "[-. ]+$", "")


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def cap_list(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def salary_text(low: Column, high: Column) -> Column:
    """``$a - $b``, ``$a+`` or empty; 0 counts as unknown."""
    has_low, has_high = F.coalesce(low, F.lit(0)) != 0, F.coalesce(high, F.lit(0)) != 0
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    return F.when(has_low & has_high, F.concat(money(low), F.lit(" - "), money(high))).when(has_low, F.concat(money(low), F.lit("+"))).otherwise("")


#: What a sheet says of a sponsor.
SPONSORSHIP = ("Verified sponsor", "No H-1B history", "Unknown")


def sponsorship_label(verified: Column, yes: str = SPONSORSHIP[0], no: str = SPONSORSHIP[1], unknown: str = SPONSORSHIP[2]) -> Column:
    return F.when(verified, yes).when(~verified, no).otherwise(unknown)


def source_family(source: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.split_part(source, F.lit("-"), F.lit(1))), F.lit("")), F.lit("unknown"))


def month(date_text: Column) -> Column:
    return F.substring(date_text, 1, 7)


def classify_first_match(text: Column, classes: Sequence[tuple[str, str]], default: str = "Other") -> Column:
    """The label of the first (label, regular expression) that occurs in ``text``, whatever the case."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in classes], F.lit(default))


def map_values(c: Column, table: Mapping[str, str]) -> Column:
    """``c`` lower-cased and stripped, looked up; unknown values pass through."""
    key = F.lower(py_strip(c))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], key)


def clean_confidence(c: Column) -> Column:
    """A number truncated and held to 1 to 5; null for anything else, ``true`` and ``false`` included."""
    number = F.when(~F.lower(c).isin("true", "false"), c.try_cast("double"))
    number = F.when(~F.isnan(number) & (F.abs(number) < 1e9), number)
    return F.when(number.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), number.cast("int"))))


def valid_likelihood(c: Column) -> Column:
    return c.isNull() | c.between(0, 100)


def skill_label(key: Column, labels: Mapping[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[key] if labels else F.lit(None).cast("string")
    return F.coalesce(known, F.replace(key, F.lit("_"), F.lit(" ")))


#: Words of a legal form that a board's token leaves out, wherever they stand.
SLUG_LEGAL_WORDS = ("inc", "llc", "corp", "corporation", "ltd", "limited", "co", "plc", "llp", "lp", "gmbh", "the")


def slug_candidates(company: Column, legal: Sequence[str] = SLUG_LEGAL_WORDS, low: int = 3, high: int = 40) -> Column:
    """Token shapes that a job board may know a company by, at most seven and none twice."""
    bare = F.regexp_replace(company, r"[\(\[].*?[\)\]]", " ")
    bare = F.split(bare, r"[|,]| - ")[0]
    bare = F.regexp_replace(bare, r"(?i)\b(?:" + "|".join(map(quote, legal)) + r")\b\.?", " ")
    parts = F.filter(F.split(F.regexp_replace(bare, r"[^A-Za-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    joined, caps = F.array_join(parts, ""), F.transform(parts, lambda w: F.initcap(w))
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    shapes = F.array(F.lower(joined), joined, F.array_join(caps, ""), F.lower(first), F.get(caps, F.lit(0)), F.lower(F.concat(first, second)), F.concat(F.get(caps, F.lit(0)), F.get(caps, F.lit(1))))
    return F.filter(F.array_distinct(F.array_compact(shapes)), lambda x: F.length(x).between(low, high))


def humanize_token(token: Column) -> Column:
    """A board token as a name: camel case, hyphens and underscores split, words that aren't capitals capitalised."""
    spaced = F.regexp_replace(F.regexp_replace(token, "(?<=[a-z0-9])(?=[A-Z])", " "), "[-_]+", " ")
    words = F.filter(F.split(F.trim(spaced), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w == F.upper(w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))), " ")


#: What stands for common marks that plain text has no character for.
ASCII_MARKS = {
    "\u2014": "-", "\u2013": "-", "\u2012": "-", "\u2010": "-", "\u2011": "-", "\u2212": "-", "\u2192": " to ", "\u2194": " to ", "\u2190": " from ", "\u00b7": ", ", "\u2022": ", ",
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u2032": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2033": '"', "\u2026": "...", "\u200b": "", "\u2713": "", "\u2714": "", "\u2717": "", "\u2718": "",
    "\u00d7": "x", "\u2122": "", "\u00ae": "", "\u00a9": "", "\u2260": " not equal to ", "\u2265": "at least ", "\u2264": "at most ",
}


#: Characters from here on count as one range if fewer than so many lie between them, so that the class has few ranges to try.
_COARSE_FROM, _COARSE_GAP = 0x590, 512


@functools.cache
def _folds_to_ascii() -> str:
    """A class that has the characters whose compatibility composition holds ASCII, and those that may join an ASCII letter before them."""
    found = [p for p in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(p)) or any(ch < "\x80" for ch in unicodedata.normalize("NFKC", chr(p)))]
    ranges: list[list[int]] = []
    for p in found:
        if ranges and p - ranges[-1][1] <= (1 if p < _COARSE_FROM else _COARSE_GAP):
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return r"(?=[^\x00-\x7F])[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def folded_to_ascii(c: Column) -> Column:
    """The text with compatibility composition, which Spark has no function for, as far as it matters for ASCII; what has no ASCII form is as it was or composed.

    A Python function is given every row whatever condition stands round it, so texts that need none of it are null there.
    """
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(fold(F.when(c.rlike(_folds_to_ascii()), c)), c)


def sanitize_ascii(c: Column, marks: Mapping[str, str] = ASCII_MARKS, keep_ampersand: bool = False) -> Column:
    """ASCII text: marks replaced, signs before numbers spelled out, other angle brackets and what has no ASCII form to spaces, tidy spacing.

    Signs are rewritten before characters are composed.
    """
    out = c
    single = {mark: plain for mark, plain in marks.items() if len(mark) == 1 and len(plain) <= 1}
    kept = sorted(single, key=lambda mark: not single[mark])  # those without a counterpart last
    out = F.translate(out, "".join(kept), "".join(single[mark] for mark in kept)) if kept else out
    for mark, plain in marks.items():
        if mark not in single:
            out = F.replace(out, F.lit(mark), F.lit(plain))
    out = F.regexp_replace(F.regexp_replace(out, r"(at (?:least|most) )\s+", "$1"), r"<\s*(?=[\d$.])", "under ")
    out = F.regexp_replace(F.regexp_replace(out, r">\s*(?=[\d$.])", "over "), "[<>]", " ")
    if not keep_ampersand:
        out = F.regexp_replace(out, r"\s+&\s+", " and ")
    out = F.regexp_replace(folded_to_ascii(out), r"[^\x00-\x7F]", " ")
    return py_strip(F.regexp_replace(F.regexp_replace(out, r"\s+([,;])", "$1"), "[ \t]{2,}", " "))


def keyword_coverage(text: Column, keywords: Column) -> tuple[Column, Column]:
    """(share of the non-empty keywords found, those missing); 1 for no keyword."""
    flat = F.lower(F.regexp_replace(F.replace(text, F.lit("*"), F.lit("")), r"\s+", " "))
    asked = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != "")
    missing = F.filter(asked, lambda k: ~F.contains(flat, F.lower(k)))
    share = F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(1 - F.size(missing) / F.greatest(F.size(asked), F.lit(1)))
    return share, missing


#: A JSON text as strings, brackets and what stands between them.
_JSON_PARTS = r'(?s)"(?:[^"\\]++|\\.)*+"?|[\[\]{}]|[^"\[\]{}]++'

_JSON_SCALAR = r'^(?:"(?:[^"\\]++|\\.)*+"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$'


def _balanced(text: Column) -> Column:
    """From the first opening bracket to the one that closes it, brackets inside strings not counted; null if it never closes."""
    parts = F.regexp_extract_all(F.regexp_extract(text, r"(?s)[\[{].*", 0), F.lit(_JSON_PARTS), F.lit(0))

    def span(p: Column) -> Column:
        opens, closes = p[0], F.when(p[0] == "{", "}").otherwise("]")

        def step(state: Column, x: Column) -> Column:
            depth = state["depth"] + (x == opens).cast("int") - (x == closes).cast("int")
            done = state["end"] > 0
            return F.struct(F.when(done, state["depth"]).otherwise(depth).alias("depth"), (state["at"] + 1).alias("at"), F.when(done, state["end"]).when(depth == 0, state["at"] + 1).otherwise(0).alias("end"))

        end = F.aggregate(p, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")), step)["end"]
        return F.when(end > 0, F.array_join(F.slice(p, 1, end), ""))

    return F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, span(p)))[0]


def json_from_reply(c: Column) -> Column:
    """The JSON of a reply: that of its first fenced block if it has one, as a whole, or else the first balanced object or array in it; null if that does not parse."""
    fence = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
    body = F.when(c.rlike(fence), py_strip(F.regexp_extract(c, fence, 1))).otherwise(py_strip(c))

    def parsed(text: Column) -> Column:
        # Spark's parser minds nothing that stands behind a value, so a whole text only passes as a scalar or as one balanced span.
        span = F.transform(F.array(_balanced(text)), lambda t: F.when(F.try_parse_json(t).isNotNull(), t))[0]
        return F.when(text.rlike(_JSON_SCALAR), text).otherwise(span)

    return F.transform(F.array(body), parsed)[0]


def dedup_tokens(tokens: Column) -> Column:
    """The first of tokens that differ by case alone, in order."""
    return F.aggregate(tokens, F.expr("cast(array() as array<string>)"), lambda done, t: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(t)), done).otherwise(F.array_append(done, t)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


# Names whose slash is their own; platforms that name their parts; words that mark a note rather than a product.
SLASH_NAMES = ("tcp/ip", "ci/cd", "ui/ux", "i/o", "a/b", "s/mime", "r/w", "os/2", "24/7")
PLATFORMS = ("aws", "azure", "gcp", "google cloud", "amazon web services")
QUALIFIERS = ("certified", "certification", "cert", "experience", "proficient", "basic", "advanced", "familiar", "familiarity", "exposure", "coursework", "learning")


def normalize_skill_items(items: Column, cap: int = 12, most_parts: int = 5) -> Column:
    """Skill items taken apart into single names, the first of those that differ by case alone, at most ``cap``.

    ``Cloud (A, b)`` gives the name and those parts that read as products, behind the name of a platform; a bracket with text
    behind it is dropped.  Commas and semicolons split, slashes too in two or three parts of two letters or more.  The first new
    name of an item in ``**`` carries them.  A null item makes the result null.
    """

    def product(part: Column) -> Column:
        note = r"(?:^|\s)[.,()]*+(?:" + "|".join(map(quote, QUALIFIERS)) + r")[.,()]*+(?:\s|\z)"
        # A word in capitals or digits behind its marks, or one of marks alone, as which a line's end counts too.
        word = r"(?=\S)[().,-]*+(?:(?=[\p{Lu}\d])\S*+|[\x85\u2028\u2029]?+[().,-]*+(?=\s|\z))"
        return part.rlike(rf"^\s*+{word}(?:\s++{word}){{0,2}}\s*+\z") & ~F.lower(part).rlike(note)

    def bracketed(text: Column) -> Column:
        head, inner = (F.trim(F.regexp_extract(text, r"^([^(]+?)\s*\(([^()]*)\)\s*\z", i)) for i in (1, 2))
        parts = F.slice(F.filter(F.transform(F.split(inner, "[,;]"), lambda y: F.trim(y)), product), 1, most_parts)
        platform = lambda h: F.when(F.lower(h).isin(*PLATFORMS), F.transform(parts, lambda p: F.concat(h, F.lit(" "), p))).otherwise(parts)
        dropped = F.coalesce(F.nullif(F.trim(F.regexp_replace(text, r"\s*\([^()]*\)", "")), F.lit("")), text)
        apart = lambda h: F.when(h != "", F.concat(F.array(h), platform(h))).otherwise(F.array(F.when(text.rlike(r"^[^(]+\([^()]*\)"), dropped).otherwise(text)))
        return _bound(head, apart)

    def expanded(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("(")), bracketed(text)).otherwise(F.array(text))

    def separated(e: Column) -> Column:
        return F.when(F.contains(e, F.lit(",")) | F.contains(e, F.lit(";")), F.split(e, r"\s*[,;]\s*")).otherwise(F.array(e))

    def unslashed(x: Column) -> Column:
        kept = lambda parts: F.lower(x).isin(*SLASH_NAMES) | (F.size(parts) > 3) | F.exists(parts, lambda p: F.length(p) < 2)
        parts = _bound(F.transform(F.split(x, "/"), lambda y: F.trim(y)), lambda parts: F.when(kept(parts), F.array(x)).otherwise(parts))
        return F.when(F.contains(x, F.lit("/")), parts).otherwise(F.array(x))

    def names(item: Column, i: Column) -> Column:
        split = F.flatten(F.transform(_bound(F.trim(F.replace(item, F.lit("**"), F.lit(""))), expanded), separated))
        plain = F.transform(F.flatten(F.transform(F.transform(split, lambda p: F.trim(p)), unslashed)), lambda t: F.btrim(t, F.lit(" ,;.")))
        named = F.transform(F.filter(plain, lambda t: t != ""), lambda t: F.struct(t.alias("t"), F.lower(t).alias("key"), F.when(F.contains(item, F.lit("**")), i).alias("bold")))
        return F.when(item.isNotNull(), named)

    def firsts(flat: Column) -> Column:
        return _bound(flat["key"], lambda keys: F.filter(flat, lambda x, at: F.array_position(keys, x["key"]) == at + 1))

    def marked(new: Column) -> Column:
        first = lambda x, at: F.coalesce(F.get(new, at - 1)["bold"] != x["bold"], F.lit(True))
        return F.transform(new, lambda x, at: F.when(x["bold"].isNotNull() & first(x, at), F.concat(F.lit("**"), x["t"], F.lit("**"))).otherwise(x["t"]))

    new = _bound(F.flatten(F.transform(items, names)), firsts)
    return F.slice(_bound(new, marked), 1, cap)
