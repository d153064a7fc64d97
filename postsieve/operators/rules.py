"""The ordered rule gate: which rule stops a posting first, and why."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import contains_any, first_contained, first_word, has_text, md_unescape, quote, word_any

#: Number words that a requirement may use.
NUMBER_WORDS = {"four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
_NUMBER = r"(?:\d{1,2}|" + "|".join(NUMBER_WORDS) + ")"
#: Shapes of a requirement; only the first match of each is looked at.
REQUIREMENTS = (
    rf"\b({_NUMBER})\s*(?:\+|or more)\s*years?\b",
    rf"\b(?:at least|minimum(?:\s+of)?)\s+({_NUMBER})\s*years?\b",
    rf"\b({_NUMBER})\s*(?:-|to)\s*{_NUMBER}\+?\s*years?\b",
)
#: Fixed value: the plain shape, of which all matches are looked at, unless a range's lower bound or "over" stands before.
PLAIN_REQUIREMENT = rf"(?<!\d\s{{0,4}}(?:-|to)\s{{0,4}})(?<!over.{{0,11}})\b({_NUMBER})\+?\s*years?\s+(?:of\s+)?(?:[a-z][a-z\-]*\s+){{0,3}}experience\b"


@dataclass(frozen=True)
class GateConfig:
    """What the gate asks for; empty lists ask for nothing, but an empty ``domain_words`` admits no title."""

    domain_words: Sequence[str] = ()
    core_words: Sequence[str] = ()
    model_words: Sequence[str] = ()
    model_exemptions: Sequence[str] = ()
    it_words: Sequence[str] = ()
    it_blockers: Sequence[str] = ()
    title_exclusions: Sequence[str] = ()
    location_patterns: Sequence[str] = ()
    description_stops: Sequence[str] = ()
    sponsorship_stops: Sequence[str] = ()
    sponsorship_filter: bool = False
    required_words: Sequence[str] = ()
    required_count: int = 3
    salary_floor: int = 0
    min_years: int = 99
    droppable_sources: Sequence[str] = ("linkedin", "indeed", "google")
    droppable_prefixes: Sequence[str] = field(default_factory=lambda: ("workday-", "greenhouse-", "lever-", "ashby-"))

    @property
    def stops(self) -> list[str]:
        return [p.lower() for p in (*self.description_stops, *(self.sponsorship_stops if self.sponsorship_filter else ()))]


def title_admission(title: Column, cfg: GateConfig) -> Column:
    """The family that admits a title: ``core``, ``it_identity`` or null."""
    t = F.lower(title)
    unsupported = word_any(t, cfg.model_words) & ~word_any(t, [*(cfg.core_words or cfg.domain_words), *cfg.model_exemptions])
    return F.when(unsupported, None).when(word_any(t, cfg.domain_words), "core").when(word_any(t, cfg.it_words) & ~word_any(t, cfg.it_blockers), "it_identity")


def _exclusion_words(cfg: GateConfig) -> list[tuple[str, str]]:
    return [(kw, kw.strip().rstrip(".")) for kw in cfg.title_exclusions]


def title_exclusion(title: Column, cfg: GateConfig) -> Column:
    """The first listed word in the title, null for none; the list is only walked for titles that have one."""
    t, pairs = F.lower(title), _exclusion_words(cfg)
    return F.when(word_any(t, [w for _, w in pairs]), first_word(t, pairs))


def title_passes(title: Column, cfg: GateConfig) -> Column:
    return ~word_any(F.lower(title), [w for _, w in _exclusion_words(cfg)]) & title_admission(title, cfg).isNotNull()


def location_excluded(location: Column, cfg: GateConfig) -> Column:
    return contains_any(F.lower(location), cfg.location_patterns)


def salary_below(salary_max: Column, floor: int) -> Column:
    return F.coalesce(salary_max < floor, F.lit(False))


def desc_hard_stop(description: Column, cfg: GateConfig) -> Column:
    text = md_unescape(F.lower(description))
    return F.when(contains_any(text, cfg.stops), first_contained(text, cfg.stops))


def years_value(token: Column) -> Column:
    """A number or number word; two rising digits from 16 on are a range that lost its dash."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    t = F.lower(F.trim(token))
    n = t.try_cast("int")
    return F.coalesce(words[t], F.when((n >= 16) & (F.substring(t, 1, 1) < F.substring(t, 2, 1)), F.substring(t, 1, 1).try_cast("int")).otherwise(n), F.lit(0))


def experience_stop(description: Column, min_years: int) -> Column:
    """The first requirement of ``min_years`` or more, null for none."""
    text = md_unescape(F.lower(description))
    first = [F.when((F.regexp_extract(text, p, 1) != "") & (years_value(F.regexp_extract(text, p, 1)) >= min_years), F.regexp_extract(text, p, 0)) for p in REQUIREMENTS]
    numbers, matches = F.regexp_extract_all(text, F.lit(PLAIN_REQUIREMENT), F.lit(1)), F.regexp_extract_all(text, F.lit(PLAIN_REQUIREMENT), F.lit(0))
    plain = F.filter(F.arrays_zip(numbers.alias("n"), matches.alias("m")), lambda x: years_value(x["n"]) >= min_years)
    return F.coalesce(*first, F.get(plain, F.lit(0))["m"])


def keyword_support(title: Column, description: Column, keywords: Sequence[str]) -> Column:
    """How many of the listed words stand in title and description."""
    text = F.concat_ws(" ", F.lower(title), md_unescape(F.lower(description)))
    return sum((word_any(text, [k.lower()]).cast("int") for k in keywords), F.lit(0))


def _rules(cfg: GateConfig, title_only: bool, described: Column | None) -> list[tuple[str, Column, Column]]:
    """(stage, whether it stops the row, reason), in order."""
    title, location, description, high = (F.col(c) for c in ("title", "location", "description", "salary_max"))
    excluded = title_exclusion(title, cfg)
    gate = [
        ("stage1_title", excluded.isNotNull(), F.concat(F.lit("Title exclusion: '"), excluded, F.lit("' matched in '"), title, F.lit("'"))),
        ("stage1_title_domain", title_admission(title, cfg).isNull(), F.concat(F.lit("No domain keyword in title: '"), title, F.lit("'"))),
    ]
    if title_only:
        return gate
    stop, years = desc_hard_stop(description, cfg), experience_stop(description, cfg.min_years)
    rules = [("stage1_location", location_excluded(location, cfg), F.concat(F.lit("Excluded location: '"), location, F.lit("'"))), *gate]
    rules.append(("stage1_salary", salary_below(high, cfg.salary_floor), F.concat(F.lit("Salary max $"), F.format_number(high, 0), F.lit(" below floor $"), F.format_number(F.lit(cfg.salary_floor), 0))))
    rules.append(("stage1_no_desc", ~(has_text(description) if described is None else described), F.lit("No description")))
    if cfg.stops:
        rules.append(("stage1_desc", stop.isNotNull(), F.concat(F.lit("Description hard-stop: '"), stop, F.lit("'"))))
    if cfg.min_years < 99:
        rules.append(("stage1_desc", years.isNotNull(), F.concat(F.lit("YOE requirement: '"), F.trim(years), F.lit("'"))))
    if cfg.required_words:
        n = keyword_support(title, description, cfg.required_words)
        rules.append(("stage1_keywords", n < cfg.required_count, F.concat(F.lit("Only "), n.cast("string"), F.lit(f"/{cfg.required_count} required keywords found"))))
    return rules


def rule_gate(df: DataFrame, cfg: GateConfig, title_only: bool = False, described: Column | None = None) -> DataFrame:
    """``df`` with the stage of the first rule that stops a row (``stage1_pass`` for none) and the reason.

    Both come from one CASE, so a row is asked no rule behind the one that stops it.  ``described`` tells which rows have a description (never null) where the texts
    themselves are elsewhere; a gate with rules on texts can't do without them.
    """
    if described is not None and (cfg.stops or cfg.min_years < 99 or cfg.required_words):
        raise ValueError("rules on descriptions need the descriptions")
    rules = _rules(cfg, title_only, described)
    verdict = None
    for stage, stops, reason in rules:
        found = F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))
        verdict = F.when(stops, found) if verdict is None else verdict.when(stops, found)
    verdict = verdict.otherwise(F.struct(F.lit("stage1_pass").alias("stage"), F.lit("Passed all rules").alias("reason")))
    return df.withColumn("__v", verdict).select(*df.columns, F.col("__v.stage").alias("stage"), F.col("__v.reason").alias("reason"))


def split_by_description(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    has = has_text(F.col("description"))
    return df.where(has), df.where(~has)


def promote_filled(pending: DataFrame, details: DataFrame, key: str, cfg: GateConfig) -> tuple[DataFrame, DataFrame]:
    """(rows that details have filled, through the whole gate; rows that stay pending)."""
    landed = details.where(has_text(F.col("description"))).groupBy(key).agg(F.max("description").alias("__d"))
    filled = pending.join(landed, key).withColumn("description", F.col("__d")).select(pending.columns)
    return rule_gate(filled, cfg), pending.join(landed, key, "left_anti").select(pending.columns)


def droppable_source(source: Column, cfg: GateConfig) -> Column:
    exact = source.isin(*cfg.droppable_sources) if cfg.droppable_sources else F.lit(False)
    prefix = source.rlike("^(?:" + "|".join(map(quote, cfg.droppable_prefixes)) + ")") if cfg.droppable_prefixes else F.lit(False)
    return F.coalesce(exact | prefix, F.lit(False))


def sponsor_drops(df: DataFrame, cfg: GateConfig, verdict: str = "verified") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): a row goes only if its verdict is false, not unknown, and its source lists such employers fully."""
    gone = F.col(verdict).eqNullSafe(F.lit(False)) & droppable_source(F.col("source"), cfg)
    return df.where(~gone), df.where(gone)


def route(df: DataFrame, min_confidence: int = 3) -> DataFrame:
    c = F.col("confidence")
    return df.withColumn("route", F.when(c.isNull(), "UNSCORED").when(c >= min_confidence, "DAILY").otherwise("REJECT")).withColumn("daily", c.isNull() | (c >= min_confidence))
