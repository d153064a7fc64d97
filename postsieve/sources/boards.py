"""Landed payloads of boards and feeds, normalised to postings.

Every normaliser takes raw rows (``token`` or ``site``, and ``payload`` text as fetched) and
gives the same columns; a payload that can't be read gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.dates import parse_epoch, parse_iso, parse_relative, resolve_location
from postsieve.functions.text import blank_to_null

from .html import strip_tags

POSTING = ("title", "company", "location", "description", "salary_min", "salary_max", "url", "source", "posted_at")
_TEXT = {"title", "company", "location", "description", "url", "source"}


def _posting(df: DataFrame, gate: Column | None = None, **columns: Column) -> DataFrame:
    kinds = {"salary_min": "long", "salary_max": "long", "posted_at": "timestamp"}
    rows = df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in POSTING])
    rows = rows.where(F.trim("title") != "").where(F.trim("company") != "")
    return rows if gate is None else rows.where(gate)


def _items(raw: DataFrame, schema: str, field: str | None = None) -> DataFrame:
    parsed = F.from_json("payload", schema)
    return raw.select(*[c for c in raw.columns if c != "payload"], F.explode(parsed[field] if field else parsed).alias("j"))


def normalize_greenhouse(raw: DataFrame, gate: Column | None = None) -> DataFrame:
    j = _items(raw, "jobs array<struct<title: string, content: string, absolute_url: string, created_at: string, updated_at: string, location: string>>", "jobs")
    location = F.coalesce(F.get_json_object("j.location", "$.name"), F.col("j.location"))
    return _posting(j, gate, title=F.col("j.title"), company=F.coalesce(F.col("name"), F.col("token")), location=location, description=strip_tags(F.col("j.content")), url=F.col("j.absolute_url"), source=F.concat(F.lit("greenhouse-"), "token"), posted_at=F.coalesce(parse_iso(F.col("j.created_at")), parse_iso(F.col("j.updated_at"))))


def normalize_lever(raw: DataFrame, gate: Column | None = None) -> DataFrame:
    arrays = raw.where(F.ltrim("payload").startswith("["))
    j = _items(arrays, "array<struct<text: string, descriptionPlain: string, hostedUrl: string, createdAt: string, categories: struct<location: string>>>")
    return _posting(j, gate, title=F.col("j.text"), company=F.coalesce(F.col("name"), F.col("token")), location=F.col("j.categories.location"), description=F.col("j.descriptionPlain"), url=F.col("j.hostedUrl"), source=F.concat(F.lit("lever-"), "token"), posted_at=parse_epoch(F.col("j.createdAt"), millis=True))


def normalize_ashby(raw: DataFrame, gate: Column | None = None) -> DataFrame:
    j = _items(raw, "jobs array<struct<title: string, location: string, descriptionPlain: string, descriptionHtml: string, jobUrl: string, applyUrl: string, publishedAt: string, publishedDate: string, updatedAt: string>>", "jobs")
    posted = F.coalesce(*[parse_iso(F.col(f"j.{c}")) for c in ("publishedAt", "publishedDate", "updatedAt")])
    return _posting(j, gate, title=F.col("j.title"), company=F.coalesce(F.col("name"), F.col("token")), location=F.col("j.location"), description=F.coalesce(blank_to_null(F.col("j.descriptionPlain")), strip_tags(F.col("j.descriptionHtml"))), url=F.coalesce("j.jobUrl", "j.applyUrl"), source=F.concat(F.lit("ashby-"), "token"), posted_at=posted)


def normalize_remoteok(raw: DataFrame) -> DataFrame:
    """Items without a position are about the feed; a salary of 0 is unknown."""
    j = _items(raw, "array<struct<position: string, company: string, location: string, description: string, salary_min: bigint, salary_max: bigint, url: string, date: string, epoch: string>>").where("j.position is not null")
    return _posting(j, title=F.col("j.position"), company=F.col("j.company"), location=F.coalesce(blank_to_null(F.col("j.location")), F.lit("Remote")), description=strip_tags(F.col("j.description")), salary_min=F.nullif("j.salary_min", F.lit(0)), salary_max=F.nullif("j.salary_max", F.lit(0)), url=F.col("j.url"), source=F.lit("remoteok"), posted_at=F.coalesce(parse_iso(F.col("j.date")), parse_epoch(F.col("j.epoch"))))


def normalize_workday(raw: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    """Rows without a date, or older than ``hours``, are dropped here already."""
    j = _items(raw, "jobPostings array<struct<title: string, locationsText: string, postedOn: string, externalPath: string>>", "jobPostings")
    posted = parse_relative(F.col("j.postedOn"), F.lit(as_of))
    rows = _posting(j, title=F.col("j.title"), company=F.coalesce(F.col("name"), F.col("token")), location=resolve_location(F.col("j.locationsText"), F.col("j.externalPath")), url=F.col("j.externalPath"), source=F.concat(F.lit("workday-"), "token"), posted_at=posted)
    return rows.where(F.col("posted_at") >= F.lit(as_of) - F.make_interval(hours=F.lit(hours)))


def normalize_table(df: DataFrame, site: str, default_location: str) -> DataFrame:
    """Scraped table rows: blanks and NaN to null, numbers and dates coerced, title and company required."""
    text = {c: F.nullif(blank_to_null(F.col(c).cast("string")), F.lit("nan")) for c in ("title", "company", "location", "description", "url")}
    money = {c: F.col(c).cast("string").try_cast("double").cast("long") for c in ("salary_min", "salary_max")}
    return _posting(df, **{**text, "location": F.coalesce(text["location"], F.lit(default_location))}, **{c: F.when(F.isnan(F.col(c).cast("string").try_cast("double")), None).otherwise(v) for c, v in money.items()}, source=F.lit(site), posted_at=F.col("posted_at").cast("string").try_cast("timestamp"))


def parse_pipe_posts(comments: DataFrame, text: str = "text", fallback_url: str = "") -> DataFrame:
    """``Company | Role | Location`` of a comment's first line; the rest is the description."""
    lines = F.split(F.col(text), "\n", 2)
    parts = F.transform(F.split(lines[0], r"\|"), lambda p: F.trim(p))
    rows = comments.withColumn("__p", parts).withColumn("__d", F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    rows = rows.where((F.size("__p") >= 2) & (F.length(F.get("__p", F.lit(0))).between(1, 100)) & (F.length(F.get("__p", F.lit(1))).between(1, 100)))
    url = F.nullif(F.regexp_extract(text, r"https?://[^\s|)>]+", 0), F.lit(""))
    return rows.select(*comments.columns, F.get("__p", F.lit(0)).alias("company"), F.get("__p", F.lit(1)).alias("title"), F.coalesce(blank_to_null(F.get("__p", F.lit(2))), F.lit("Not specified")).alias("location"), F.coalesce(url, F.lit(fallback_url)).alias("post_url"), F.col("__d").alias("description"))


def latest_thread(hits: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """The newest hit whose title holds all phrases, whatever the case."""
    for p in phrases:
        hits = hits.where(F.contains(F.lower("title"), F.lit(p.lower())))
    return hits.agg(F.max_by("id", F.struct("created_at_i", "id")).alias("id")).where("id is not null")


def union_sources(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All sources' rows, with the source's place in the list as the first part of the arrival order; missing columns are null."""
    out = None
    for i, (_, df) in enumerate(sources):
        df = df.withColumn("source_ord", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def union_landed(sources: Sequence[tuple[str, Callable[[], DataFrame], str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame | None, list[tuple[str, DataFrame | str]]]:
    """(rows of all sources, errors) of (name, raw rows, payload schema, normaliser): what one source can't read stops no other.

    Raw rows come from a function; where it fails, the source has no rows and its error is the text.  Payloads that don't read under the schema are rows
    of the source's errors (source, token, payload).  Rows carry ``source_ord``, their source's place in the list.
    """
    good, errors = [], []
    for name, raw, schema, normalise in sources:
        try:
            read, broken = split_errors(raw(), schema)
            good.append((name, normalise(read)))
            errors.append((name, broken.select(F.lit(name).alias("source"), "token", "payload")))
        except AnalysisException as e:
            errors.append((name, f"{name}: {e.getCondition()}"))
    return union_sources(good), errors


def split_errors(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose payload reads under ``schema``, the others), so that one broken payload stops nothing."""
    marked = raw.withColumn("__ok", F.from_json("payload", schema, {"mode": "PERMISSIVE"}).isNotNull() & F.try_parse_json("payload").isNotNull())
    return marked.where("__ok").drop("__ok"), marked.where("not __ok").drop("__ok")
