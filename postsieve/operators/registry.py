"""Board registries and the candidates that may join them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions.dates import extract_tenant
from postsieve.functions.text import humanize_token, quote, slug_candidates, word_any

from .dedup import _best
from .report import company_frequency


def discover_tenants(postings: DataFrame, url: str = "url") -> DataFrame:
    """(tenant, server, site) of board URLs, the first sighting of each tenant."""
    seen = postings.select("seq", extract_tenant(F.col(url)).alias("t")).where("t is not null").select("seq", "t.*")
    return _best(seen, ["tenant"], [-F.col("seq")]).select("tenant", "server", "site")


def exclude_registered(candidates: DataFrame, active: DataFrame, rejected: DataFrame, key: str = "tenant") -> DataFrame:
    gone = active.select(F.lower(key).alias("__k")).union(rejected.select(F.lower(key)))
    return candidates.join(gone, F.lower(F.col(key)) == F.col("__k"), "left_anti")


def merge_candidates(candidates: DataFrame, found: DataFrame, active: DataFrame, rejected: DataFrame, as_of: date) -> DataFrame:
    """The candidates after a run: seen again counts one more, new ones start at 1; registered and malformed ones stay out."""
    able = exclude_registered(found.where("tenant is not null and tenant <> ''"), active, rejected)
    once = able.groupBy("tenant").agg(F.min("server").alias("__server"))
    joined = candidates.join(once, "tenant", "full")
    seen = F.col("__server").isNotNull()
    return joined.select(
        "tenant", F.coalesce("server", "__server").alias("server"), F.coalesce("first_seen", F.lit(as_of)).alias("first_seen"),
        F.when(seen, F.lit(as_of)).otherwise(F.col("last_seen")).alias("last_seen"), (F.coalesce("n_seen", F.lit(0)) + seen.cast("int")).alias("n_seen"), F.coalesce("promotion_attempts", F.lit(0)).alias("promotion_attempts"),
    )


def candidate_counts(candidates: DataFrame, found: DataFrame, active: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: tenants of a run that are new, and those that were candidates before."""
    able = exclude_registered(found.where("tenant is not null and tenant <> ''"), active, rejected).select("tenant").distinct()
    marked = able.join(candidates.select("tenant", F.lit(True).alias("__old")), "tenant", "left")
    return marked.agg(F.count_if(F.col("__old").isNull()).alias("n_new"), F.count_if("__old").alias("n_repeat"))


def decide(df: DataFrame, bar: int = 6, max_attempts: int = 5) -> DataFrame:
    """``decision`` by alive (null: unknown), hits and promotion_attempts, and the attempts after it."""
    tries = F.col("promotion_attempts") + F.col("alive").isNull().cast("int")
    hits = F.coalesce("hits", F.lit(0))
    decision = F.when(~F.col("alive"), "reject").when(F.col("alive").isNull(), F.when(tries >= max_attempts, "reject").otherwise("retry")).when(hits >= bar, "promote").when(hits == 0, "reject").otherwise("hold")
    return df.withColumn("decision", decision).withColumn("promotion_attempts", tries)


def candidate_tokens(jobs: DataFrame, registered: DataFrame, n: int) -> DataFrame:
    """Token shapes of the most frequent companies that no board has yet, once each whatever the case."""
    shapes = company_frequency(jobs, n).select("company", F.posexplode(slug_candidates(F.col("company"))).alias("pos", "token"))
    once = _best(shapes, [F.lower("token")], [-F.col("pos"), F.col("company")])
    return once.join(registered.select(F.lower("token").alias("__t")), F.lower("token") == F.col("__t"), "left_anti").select("company", "token")


def board_relevance(titles: DataFrame, domain_words: Sequence[str], exclusions: Sequence[str], least: int = 1) -> DataFrame:
    """(board, total, relevant) of boards with ``least`` relevant titles; exclusions here are plain substrings."""
    t = F.lower("title")
    bad = t.rlike("|".join(map(quote, exclusions))) if exclusions else F.lit(False)
    out = titles.groupBy("board").agg(F.count("*").alias("total"), F.count_if(word_any(t, domain_words) & ~bad).alias("relevant"))
    return out.where(F.col("relevant") >= least)


def domain_hits(titles: DataFrame, domain_words: Sequence[str]) -> DataFrame:
    """Distinct titles of each board that carry a domain word."""
    return titles.groupBy("board").agg(F.count_distinct(F.when(word_any(F.lower("title"), domain_words), F.col("title"))).alias("hits"))


def repair_names(registry: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows named by their token take the resolved name, else the token read as words."""
    names = resolved.groupBy(F.col("token").alias("__t")).agg(F.max("name").alias("__n"))
    joined = registry.join(names, F.col("token") == F.col("__t"), "left")
    return joined.withColumn("name", F.when(F.col("name") == F.col("token"), F.coalesce("__n", humanize_token(F.col("token")))).otherwise(F.col("name"))).select(registry.columns)


def validate_registry(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """Tokens with a live posting, once each."""
    live = probes.where("total > 0").select("token").distinct()
    return registry.dropDuplicates(["token"]).join(live, "token", "left_semi")


def classify_tenant(df: DataFrame, reasons: DataFrame, default: str = "off_domain", key: str = "tenant") -> DataFrame:
    """``reason``: that of the first listed set that holds the tenant."""
    first = reasons.groupBy(key).agg(F.min_by("reason", "rank").alias("reason"))
    return df.join(first, key, "left").withColumn("reason", F.coalesce("reason", F.lit(default)))
