"""Funnel, outcome and usage reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.dates import humanize_age
from postsieve.functions.text import has_text, salary_text, sponsorship_label

#: Outcomes that count as a call back, and those that count as any good sign.
CALLBACKS = ("phone_screen", "interview", "offer")
POSITIVES = ("phone_screen", "interview", "offer", "reached_out")


def _rates() -> list[Column]:
    o = F.col("outcome")
    callbacks, positives = F.count_if(o.isin(*CALLBACKS)), F.count_if(o.isin(*POSITIVES))
    return [F.count("*").alias("apps"), callbacks.alias("callbacks"), positives.alias("positives"), (callbacks / F.count("*")).alias("callback_rate"), (positives / F.count("*")).alias("positive_rate")]


def rate_table(df: DataFrame, key: str, min_n: int = 1, low: int = 30) -> DataFrame:
    """Applications and rates per key; an array key counts for each of its values, a null key is the text None."""
    kind = dict(df.dtypes)[key]
    keyed = df.select("outcome", (F.explode_outer(key) if kind.startswith("array") else F.col(key)).alias("key"))
    out = keyed.groupBy(F.coalesce(F.col("key").cast("string"), F.lit("None")).alias("key")).agg(*_rates())
    return out.where(F.col("apps") >= min_n).withColumn("low_n", F.col("apps") < low)


def order_rates(rates: DataFrame) -> DataFrame:
    return rates.orderBy(F.desc("callback_rate"), F.desc("apps"), "key")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(dimension, key, applied, callbacks, rate) by source, angle, confidence, admission and project, skipped rows left out.

    The first four are one GROUPING SETS pass; a null confidence is a group of its own, a null admission none.
    """
    used = feedback.where("outcome <> 'skipped'").select("source", "resume_angle", F.col("screen_confidence").cast("string").alias("confidence"), "admission", "projects_used", F.col("outcome").isin(*CALLBACKS).cast("long").alias("called"))
    dims = ["source", "resume_angle", "confidence", "admission"]
    sets = used.groupingSets([[F.col(d)] for d in dims], *dims).agg(F.count("*").alias("applied"), F.sum("called").alias("callbacks"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    dimension = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims])
    key = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d)) for d in dims])
    by_dims = sets.select(dimension.alias("dimension"), key.alias("key"), "applied", "callbacks").where("not (dimension = 'admission' and key is null)")
    by_project = used.select(F.explode(F.from_json("projects_used", "array<string>")).alias("key"), "called").groupBy("key").agg(F.count("*").alias("applied"), F.sum("called").alias("callbacks"))
    both = by_dims.unionByName(by_project.withColumn("dimension", F.lit("project")))
    return both.withColumn("rate", F.col("callbacks") / F.col("applied"))


def project_usage(feedback: DataFrame) -> DataFrame:
    """Uses and callbacks per project id; repeats within a row count, skipped rows too."""
    used = feedback.select(F.explode(F.from_json("projects_used", "array<string>")).alias("project"), "outcome")
    return used.groupBy("project").agg(F.count("*").alias("used"), F.count_if(F.col("outcome").isin(*CALLBACKS)).alias("callbacks"))


def usage_rollup(usage: DataFrame, as_of: datetime, sums: Sequence[str] = ("input_tokens", "output_tokens", "cost_usd")) -> DataFrame:
    """Calls and sums per purpose, and in total, for today (UTC), the seven days before ``as_of`` and all time."""
    ts, now = F.col("ts"), F.lit(as_of)
    spans = F.array_compact(F.array(F.lit("all"), F.when(ts >= now - F.make_interval(days=F.lit(7)), "7d"), F.when(ts >= F.date_trunc("day", now), "today")))
    spread = usage.select(F.coalesce("purpose", F.lit("other")).alias("purpose"), *sums, F.explode(spans).alias("span"))
    aggs = [F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums]]
    grouped = spread.rollup("span", "purpose").agg(*aggs, F.grouping("span").alias("g")).where("g = 0").drop("g")
    return grouped.withColumn("purpose", F.coalesce("purpose", F.lit("TOTAL")))


def usage_since(usage: DataFrame, min_id: int, sums: Sequence[str] = ("input_tokens", "output_tokens", "cost_usd")) -> DataFrame:
    return usage.where(F.col("id") > min_id).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.coalesce(F.max("id"), F.lit(0)).alias("high_water"))


def score_breakdown(scored: DataFrame) -> DataFrame:
    """Rows per confidence 5 to 1, zero-filled, and the unscored ones (null) if there are any."""
    counts = scored.groupBy("confidence").agg(F.count("*").alias("n"))
    levels = scored.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("level"))
    filled = levels.join(F.broadcast(counts), F.col("level") == F.col("confidence"), "left").select(F.col("level").alias("confidence"), F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(counts.where("confidence is null"))


def funnel(gated: DataFrame, as_of: datetime, hours: int, trusted: Sequence[str], dropped: Column | None = None, confidence: Column | None = None, min_confidence: int = 3) -> DataFrame:
    """One row of counters over rows that carry their gate stage, in one pass.

    ``dropped`` tells rows that the sponsor check took out, which count as fresh and in none of the later counters.  ``confidence`` is the scorer's, null
    for unscored rows, which are written; rows below ``min_confidence`` are not.
    """
    from .dedup import is_fresh

    fresh = is_fresh(as_of, hours, trusted)
    gone = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    score = F.lit(None).cast("int") if confidence is None else confidence
    here, has, low = fresh & ~gone, has_text(F.col("description")), F.coalesce(score < min_confidence, F.lit(False))
    passed = here & (F.col("stage") == "stage1_pass")
    counters = {"fresh": fresh, "stale": ~fresh, "sponsor_dropped": fresh & gone, "with_description": here & has, "without_description": here & ~has, "passed": passed, "rejected": here & (F.col("stage") != "stage1_pass"), "below_cutoff": passed & low, "written": passed & ~low}
    return gated.agg(F.count("*").alias("scraped"), *[F.count_if(c).alias(name) for name, c in counters.items()])


def stage_counts(audit: DataFrame, run_date: str | None = None) -> DataFrame:
    rows = audit if run_date is None else audit.where(F.col("run_date") == F.lit(run_date).cast("date"))
    return rows.groupBy("stage", "verdict").agg(F.count("*").alias("n"))


def sponsor_stats(df: DataFrame, droppable: Column) -> DataFrame:
    no = F.col("verified").eqNullSafe(F.lit(False))
    return df.agg(F.count("verified").alias("checked"), F.count_if("verified").alias("verified"), F.count_if(no & droppable).alias("dropped"), F.count_if(no & ~droppable).alias("kept_unverified"))


def outcome_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("outcome").agg(F.count("*").alias("n"), F.min("date_applied").alias("first"), F.max("date_applied").alias("last"))


def outcome_overall(feedback: DataFrame) -> DataFrame:
    """One row over all rows but skipped ones: apps, callbacks, positives, their rates (0 for no row), first and last date."""
    n = F.greatest(F.count("*"), F.lit(1))
    callbacks, positives = F.count_if(F.col("outcome").isin(*CALLBACKS)), F.count_if(F.col("outcome").isin(*POSITIVES))
    dated = F.nullif("date_applied", F.lit(""))
    return feedback.where("outcome is null or outcome <> 'skipped'").agg(F.count("*").alias("apps"), callbacks.alias("callbacks"), positives.alias("positives"), (callbacks / n).alias("callback_rate"), (positives / n).alias("positive_rate"), F.min(dated).alias("first"), F.max(dated).alias("last"))


def order_outcomes(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "outcome")


#: The columns of the daily sheet and of the audit sheet, in order.
DAILY = ("company", "title", "location", "confidence", "status", "interview_score", "risk_flags", "apply_link", "posted", "source", "reasoning", "suggested_angle", "match_signals", "sponsorship", "salary_range", "notes")
AUDIT = ("company", "title", "stage", "reason", "source", "url")


def daily_rows(scored: DataFrame, as_of: datetime) -> DataFrame:
    """Sheet rows of scored postings: sixteen columns, status and notes empty for a person to fill."""
    listed = lambda name: F.coalesce(F.array_join(name, ", "), F.lit(""))
    made = {
        "status": F.lit(""), "notes": F.lit(""), "interview_score": F.col("interview_likelihood"), "risk_flags": listed("risk_flags"), "match_signals": listed("match_signals"), "apply_link": F.col("url"),
        "posted": humanize_age(F.col("posted_at"), F.lit(as_of)), "sponsorship": sponsorship_label(F.col("verified")), "salary_range": salary_text(F.col("salary_min"), F.col("salary_max")),
    }
    return scored.select(*[made.get(c, F.col(c)).alias(c) for c in DAILY])


def below_cutoff(scored: DataFrame, min_confidence: int = 3, stage: str = "stage2_score") -> DataFrame:
    """Scored rows under the cutoff, with stage and reason."""
    reason = F.concat(F.lit("Confidence "), F.col("confidence").cast("string"), F.lit(f"/5 (Daily needs {min_confidence}+): "), F.coalesce("reasoning", F.lit("")))
    return scored.where(F.col("confidence") < min_confidence).withColumn("stage", F.lit(stage)).withColumn("reason", reason)


def audit_sheet(rejects: DataFrame) -> DataFrame:
    """Sheet rows of rejections: six columns."""
    return rejects.select(*AUDIT)


def company_frequency(jobs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent companies with names longer than two."""
    return jobs.where(F.length("company") > 2).groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(limit)


def before_after(feedback: DataFrame, split_date: str) -> DataFrame:
    """Rates before and from a date; undated rows fall before."""
    period = F.when(F.coalesce("date_applied", F.lit("")) < split_date, "before").otherwise("after")
    return feedback.groupBy(period.alias("period")).agg(*_rates())


def apply_log_summary(log: DataFrame, top: int = 8) -> DataFrame:
    """(kind, key, n): statuses by their first word, the most frequent reasons of blocked rows, and submitted rows by portal."""
    status = F.split_part("status", F.lit(" "), F.lit(1))
    by_status = log.groupBy(status.alias("key")).agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), "key", "n")
    reason = F.substring(F.split_part("reason", F.lit(";"), F.lit(1)), 1, 70)
    reasons = log.where(status == "blocked").groupBy(reason.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top).select(F.lit("reason").alias("kind"), "key", "n")
    portals = log.where(status == "submitted").groupBy(F.col("portal").alias("key")).agg(F.count("*").alias("n")).select(F.lit("portal").alias("kind"), "key", "n")
    return by_status.union(reasons).union(portals)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows whose key and seed have the least MD5: the same for a seed, however the rows lie."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def order_daily(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.coalesce("confidence", F.lit(0)).desc(), F.coalesce("interview_likelihood", F.lit(0)).desc(), "seq")


def top_scored(scored: DataFrame) -> DataFrame:
    best = F.max_by(F.struct(*scored.columns), F.struct(F.coalesce("confidence", F.lit(0)), F.coalesce("interview_likelihood", F.lit(0)), -F.col("seq")))
    return scored.agg(best.alias("r")).where("r is not null").select("r.*")
