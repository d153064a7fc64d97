"""State tables: appends, merges and verdicts.  Each function gives the new snapshot or the rows to append; the caller writes it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.functions.text import blank_to_null, fingerprint, has_text, map_values, py_strip, quote

from .dedup import _best

#: What a status in a sheet means as an outcome.
STATUS_MAP = {
    "applied": "applied", "skipped": "skipped", "phone screen": "phone_screen", "interview": "interview", "offer": "offer",
    "rejected": "rejected", "no response": "no_response", "reached out": "reached_out",
}


def append_new(target: DataFrame, rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The rows to append: the first of each key that ``target`` does not hold."""
    first = _best(rows, [key], [-F.col(order)])
    return first.join(target.select(key), key, "left_anti").select(rows.columns)


def news_by_key(rows: DataFrame, columns: Sequence[str], key: str, column: str, order: str = "seq") -> DataFrame:
    """(__k, __f, __v): of each key the first row and the newest value of ``column`` that isn't blank; rows are read once, and leave their tasks as a row a key."""
    arrival = F.col(order)
    first = F.min_by(F.struct(*columns), F.struct(arrival.isNull(), arrival))  # a row without a number comes last
    newest = F.max(F.when(has_text(F.col(column)) & arrival.isNotNull(), F.struct(arrival.alias("at"), F.col(column).alias("v"))))["v"]
    return rows.groupBy(F.col(key).alias("__k")).agg(first.alias("__f"), newest.alias("__v"))


def merge_news(target: DataFrame, news: DataFrame, key: str, column: str) -> DataFrame:
    known = target.withColumn("__old", F.lit(True))
    both = known.join(news, F.col(key) == F.col("__k"), "full_outer")
    value = F.coalesce(F.when(F.coalesce(key, "__k").isNotNull(), F.col("__v")), F.when(F.col("__old"), F.col(column)).otherwise(F.col("__f")[column]))
    return both.select(*[(value if c == column else F.when(F.col("__old"), F.col(c)).otherwise(F.col("__f")[c])).alias(c) for c in target.columns])


def merge_latest(target: DataFrame, rows: DataFrame, key: str, column: str, order: str = "seq") -> DataFrame:
    """``target`` and the new keys of ``rows``; an old row keeps all but ``column``, which takes the newest value that isn't blank."""
    return merge_news(target, news_by_key(rows, target.columns, key, column, order), key, column)


def audit_rows(df: DataFrame, as_of: datetime, verdict: Column) -> DataFrame:
    """Rows for the audit table; the confidence is null where ``df`` has none."""
    confidence = F.col("confidence").cast("int") if "confidence" in df.columns else F.lit(None).cast("int").alias("confidence")
    return df.select(fingerprint(F.col("company"), F.col("title")).alias("job_fingerprint"), "company", "title", "source", "stage", verdict.alias("verdict"), "reason", confidence, F.lit(as_of).cast("date").alias("run_date"), F.lit(as_of).alias("created_at"))


def append_audit(rows: DataFrame, path: str, run_id: str) -> None:
    """Add a run's rows to the audit table, one folder a run date and run; a run that is repeated takes the place of its own rows, and of no others."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)


def read_audit(spark: SparkSession, path: str, day: date | None = None) -> DataFrame:
    """The audit table, or a day of it, whose folder alone is read then."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if day is None else rows.where(F.col("run_date") == F.lit(day))


def upsert_verdict(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The newest verdict of each company key; unknown ones are never stored."""
    return _best(cache.unionByName(rows.where("verified is not null")), ["company_key"], [F.col("checked_at"), F.col("verified")])


def valid_verdicts(cache: DataFrame, as_of: datetime, positive_days: int = 30, negative_days: int = 7) -> DataFrame:
    age = F.datediff(F.lit(as_of), F.col("checked_at"))
    return cache.where(age < F.when(F.col("verified"), positive_days).otherwise(negative_days))


def _saying(sheet: DataFrame) -> DataFrame:
    return sheet.where(has_text(F.col("status")) & (F.lower(py_strip(F.col("status"))) != "ready to apply"))


def outcome_matches(feedback: DataFrame, materials: DataFrame, tracker: DataFrame) -> DataFrame:
    """(sheet, matched, unmatched): rows of each sheet that say something, by whether their fingerprint has feedback."""
    sheets = materials.withColumn("sheet", F.lit("materials")).unionByName(tracker.withColumn("sheet", F.lit("tracker")))
    fp = fingerprint(F.col("company"), F.col("title"))
    known = feedback.select(fp.alias("__fp")).distinct().withColumn("__k", F.lit(True))
    marked = _saying(sheets).withColumn("__fp", fp).join(known, "__fp", "left")
    return marked.groupBy("sheet").agg(F.count_if("__k").alias("matched"), F.count_if(F.col("__k").isNull()).alias("unmatched"))


def apply_outcomes(feedback: DataFrame, materials: DataFrame, tracker: DataFrame, status_map: Mapping[str, str] = STATUS_MAP) -> DataFrame:
    """``feedback`` with the outcome of its fingerprint's last sheet row; the tracker overrides the materials.

    Sheets have seq, company, title and status; blank and ``ready to apply`` say nothing.
    """
    sheets = materials.withColumn("__p", F.lit(0)).unionByName(tracker.withColumn("__p", F.lit(1)))
    said = _saying(sheets)
    latest = said.groupBy(fingerprint(F.col("company"), F.col("title")).alias("__fp")).agg(F.max_by(map_values(F.col("status"), status_map), F.struct("__p", "seq")).alias("__o"))
    keyed = feedback.withColumn("__fp", fingerprint(F.col("company"), F.col("title")))
    return keyed.join(latest, "__fp", "left").withColumn("outcome", F.coalesce("__o", "outcome")).select(feedback.columns)


def promote_applied(materials: DataFrame, tracker: DataFrame, as_of: datetime) -> DataFrame:
    """Tracker rows of ten columns for rows marked Applied that the tracker does not hold, once each, with the date and a follow-up a week later.

    ``materials`` has seq, company, title, status and generated, and may have location, apply_link and confidence.
    """
    fp = fingerprint(F.col("company"), F.col("title"))
    done = materials.where(F.col("status") == "Applied").withColumn("__fp", fp)
    fresh = _best(done, ["__fp"], [-F.col("seq")]).join(tracker.select(fp.alias("__fp")), "__fp", "left_anti")
    applied = F.coalesce(F.col("generated").cast("date"), F.lit(as_of).cast("date"))
    given = lambda name: F.col(name) if name in materials.columns else F.lit(None)
    text = lambda name: F.coalesce(given(name).cast("string"), F.lit("")).alias(name)
    return fresh.select(
        applied.alias("date_applied"), "company", "title", text("location"), text("apply_link"), F.lit("").alias("status"),
        F.date_add(applied, 7).alias("follow_up"), F.lit("No").alias("follow_up_sent"), F.lit("").alias("notes"), given("confidence").cast("int").alias("confidence"),
    )


def add_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in df.columns])


def feedback_rows(rows: DataFrame, projects: str, admission: Column) -> DataFrame:
    return rows.withColumn("projects_used", F.to_json(projects)).withColumn("admission", admission)


def pending_generation(daily: DataFrame, materials: DataFrame) -> DataFrame:
    """Rows marked to apply whose fingerprint is not queued yet."""
    fp = fingerprint(F.col("company"), F.col("title"))
    queued = materials.where(F.col("status") == "Ready to Apply").select(fp.alias("__fp"))
    return daily.where(F.lower(py_strip(F.col("status"))) == "apply").withColumn("__fp", fp).join(queued, "__fp", "left_anti").select(daily.columns)


def attach_descriptions(sheet: DataFrame, jobs: DataFrame) -> DataFrame:
    texts = jobs.groupBy("job_fingerprint").agg(F.max("description").alias("description")).select("job_fingerprint", blank_to_null(F.col("description")).alias("description"))
    return sheet.withColumn("job_fingerprint", fingerprint(F.col("company"), F.col("title"))).join(texts, "job_fingerprint", "left")


def applied_with_description(feedback: DataFrame, jobs: DataFrame, since: str, min_chars: int = 200) -> DataFrame:
    """(job_fingerprint, title, description), each once: the applications since a date with every long description of theirs.

    Both sides are made single before they meet, so that a posting that is stored and applied to many times is no product of the two.  Descriptions are
    equal if their SHA-256 are, so that texts go through the shuffle only for those who ask for them.
    """
    applied = feedback.where(F.col("date_applied") >= since).select("job_fingerprint", "title").distinct()
    texts = jobs.where(F.length("description") > min_chars).select("job_fingerprint", "description", F.sha2("description", 256).alias("__h")).dropDuplicates(["job_fingerprint", "__h"])
    return applied.join(texts, "job_fingerprint").select("job_fingerprint", "title", "description")


def failed_only(scored: DataFrame, prefixes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    failed = F.coalesce(F.col("reasoning").rlike("^(?:" + "|".join(map(quote, prefixes)) + ")"), F.lit(False))
    return scored.where(failed), scored.where(~failed)


def select_status(df: DataFrame, status: str, exact: bool = True) -> DataFrame:
    """Rows with a status, exactly or whatever the case and the space around it."""
    return df.where(F.col("status") == status) if exact else df.where(F.lower(py_strip(F.col("status"))) == status.lower())


def write_json_dump(df: DataFrame, path: str) -> None:
    """JSON lines, one file a task."""
    df.write.mode("overwrite").json(path)


def map_as_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the (key, value) rows of a small table, such as a document frequency, as one JSON object by key."""
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("json"))
