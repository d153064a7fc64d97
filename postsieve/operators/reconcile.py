"""Batches for an external scorer, and its replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.text import clean_confidence, valid_likelihood

#: Stretches of a feed that are numbered in tasks of their own, and how finely the sketch ranks their ends.
STRETCHES, ACCURACY = 64, 10_000


def batch_index(df: DataFrame, n: int = 8, by: str = "source", chars: int = 8000) -> DataFrame:
    """``df`` with batch_no and idx of batches of ``n`` in arrival order within ``by``; descriptions are cut.

    A quantile sketch of each feed's arrival numbers, merged from those of the tasks in one pass, gives the ends of stretches with about equally many rows, however the
    numbers cluster.  Rows are numbered within a stretch, and each begins where those before it end, so that one large feed is no heavy window.
    Ends and beginnings, at most ``STRETCHES`` numbers a feed, go to where the rows are: a join by feed would put a large feed into one task.
    """
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    ends = df.groupBy(F.col(by).alias("__b")).agg(F.percentile_approx("seq", shares, ACCURACY).alias("__ends"))
    stretch = F.size(F.filter("__ends", lambda end: end <= F.col("seq")))
    df = df.join(F.broadcast(ends), F.col(by).eqNullSafe(F.col("__b"))).withColumn("__p", F.coalesce(stretch, F.lit(0))).drop("__b", "__ends")
    before = Window.partitionBy("__b").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(F.col(by).alias("__b"), F.col("__p").alias("__q")).agg(F.count("*").alias("__n")).select("__b", "__q", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__p").orderBy("seq")) - 1
    placed = df.withColumn("__i", inside).join(F.broadcast(parts), F.col(by).eqNullSafe(F.col("__b")) & (F.col("__p") == F.col("__q")))
    out = placed.withColumn("__r", F.col("__before") + F.col("__i")).drop("__p", "__q", "__b", "__i", "__before")
    out = out.withColumn("batch_no", F.floor(F.col("__r") / n)).withColumn("idx", (F.col("__r") % n).cast("int")).drop("__r")
    return out.withColumn("description", F.substring("description", 1, chars))


def batch_payloads(batched: DataFrame, by: str = "source") -> DataFrame:
    fields = F.struct("idx", "company", "title", "location", "description")
    return batched.groupBy(by, "batch_no").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("payload"))


def reconcile_replies(batch: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows of ``batch`` (batch_no, idx, fingerprint) with their reply's confidence and likelihood.

    A reply is matched by its index within the batch first, else by fingerprint; the last of several counts.  A row
    without a reply, or with a likelihood outside 0 to 100, is unscored.
    """
    values = F.struct("confidence", "interview_likelihood")
    by_index = replies.where("idx is not null").groupBy("batch_no", "idx").agg(F.max_by(values, "seq").alias("a"))
    by_print = replies.where("fingerprint is not null").groupBy("batch_no", "fingerprint").agg(F.max_by(values, "seq").alias("b"))
    joined = batch.join(by_index, ["batch_no", "idx"], "left").join(by_print, ["batch_no", "fingerprint"], "left").withColumn("r", F.coalesce("a", "b"))
    valid = F.col("r").isNotNull() & valid_likelihood(F.col("r.interview_likelihood"))
    return joined.select(*batch.columns, F.when(valid, clean_confidence(F.col("r.confidence"))).alias("confidence"), F.when(valid, F.col("r.interview_likelihood")).alias("interview_likelihood"), valid.alias("scored"))
