"""Filings, the filer index and logs as files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILING_COLUMNS = ("VISA_CLASS", "CASE_STATUS", "EMPLOYER_NAME", "TRADE_NAME_DBA")


def read_filings(df: DataFrame) -> DataFrame:
    """The four columns that matter, in lower case; a missing one is an error."""
    missing = [c for c in FILING_COLUMNS if c.lower() not in [x.lower() for x in df.columns]]
    if missing:
        raise ValueError(f"filings lack {', '.join(missing)}")
    return df.select(*[F.col(c).alias(c.lower()) for c in FILING_COLUMNS])


def write_filer_index(keys: DataFrame, path: str, built: date, sources: Sequence[str]) -> None:
    """Text files of sorted keys behind header lines."""
    spark = keys.sparkSession
    head = spark.createDataFrame([(f"# built {built}",), *((f"# source {s}",) for s in sources)], "value string")
    head.coalesce(1).write.mode("overwrite").text(path)
    keys.select(F.col("key").alias("value")).where("value <> ''").distinct().sort("value").write.mode("append").text(path)


def read_filer_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The keys; None, which is unknown rather than empty, if there is no file or no key."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
        keys = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.trim("value").alias("key"))
    except AnalysisException:
        return None
    return None if keys.isEmpty() else keys


def read_outcome_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)
