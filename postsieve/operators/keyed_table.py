"""Tables of one row a key, stored in parts by a hash of the key, of which a change rewrites those that it touches."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import _best
from .state import append_new, merge_news, news_by_key

PART = "part"
PARTS = 256


class KeyedTable:
    """A Parquet table under ``path`` with a folder for each part of the keys.

    Rows are read once, and a row of each of their keys is put beside the table.  The parts that these touch, at most ``parts`` numbers, are looked up; only those are read, and only those are written.  Appends add files to
    parts with new keys.  Other changes are written beside the table (in ``path`` with ``-staged``) and then take the place of the touched parts, so that a run that is
    lost on the way leaves the table as it was, and one that is repeated comes to the same rows.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, parts: int = PARTS):
        self.spark, self.path, self.key, self.schema, self.parts = spark, path.rstrip("/"), key, schema, parts

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """The rows, or those of some parts."""
        try:
            found = self.spark.read.schema(f"{self.schema}, {PART} int").parquet(self.path)
        except AnalysisException:  # nothing has been written yet
            found = self.spark.createDataFrame([], f"{self.schema}, {PART} int")
        found = found if touched is None else found.where(F.col(PART).isin(touched))
        return found.drop(PART)

    def touched(self, rows: DataFrame, key: str | None = None) -> list[int]:
        return sorted(r[0] for r in rows.select(self.part(F.col(key or self.key))).distinct().collect())  # at most ``parts`` numbers

    def _write(self, rows: DataFrame, mode: str, path: str) -> None:
        placed = rows.withColumn(PART, self.part(F.col(self.key))).repartition(PART)
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}-staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _replace(self, rows: DataFrame) -> None:
        staged = f"{self.path}-staged/{uuid.uuid4().hex}"
        self._write(rows, "errorifexists", staged)
        self._write(self.spark.read.schema(rows.schema).parquet(staged), "overwrite", self.path)

    def append_new(self, rows: DataFrame, order: str = "seq") -> None:
        """Add the first row of each key that the table lacks."""
        first = self._staged(_best(rows, [self.key], [-F.col(order)]))
        touched = self.touched(first)
        if touched:
            known = self.read(touched)
            self._write(append_new(known, first, self.key, order).select(known.columns), "append", self.path)

    def merge_latest(self, rows: DataFrame, column: str, order: str = "seq") -> None:
        """Add new keys, and give known ones the newest value of ``column`` that isn't blank."""
        news = self._staged(news_by_key(rows, self.read([]).columns, self.key, column, order))
        touched = self.touched(news, "__k")
        if touched:
            self._replace(merge_news(self.read(touched), news, self.key, column))

    def upsert(self, rows: DataFrame, order: str) -> None:
        """For each key the row that comes last by ``order``, of the table's and the new ones."""
        touched = self.touched(rows)
        if touched:
            self._replace(_best(self.read(touched).unionByName(rows.select(self.read([]).columns)), [self.key], [F.col(order)]))
