"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again before the next stage.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.llm import decontam, langid, minhash, mixing, tokenbin
from postsieve.llm.queries import tokenizer_path
from postsieve.llm.store import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text reads as one of the languages of ``docs`` itself; those that the models reject go."""
    models = langid.fit(docs)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name can clash with the prediction's
    text = f"c{docs.columns.index('text')}"
    return langid.predict(numbered, models, text_col=text, keep=numbered.columns).where(~F.col("rejected")).select(numbered.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group that links at 0.8 on 5-word shingles."""
    gone = minhash.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of ``benchmark``."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, in the order of its training position."""
    return mixing.mix(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` and take, a number of each row that grows with its file and its row in the file."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # no table of files yet
        return in_order(written(docs, "ordered"))
    by_name = Window.orderBy(F.length("__file"), "__file")  # one row a file
    files = placed.select("__file").distinct().select("__file", (F.row_number().over(by_name) - 1).cast("long").alias("__at"))
    return placed.join(F.broadcast(files), "__file").select(*docs.columns, (F.shiftleft("__at", 33) + F.col("__row")).alias("take"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the token shards hold each take of a document; the shards follow the order of the rows of ``docs``, which is that of training.

    One row per take: doc_id, copy (0, 1, ... in training order; null for a null id), start, n_tokens, n_rows (takes of the document) and ids_crc32.
    """
    takes = written(in_order(docs.select("doc_id", "text")), "takes")
    store = tokenbin.write_tokens(takes, tokenizer_path("byte_bpe_50k.json"), key_col="take")
    own = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("take")))
    copies = takes.select("doc_id", "take", (F.row_number().over(own.orderBy("take")) - 1).alias("copy"), F.count("*").over(own).alias("n_rows"))
    copies = copies.withColumn("copy", F.when(F.col("doc_id").isNotNull(), F.col("copy")))
    found = tokenbin.read_tokens(store, takes.select("take")).drop("n_rows")
    return copies.join(found, F.col("take") == F.col("key")).select("doc_id", "copy", "start", "n_tokens", "n_rows", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]

#: The models and hashes of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)
