"""Thin queries, one for each corpus operator, over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, decontam, dialogs, langid, linededup, minhash, mixing, periodic, pii, rules, tokenbin, tokencount, webtext
from .columns import let, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokencount.count_tokens(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linededup.line_decisions(_table(spark, sf_dir, "documents"))
    counts = lines.groupBy(F.col("id").alias("doc_id")).agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.coalesce(F.sum(F.when(F.col("near").isNotNull(), F.col("line") + 1)), F.lit(0)).cast("long").alias("gone_sum")
    )
    return counts


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = langid.fit(docs.where(~held_out & F.col("lang").isNotNull()))
    found = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = tokenbin.write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return tokenbin.read_tokens(store, docs.select("doc_id")).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge_quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.curriculum(mixing.plan_mix(_table(spark, sf_dir, "documents")))
    ends = [F.round(F.try_element_at("positions", F.lit(i)), 6).alias(name) for i, name in ((1, "first_position"), (-1, "last_position"))]
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", *ends)


def _crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def _planted(text: Column, h: Column) -> Column:
    """The contract's text: that of a tenth of the documents turns periodic from a word on."""

    def periodic_from(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        return let(F.struct(start.alias("a"), period.alias("p")), lambda v: F.array_join(F.transform(w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, (v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " "))

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), periodic_from)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", _planted(F.col("text"), _crc32(F.col("doc_id").cast("string"))).alias("text"))
    found = periodic.find_runs(planted)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("top.o"), F.col("top.period")
    return found.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _damaged(turns: DataFrame) -> DataFrame:
    """The contract's rows: some dropped, emptied, without marks, repeated or of another role, by a hash of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = _crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    changed = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), "hit")
    return rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _repaired_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, SHA-256 of ``role:text`` on a line each) of repaired rows (id, place, role, text) that come a conversation after the other."""
    conv, digest = None, None
    for batch in batches:
        done, hashes = [], []
        for i, (place, role, text) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
            if place == 0:
                if digest:
                    done.append(conv)
                    hashes.append(digest.hexdigest())
                conv, digest = batch.column(0).slice(i, 1), hashlib.sha256()
            digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(done), pa.array(hashes)], ["id", "sha"])
    if digest:
        yield pa.RecordBatch.from_arrays([conv, pa.array([digest.hexdigest()])], ["id", "sha"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    audits, repaired = dialogs.repair_conversations(_damaged(turns))
    id_type = turns.schema["conv_id"].dataType.simpleString()
    hashes = repaired.select("conv_id", "place", "role", "text").mapInArrow(_repaired_digests, f"id {id_type}, sha string")
    every = turns.select("conv_id").distinct()
    found = every.join(audits.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long")).alias("gaps")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", gaps, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_cotraining": op2_cotraining,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_langid": op5_langid,
    "op6_tokens": op6_tokens,
    "op7_rules": op7_rules,
    "op8_minhash": op8_minhash,
    "op9_decontam": op9_decontam,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_html_text": op12_html_text,
    "op13_conversation_repair": op13_conversation_repair,
}
