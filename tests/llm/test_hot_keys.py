"""Joins whose keys hold a third of all rows or more, and their results where every key is dealt out."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postsieve.llm import pii, skew
from postsieve.llm.decontam import find_leaks
from postsieve.llm.linededup import line_decisions
from postsieve.llm.skew import dealt_join, hot_parts

from .test_decontam_and_mixing import best_overlap, word
from .test_lines_and_rules import brute_lines


@pytest.fixture
def all_hot(monkeypatch):
    """Every key of more than two rows is a frequent one."""
    monkeypatch.setattr(skew, "FEW", 2)
    monkeypatch.setattr(skew, "SHARES", 10**9)


def test_a_key_of_a_third_of_all_rows_is_many_tasks(spark):
    many = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    parts = hot_parts(one, ["k"], count="n", total=9_000)
    assert [(r.k, r["__parts"]) for r in parts.collect()] == [(0, 6)]
    joined = dealt_join(many, one.drop("n"), ["k"], parts, spread=["id"])
    assert joined.columns == ["k", "id", "top"]
    rows = joined.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.top) for r in rows) == [(i, 8997 if i % 3 == 0 else i) for i in range(9_000)]
    assert len({r.task for r in rows if r.k == 0}) > 1


def test_dealt_join_of_several_rows_a_key(spark, all_hot):
    many = spark.createDataFrame([(k, i) for k in range(3) for i in range(7)], "k int, i int")
    one = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k int, x string")
    parts = hot_parts(many.groupBy("k").agg(F.count("*").alias("m")), ["k"], count="m", total=21)
    got = sorted(map(tuple, dealt_join(many, one, ["k"], parts, spread=["i"]).collect()))
    assert got == sorted((k, i, x) for k, x in [(0, "a"), (0, "b"), (1, "c")] for i in range(7))


def test_lines_where_every_key_is_dealt_out(spark, all_hot):
    rng = random.Random(9)
    base = [[rng.choice("abcdef") for _ in range(rng.randrange(4, 9))] for _ in range(4)]
    rows = []
    for i in range(30):
        text = ["terms of use apply to all"]
        for _ in range(rng.randrange(0, 4)):
            w = list(rng.choice(base))
            w[rng.randrange(len(w))] = rng.choice("abcdef")
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), rng.choice("abcdef"))
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    found = {(r.id, r.line): r.near for r in line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_lines(rows)


def test_one_line_and_one_template_a_third_of_all_lines_each(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("Terms of use apply here"), F.concat(F.lit("call us on number x"), "id", F.lit(" now")), F.concat_ws(" ", *[F.sha2(F.concat(F.lit(f"{i}-"), "id"), 256) for i in range(5)])).alias("text"))
    kept = {r.line: (r.n, r.first) for r in line_decisions(docs).where("near is null").groupBy("line").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()}
    assert kept == {0: (1, 0), 1: (1, 0), 2: (3_000, 0)}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_leaks_where_every_key_is_dealt_out(spark, all_hot, bound):
    rng = random.Random(5)
    phrase = [word(rng) for _ in range(9)]  # a phrase that every item and every text holds
    items = [(i, " ".join([*phrase, *(word(rng) for _ in range(12))])) for i in range(4)]
    docs = []
    for i in range(40):
        words = [word(rng) for _ in range(10)]
        words[4:4] = items[0 if i % 3 == 0 else rng.randrange(4)][1].split() if i % 3 < 2 else phrase
        docs.append((i // 2, " ".join(words)))  # each id has two texts
    want = {(d, i) for d, t in docs for i, x in items for best, n in [best_overlap(t, x)] if 100 * best >= 80 * n}
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=bound, broadcast_ids=bound)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert want


def test_one_item_that_every_text_cites(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" " + item)).alias("text"))
    found = find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), broadcast_seeds=0, broadcast_ids=0)
    assert found.where("n_words = 13 and n_same = 13").count() == 2_000 == found.select("doc_id").distinct().count()


def test_runs_of_texts_by_their_nodes():
    assert list(pii._side_by_side([3, 4, 9, 20, 1, 1], 10)) == [[0, 1], [2], [3], [4, 5]]
    assert list(pii._side_by_side([], 10)) == []


def test_spans_do_not_depend_on_what_is_propagated_together(monkeypatch):
    texts = [f"reach me at 555 01{i % 10} 44{i % 7}7 or +1 555 01{i % 10} 44{i % 7}7, card 4111 1111 1111 1111" for i in range(60)]
    texts += [None, "1234567 " * 3_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    scanned = list(pii._scan(iter([batch])))
    cells = [tuple(r.values()) for b in pii._cooccurrences(iter([pa.RecordBatch.from_arrays([s.column(2)], ["nodes"]) for s in scanned])) for r in b.to_pylist()]
    decode = pii._decode(SimpleNamespace(value=pii.Potentials(cells)))
    whole = [b.to_pylist() for b in decode(iter(scanned))]
    assert sum(len(g) for s in scanned for g in s.column(2).to_pylist()) > 3_000
    monkeypatch.setattr(pii, "NODES_AT_ONCE", 1)
    assert [b.to_pylist() for b in decode(iter(scanned))] == whole
