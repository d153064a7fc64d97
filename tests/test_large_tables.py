"""What a query does to tables that are large, read from its plan or from parts of it, and the same rows by a plainer way."""

import re

import pytest
from pyspark.sql import functions as F

from postsieve.operators import state
from postsieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def below(lines, node):
    """What stands under each line that holds ``node`` in a plan."""
    depth = lambda line: len(re.match(r"[ :+|-]*", line)[0])
    for i, line in enumerate(lines):
        if re.search(node, line):
            rest = lines[i + 1 :]
            end = next((j for j, x in enumerate(rest) if depth(x) <= depth(line)), len(rest))
            yield "\n".join([line, *rest[:end]])


def test_applications_and_postings_are_single_before_they_meet(spark):
    feedback = spark.createDataFrame([("k", "T", f"2024-01-{i % 28 + 1:02}") for i in range(60)], "job_fingerprint string, title string, date_applied string")
    jobs = spark.createDataFrame([("k", "d" * (300 + i % 2)) for i in range(60)] + [("k", "short"), ("k", None), ("other", "e" * 300)], "job_fingerprint string, description string")
    found = state.applied_with_description(feedback, jobs, "2024-01-10")
    assert sorted(map(tuple, found.collect())) == [("k", "T", "d" * 300), ("k", "T", "d" * 301)]
    joins = list(below(plan_of(found), r"Join Inner"))
    assert len(joins) == 1 and joins[0].count("Aggregate [job_fingerprint") == 2
    assert "Aggregate" not in "\n".join(plan_of(found)).replace(joins[0], "")


@pytest.mark.parametrize("name", ["attach_descriptions", "applied_with_description"])
def test_postings_are_single_before_they_get_their_texts(spark, name):
    joins = list(below(plan_of(QUERIES[name](spark, SF)), r"Join (LeftOuter|Inner).*doc_key"))
    assert joins and all(re.search(r"Aggregate \[.*doc_key", x) for x in joins)


@pytest.mark.parametrize("name", ["promote_filled", "funnel_counts", "rule_gate_full", "dedup_prefer_fresh", "sponsor_drops", "sponsor_stats", "funnel_slice"])
def test_copies_are_told_apart_without_their_texts(spark, name):
    windows = list(below(plan_of(QUERIES[name](spark, SF)), r"Window \["))
    carried = [x for w in windows for x in w.split("\n") if "Relation [" not in x]  # a relation lists all its columns
    assert windows and not any("text#" in x or "description#" in x for x in carried)


def test_a_merge_reads_its_rows_once(spark, tmp_path):
    from postsieve.operators.keyed_table import KeyedTable

    read = spark.sparkContext.accumulator(0)

    def counted(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([(f"k{i % 9}" if i % 10 else None, i, f"n{i}" if i % 4 else " ") for i in range(200)], "k string, seq long, note string").withColumn("note", F.udf(counted, "string")("note"))
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "k string, seq long, note string", parts=4)
    table.merge_latest(rows, "note")
    assert read.value == 200
    assert sorted((r.k or "", r.seq, r.note) for r in table.read().collect()) == sorted(
        [("", 0, " ")] + [(f"k{j}", min(i for i in range(200) if i % 9 == j and i % 10), f"n{max(i for i in range(200) if i % 9 == j and i % 10 and i % 4)}") for j in range(9)]
    )
    table.append_new(rows.where("seq < 0").union(spark.createDataFrame([("k1", 1, "x"), ("z", 2, "y"), ("z", 1, None)], rows.schema)))
    assert [(r.seq, r.note) for r in table.read().where("k = 'z'").collect()] == [(1, None)]


def test_merged_rows_without_numbers_or_keys(spark):
    target = spark.createDataFrame([("a", 1, "old"), (None, 2, "null"), ("q", None, None)], "k string, seq long, v string")
    rows = spark.createDataFrame([("a", None, "x"), ("b", None, "late"), ("b", 7, None), (None, 3, "new"), ("q", 9, " "), ("c", None, "only")], "k string, seq long, v string")
    found = sorted(((r.k or "", r.seq or 0, r.v or "") for r in state.merge_latest(target, rows, "k", "v").collect()))
    assert found == sorted([("a", 1, "old"), ("", 2, "null"), ("q", 0, ""), ("b", 7, ""), ("", 3, "new"), ("c", 0, "only")])


def test_only_texts_that_fold_leave_the_jvm(spark):
    from postsieve.functions import text as T

    texts = ["plain", "Übermäßig, très être", "мир и труд", "漢字と", "ﬁn", "áb", "x y", "½ ② ｆｕｌｌ", "Å Å", None, ""]
    want = ["plain", "berm ig, tr s tre", "", "", "fin", "b", "x y", "1 2 2 full", "", None, ""]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", F.col("x").rlike(T._folds_to_ascii()).alias("folds"), T.sanitize_ascii(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in found] == want
    assert [bool(r.folds) for r in found[:4]] == [False, False, False, True] and all(r.folds for r in found[4:9])
    plan = "\n".join(plan_of(spark.createDataFrame([("a",)], "x string").select(T.sanitize_ascii(F.col("x")))))
    assert re.search(r"ArrowEvalPython \[fold\(CASE WHEN", plan) or "Project [CASE WHEN RLIKE" in plan


def test_short_classes_and_missing_ends_are_spread():
    from postsieve.operators.lexicon import Lexicon, spread

    cases = {"tionou|ou[- ]tions?": "tionou|ou-tion|ou tion", r"[a.]bcd": r"abcd|\.bcd", r"\bgpus?": r"\bgpu", r"ab\d?": r"ab\d?", "[a-c]de": "[a-c]de", "[ab]+cd": "[ab]+cd", "(ab|c)[de]": "(ab|c)[de]"}
    assert {p: spread(p) for p in cases} == cases
    assert Lexicon({"k": "tionou|ou[- ]tions?"}).exact == {"k"}


def test_a_gate_without_texts_gives_the_same_rows(spark):
    from postsieve.functions import text as T
    from postsieve.operators import rules

    df = spark.createDataFrame([("widget", "x", t, 1) for t in ("text", " \n", "", None, " ")] + [("rod", "x", "text", 1)], "title string, location string, description string, salary_max long")
    cfg = rules.GateConfig(domain_words=("widget",))
    marked = df.withColumn("described", T.has_text(F.col("description")))
    want = sorted(map(tuple, rules.rule_gate(df, cfg).select("title", "stage", "reason").collect()))
    assert sorted(map(tuple, rules.rule_gate(marked.drop("description"), cfg, described=F.col("described")).select("title", "stage", "reason").collect())) == want
    with pytest.raises(ValueError):
        rules.rule_gate(marked, rules.GateConfig(min_years=4), described=F.col("described"))


def test_a_large_feed_is_not_joined_in_one_task(spark):
    plan = "\n".join(plan_of(QUERIES["batch_index"](spark, SF)))
    assert plan.count("rightHint=(strategy=broadcast)") >= 2


def test_weights_bind_what_is_used_often(spark):
    from postsieve.operators import skills

    docs = spark.createDataFrame([(1, "t", "gear")], "doc_id int, title string, description string")
    idf = spark.createDataFrame([("gear", 1.0)], "skill string, idf double")
    plan = "\n".join(plan_of(skills.posting_skill_weights(docs, {"gear": r"\bgear\b", "bolt": r"\bbolt\b"}, idf)))
    assert max(line.count(skills.PREFERRED_HEADER) for line in plan.split("\n")) == 1


def test_parts_of_one_file_are_dealt_out_to_several_tasks(spark):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    sizes = [r["count"] for r in QUERIES["skill_items"](spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_skill_items_with_odd_marks(spark):
    from postsieve.functions import text as T

    cases = {
        ("AWS (EC2, .Certified., S3)", "aws (A B C D, A B C, x, .-, Basic., Basics)"): ["AWS", "AWS EC2", "AWS S3", "aws A B C", "aws .-", "aws Basics"],
        ("\t(Abc)", "(Abc)", "A (b", "A (B) (C)", "A ((B))"): ["\t", "Abc", "(Abc)", "A (b", "A", "A ((B))"],
        ("**go/GO**", "**Go; rust/zig; Rust**", "x (coursework, ÉT, éT, \u2028, 9\tA)"): ["**go**", "**rust**", "zig", "x", "ÉT", "\u2028", "9\tA"],
        ("a", None): None,
        tuple(f"n{i % 40}, N{i}" for i in range(400)): [f"n{i}" for i in range(12)],
    }
    df = spark.createDataFrame([(i, list(items)) for i, items in enumerate(cases)], "i int, items array<string>")
    found = df.select("i", T.normalize_skill_items(F.col("items")).alias("y")).orderBy("i").collect()
    assert [r.y for r in found] == list(cases.values())
