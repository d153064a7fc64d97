"""Key filters, keyed tables, successor search and the one-pass lexicon."""

import glob
import os
import random
import re
import string
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsieve.operators import dedup, entity, reconcile, skills, state
from postsieve.operators.keyed_table import KeyedTable
from postsieve.operators.lexicon import Lexicon, required_literals, trie_pattern


# Lexicon


def test_required_literals():
    cases = {
        r"\baws\b|amazon web services": (["aws", "amazon web services"], False), "terraform|opentofu": (["terraform", "opentofu"], True), r"lift[- ]and[- ]shift": (["shift"], False),
        r"c\+\+|\bcpp\b": (["c++", "cpp"], False), r"migrat\w+ to (?:the )?cloud": (["migrat"], False), r"a{2}bc": (["bc"], False), r"ab+?c": (["ab"], False), r"re-?platform": (["platform"], False),
        r"x": None, r"\d+|gpu": None, r"(?i)foo": None, r"\Qab\E": None, r"\x41bc": None, r"(foo|bar)": None, r"ab|": None, r"[a|b]cd": (["cd"], False), r"\p{L}ab": (["ab"], False), r"(?<!x)abc(?=d|e)": (["abc"], False),
    }
    assert {p: required_literals(p) for p in cases} == cases


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc+ ", min_size=1, max_size=4), min_size=1, max_size=8), st.text("abc+ ", max_size=20))
def test_trie_finds_the_longest_literal_at_each_place(literals, text):
    found = [m[1] for m in re.finditer(f"(?=({trie_pattern(literals)}))", text)]
    want = [max(hits, key=len) for i in range(len(text)) if (hits := [x for x in literals if text.startswith(x, i)])]
    assert found == want


def random_lexicon(rng):
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    shapes = [lambda: rf"\b{word()}\b", word, lambda: f"{word()}|{word()}", lambda: f"{word()}[ -]{word()}", lambda: f"{word()}s?", lambda: f"({word()}|{word()})+", lambda: rf"\b{word()} {word()}|{word()}\w+", lambda: rf"(?<![\p{{L}}]){word()}(?![\p{{L}}])"]
    return {f"k{i}": rng.choice(shapes)() for i in range(25)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lexicon_is_a_scan_of_every_pattern(spark, seed):
    rng = random.Random(seed)
    lexicon = random_lexicon(rng)
    texts = ["".join(rng.choice("abcABC  -é") for _ in range(rng.randrange(80))) for _ in range(120)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    t = F.lower(F.coalesce("text", F.lit("")))
    want = df.select("id", F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in lexicon.items()])).alias("keys"), F.map_filter(F.create_map(*[x for k, p in lexicon.items() for x in (F.lit(k), F.regexp_count(t, F.lit(p)))]), lambda k, n: n > 0).alias("counts"))
    got = df.select("id", skills.extract_skills(F.col("text"), lexicon).alias("keys"), skills.count_skills(F.col("text"), lexicon).alias("counts"))
    assert {r.id: (r["keys"], r.counts) for r in got.collect()} == {r.id: (r["keys"], r.counts) for r in want.collect()}


def test_a_text_is_scanned_once_for_all_literals(spark):
    lexicon = {f"k{i}": rf"\b{a}{b}q\b" for i, (a, b) in enumerate((a, b) for a in "abcdefghij" for b in "abcdefghijklmno")}
    assert len(lexicon) == 150 and not Lexicon(lexicon).always
    df = spark.createDataFrame([("none of them",)], "text string").select(skills.extract_skills(F.col("text"), lexicon).alias("k"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 and df.first().k == []
    empty = spark.createDataFrame([("a",)], "text string")
    assert empty.select(skills.extract_skills(F.col("text"), {}).alias("k"), skills.count_skills(F.col("text"), {"x": "a"}).alias("n")).first() == ([], {"x": 1})


# Successors


def test_prefix_match_is_startswith(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    keys = [word(8) for _ in range(150)] + [None, ""]
    queries = [(i, word(6)) for i in range(300)] + [(900, None), (901, ""), (902, "zzz"), (903, "abé"), (903, "abé")]
    got = entity.prefix_match(spark.createDataFrame(queries, "id int, q string"), "q", spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    want = [(i, q) for i, q in queries if q and any(k is not None and (k == q if len(q) < 3 else k.startswith(q)) for k in keys)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    none = spark.createDataFrame([], "key string")
    assert entity.prefix_match(spark.createDataFrame(queries, "id int, q string"), "q", none).count() == 0
    assert entity.prefix_match(spark.createDataFrame([], "id int, q string"), "q", none).count() == 0


def test_a_block_of_a_million_keys_is_many_tasks(spark):
    keys = spark.range(1_000_000).select(F.concat(F.lit("the"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("key"))
    queries = spark.range(2_000).select(F.concat(F.lit("the"), F.lpad((F.col("id") * 997).cast("string"), 7, "0")).alias("q")).union(spark.createDataFrame([("the",), ("the1",), ("the10000",), ("thea",)], "q string"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = entity.prefix_match(queries, "q", keys)
        assert found.count() == 1_004 - 1 + 2
        both = queries.select("q").union(keys.select("key")).repartitionByRange("q")
        sizes = [r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# Known keys


def test_key_filter_rules_out_no_known_key(spark):
    known = spark.range(0, 20_000, 2).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(20_000).select("id", F.concat(F.lit("k"), "id").alias("key")).union(spark.createDataFrame([(-1, None)], "id long, key string"))
    use = dedup.KeyFilter(known, "key")
    marked = use.marked(rows, F.col("key"), "maybe")
    counts = {(r.even, r.maybe): r["count"] for r in marked.groupBy((F.col("id") % 2 == 0).alias("even"), "maybe").count().collect()}
    assert counts[True, True] == 10_000 and (True, False) not in counts
    assert counts[False, True] / 10_000 < 0.03  # 1.4 % at 16 bits a key
    left = dedup.except_by_key(rows, known, "key")
    assert left.columns == rows.columns and {r.id for r in left.collect()} == {-1, *range(1, 20_000, 2)}
    full = dedup.KeyFilter(known, "key", n_keys=1)  # far too small: nothing is ruled out, and nothing is lost
    assert dedup.except_by_key(rows, known, "key", full).count() == 10_001
    assert dedup.except_by_key(rows, known.limit(0), "key").count() == rows.count() and dedup.except_by_key(rows.limit(0), known, "key").count() == 0


def test_rows_that_are_surely_unknown_are_not_shuffled(spark):
    known, rows = spark.range(1000).select(F.col("id").alias("key")), spark.range(5000, 9000).select(F.col("id").alias("key"), F.lit("x").alias("v"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.except_by_key(rows, known, "key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    fresh, rest = plan.split("SortMergeJoin")[0], plan.split("SortMergeJoin")[1]
    assert "Union" in fresh and "BroadcastHashJoin" in fresh and "hashpartitioning(key" not in fresh
    assert "hashpartitioning" in rest


# Keyed tables

SCHEMA = "key string, seq long, note string"


def files(path):
    return set(glob.glob(f"{path}/part=*/*.parquet"))


def rows_of(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def test_append_of_few_keys_writes_few_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "key", SCHEMA, parts=32)
    assert table.read().count() == 0
    table.append_new(rows_of(spark, [(f"k{i}", i, None) for i in range(500)] + [("k1", 0, "earlier"), (None, 7, "null key"), (None, 8, "again")]))
    assert len(files(path)) == 32 and table.read().count() == 501
    assert table.read().where("key = 'k1'").first().note == "earlier"
    before = files(path)
    few = rows_of(spark, [("k3", 900, "known"), ("new1", 901, None), ("new2", 902, None), ("new1", 903, "later")])
    table.append_new(few)
    assert len(files(path) - before) <= 2 and before <= files(path)
    assert table.read().count() == 503 and table.read().where("key = 'k3'").first().note is None
    again = files(path)
    table.append_new(few)  # a rerun changes nothing
    table.append_new(rows_of(spark, []))
    assert files(path) == again and table.read().count() == 503


def test_changes_rewrite_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "key", SCHEMA, parts=16)
    table.merge_latest(rows_of(spark, [(f"k{i}", i, f"n{i}") for i in range(300)]), "note")
    before = {f: os.stat(f).st_mtime_ns for f in files(path)}
    change = rows_of(spark, [("k5", 1000, "new"), ("k5", 1001, " "), ("fresh", 1002, "x")])
    for _ in range(2):
        table.merge_latest(change, "note")
        found = {r.key: (r.seq, r.note) for r in table.read().collect()}
        assert len(found) == 301 and found["k5"] == (5, "new") and found["fresh"] == (1002, "x") and found["k6"] == (6, "n6")
    kept = [f for f, t in before.items() if os.path.exists(f) and os.stat(f).st_mtime_ns == t]
    assert len(kept) >= 14
    table.upsert(rows_of(spark, [("k7", 5, "stale"), ("k8", 5000, "newest")]), "seq")
    found = {r.key: (r.seq, r.note) for r in table.read().collect()}
    assert len(found) == 301 and found["k7"] == (7, "n7") and found["k8"] == (5000, "newest")


def test_parts_are_pruned(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "key", SCHEMA, parts=8)
    table.append_new(rows_of(spark, [(c, i, c) for i, c in enumerate(string.ascii_letters)]))
    plan = table.read([1, 3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan
    assert sum(table.read([p]).count() for p in range(8)) == 52


# Audit runs and batches


def test_a_repeated_run_adds_nothing_and_a_day_is_one_folder(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(f"j{i}", "stage1", date(2024, 1, 1 + i % 3)) for i in range(30)], "job_fingerprint string, stage string, run_date date")
    for run_id, part in (("a", rows), ("b", rows.where("run_date = '2024-01-02'")), ("a", rows)):
        state.append_audit(part, path, run_id)
    assert state.read_audit(spark, path).count() == 40
    day = state.read_audit(spark, path, date(2024, 1, 2))
    assert day.count() == 20 and "PartitionFilters: [isnotnull(run_date" in day._jdf.queryExecution().executedPlan().toString()
    state.append_audit(rows.where("job_fingerprint = 'j1'"), path, "a")  # a rerun with fewer rows takes the place of its own
    assert state.read_audit(spark, path, date(2024, 1, 2)).count() == 11 and state.read_audit(spark, path).count() == 31


def test_stretches_follow_clustered_numbers(spark):
    """All arrival numbers but two within one per mille of their range."""
    rows = spark.range(20_000).select((F.col("id") + 10**6).alias("seq"), F.lit("a").alias("source")).union(spark.createDataFrame([(0, "a"), (10**9, "a"), (5, None), (3, None)], "seq long, source string"))
    rows = rows.withColumn("description", F.lit("text"))
    out = reconcile.batch_index(rows, 7)
    got = sorted((r.seq, r.batch_no * 7 + r.idx) for r in out.where("source = 'a'").collect())
    assert got == [(s, i) for i, s in enumerate([0, *range(10**6, 10**6 + 20_000), 10**9])]
    assert [(r.seq, r.idx) for r in out.where("source is null").orderBy("seq").collect()] == [(3, 0), (5, 1)]
    ends = rows.where("source = 'a'").agg(F.percentile_approx("seq", [i / reconcile.STRETCHES for i in range(1, reconcile.STRETCHES)], reconcile.ACCURACY)).first()[0]
    seqs = [0, *range(10**6, 10**6 + 20_000), 10**9]
    sizes = [sum(a <= s < b for s in seqs) for a, b in zip([-1, *ends], [*ends, 10**10], strict=True)]
    assert max(sizes) < 2 * len(seqs) / reconcile.STRETCHES


# Picks from large pools


def test_lazy_picks_are_those_of_every_round(spark, monkeypatch):
    rng = random.Random(6)
    all_skills = [f"s{i}" for i in range(12)]
    projects = [(f"p{i:03d}", f"p{i:03d}", rng.choice(["profile", "catalog"]), i) for i in range(60)]
    tags = [(p[0], s, rng.choice([0.2, 0.5, 1.0])) for p in projects for s in rng.sample(all_skills, rng.randrange(1, 4))]
    weights = [(d, s, rng.choice([0.5, 1.0, 2.0])) for d in range(40) for s in rng.sample(all_skills, rng.randrange(0, 6))] + [(99, "unheard", 1.0)]
    frames = (
        spark.createDataFrame([(d,) for d in [*range(40), 98, 99]], "doc_id long"), spark.createDataFrame(weights, "doc_id long, skill string, weight double"),
        spark.createDataFrame(projects, "id string, name string, kind string, pos int"), spark.createDataFrame(tags, "id string, skill string, depth double"),
    )
    rows = lambda: sorted((r.doc_id, r.picks, [round(x, 9) for x in r.scores], round(r.coverage, 9), r.uncovered) for r in skills.diversified_topk(*frames, k=4).collect())
    want = rows()
    monkeypatch.setattr(skills, "MOST_PROJECTS", 5)
    assert rows() == want and len(want) == 42


def test_ten_thousand_projects(spark):
    rng = random.Random(7)
    projects = spark.createDataFrame([(f"p{i}", f"p{i}", "catalog", i) for i in range(10_000)], "id string, name string, kind string, pos int")
    tags = spark.createDataFrame([(f"p{i}", f"s{rng.randrange(150)}", rng.random()) for i in range(10_000) for _ in range(3)], "id string, skill string, depth double").groupBy("id", "skill").agg(F.max("depth").alias("depth"))
    weights = spark.createDataFrame([(d, f"s{(7 * d + j) % 150}", 1.0 + j) for d in range(200) for j in range(8)], "doc_id long, skill string, weight double")
    out = skills.diversified_topk(weights.select("doc_id").distinct(), weights, projects, tags).collect()
    assert len(out) == 200 and all(len(set(r.picks)) == 3 and r.scores == sorted(r.scores, reverse=True) for r in out)
