import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.llm.decontam import decontaminate, find_leaks
from postsieve.llm.mixing import curriculum, mix, plan_mix, positions, with_positions


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def best_overlap(text, item, window=13):
    """Brute force: the most equal words of any window along any alignment."""
    w, v = text.lower().split(), item.lower().split()
    n = min(window, len(v))
    best = 0
    for start in range(-len(v), len(w)):
        same = [0 <= start + j < len(w) and w[start + j] == v[j] for j in range(len(v))]
        best = max([best, *(sum(same[a : a + n]) for a in range(len(v) - n + 1))])
    return best, n


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(word(rng) for _ in range(rng.randrange(8, 30)))) for i in range(12)]
    docs = []
    for i in range(80):
        words = [word(rng) for _ in range(rng.randrange(5, 60))]
        if i % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 4)):
                passage[rng.randrange(len(passage))] = word(rng)
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    want = {(d, i) for d, t in docs for i, x in items for best, n in [best_overlap(t, x)] if 100 * best >= 80 * n}
    for bound in (1_000_000, 0):  # broadcast and shuffled
        found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=bound, broadcast_ids=bound)
        got = {(r.doc_id, r.item_id) for r in found.collect()}
        assert got <= want and len(got) >= 0.95 * len(want)


def test_short_items_amid_longer_texts(spark):
    """Exact copies and every one-word substitution of items of 5 to 9 words, and every two-word one of 10 to 12."""
    rng = random.Random(11)
    items = [(n, " ".join(word(rng) for _ in range(n))) for n in range(5, 13)]
    docs, want = [], set()
    for n, x in items:
        for spots in [(), *((i,) for i in range(n)), *(c for c in combinations(range(n), 2) if n > 9)]:
            passage = [word(rng) if i in spots else w for i, w in enumerate(x.split())]
            docs.append((len(docs), " ".join([*(word(rng) for _ in range(4)), *passage, *(word(rng) for _ in range(rng.choice((3, 10))))])))
            want.add((docs[-1][0], n))
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_exact_items_of_any_length_at_start_middle_and_end(spark):
    """Items of 5 to 40 words: every exact copy, and at least 95 in 100 of those with a fifth of the words of some window replaced."""
    rng = random.Random(13)
    items = [(n, " ".join(word(rng) for _ in range(n))) for n in range(5, 41)]
    docs, exact, near = [], set(), set()
    for n, x in items:
        for place in ("start", "middle", "end", "alone"):
            for changed in (0, 1):
                passage = x.split()
                if changed:
                    most = min(n, 13) - -(-80 * min(n, 13) // 100)
                    for at in rng.sample(range(min(n, 13)), most):
                        passage[at] = word(rng)
                before = [word(rng) for _ in range(9)] if place in ("middle", "end") else []
                after = [word(rng) for _ in range(9)] if place in ("middle", "start") else []
                docs.append((len(docs), " ".join([*before, *passage, *after])))
                (near if changed else exact).add((docs[-1][0], n))
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert exact <= found <= exact | near and len(found & near) >= 0.95 * len(near)


def test_every_exact_passage_is_found_whatever_its_case(spark):
    rng = random.Random(5)
    item = " ".join(word(rng) for _ in range(20))
    rows = [(1, f"before, {item.upper()}. after", "x"), (2, None, "x"), (3, "", None), (4, item.replace(" ", ", "), "x"), (None, item, "x"), (5, "clean text of some words that is not there", "y"), (4, item, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "a b c")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_same) for r in find_leaks(docs, bench).collect()} == {(1, 7, 13), (4, 7, 13)}
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 5, None]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def targets(sizes, weights=(1, 2, 3)):
    """Brute force: cap, share again, until none is above."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, capped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(w[s] for s in sizes if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else free * w[s] / open_weight for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", None, "c", "zz"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(names[: 2 + seed]) if i % 4 else names[0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = plan_mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in plan if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 30
    assert all(r.taken <= 3 * r.size for r in plan) and len(plan) == len(rows)
    again = {r.id: r.taken for r in plan_mix(docs.repartition(7)).collect()}
    assert again == {r.id: r.taken for r in plan}


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w w w", f"s{i % 3}") for i in range(1200)]
    plan = plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    at = positions(plan).join(plan.select("id", "source", "a", "target"), "id").collect()
    assert all(0 < r.position <= 1 for r in at)
    for s in ("s0", "s1", "s2"):
        own = [r for r in at if r.source == s]
        a = own[0].a
        for t in (0.25, 0.5, 0.75):  # the share taken by t is the integral of the weight
            assert sum(r.position <= t for r in own) / len(own) == pytest.approx(t * (1 + a) - a * t * t, abs=0.01)
    assert sum(r.a * r.target for r in plan.select("source", "a", "target").distinct().collect()) == pytest.approx(0, abs=1e-6)


def test_positions_against_numeric_integration_and_inversion(spark):
    rng = random.Random(21)
    rows = [(i, "w " * rng.randrange(0, 40), f"s{rng.randrange(5)}") for i in range(500)] + [(None, "w w", "s1"), (None, "w w w", "s1")]
    plan = plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    grid = np.linspace(0, 1, 20_001)
    for r in with_positions(plan).collect():
        rate = 1 + r.a * (1 - 2 * grid)
        area = np.concatenate([[0.0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(grid))])
        due = [min((copy * r.source_size + r.before + r["size"] / 2) / r.target, 1.0) for copy in range(r.takes)]
        assert r.positions == pytest.approx(np.interp(due, area, grid), abs=1e-6)
    firsts = [r.positions[0] if r.positions else 2.0 for r in curriculum(plan).collect()]
    assert firsts == sorted(firsts) and len(firsts) == 502


def test_mix_rows(spark):
    rows = [(1, "a b", "x", 1), (2, "c", "x", 2), (3, None, None, 3), (None, "d e f", "y", 4), (5, "", "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    out = mix(docs)
    assert out.columns == docs.columns
    assert mix(docs.limit(0)).count() == 0
    assert plan_mix(docs.where("text is null")).select("target", "taken").distinct().collect() == [(0.0, 0)]
    placed = mix(docs, position_col="at").select(F.spark_partition_id().alias("p"), "at").collect()
    assert [r.at for r in placed] == sorted(r.at for r in placed)


def test_one_source_larger_than_all(spark):
    rows = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "w", "small") for i in range(5)]
    plan = plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.source: r.target for r in plan}
    assert by["small"] == 15 and by["big"] == pytest.approx(4005 - 15)
