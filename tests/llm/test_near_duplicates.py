import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsieve.llm import wordhash
from postsieve.llm.components import connected_components
from postsieve.llm.minhash import densified, near_duplicates

SCHEMA = "doc_id long, text string, bands string, id string"


def brute(texts: dict, width: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_components_match_brute_force(spark):
    rows = [*corpus(1, 120), (500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "a  b\x0bc"), (506, "A b C")]
    for width in (2, 5):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=width).collect()}
        assert found == brute(dict(rows), width)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a b c d e f", "p", "q"), (3, "a b c d e f", None, None), (1, "a b c d e f", "x", "y"), (1, "a b c d e f", "x", "y"), (2, None, None, None)]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()), key=str)
    assert found == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (None, None, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hub_that_is_not_the_least_id(spark):
    """Copies that link only through an original with the largest id."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        own = list(words)
        for j in rng.sample(range(0, 200, 10), 8):
            own[j] = f"v{i}_{j}"
        rows.append((i, " ".join(own)))
    rows.append((1000, " ".join(words)))
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert found == {i: c for i, (_, c) in brute(dict(rows), 2).items()}


@pytest.mark.parametrize("size", [10, 100, 600])
def test_clusters_that_only_hubs_link(spark, size):
    """Every copy is near its hub alone; hubs stand second, so that neither least ids nor one round of stars is enough."""
    rng = random.Random(size)
    rows = []
    for hub in range(2):
        words = [f"h{hub}_{i}" for i in range(240)]
        rows += [(hub * 10_000 + 5_000, " ".join(words))]
        for i in range(size):
            own = list(words)
            for j in rng.sample(range(0, 240, 2), 11):
                own[j] = f"v{hub}_{i}_{j}"
            rows.append((hub * 10_000 + i, " ".join(own)))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).groupBy("component_id").count()
    assert {r.component_id: r["count"] for r in found.collect()} == {0: size + 1, 10_000: size + 1}


def template_group(seed: int, n: int, n_pairs: int) -> list[tuple]:
    """Texts that share a template and are just under 0.8 to each other, but for ``n_pairs`` pairs above it."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(176)]
    own = [[f"o{i}_{j}" for j in range(24 + i % 3)] for i in range(n)]
    for k in range(n_pairs):
        own[2 * k + 1][:10] = own[2 * k][:10]
    order = rng.sample(range(n), n)
    return [(order[i], " ".join([*template, *own[i]])) for i in range(n)]


def test_links_inside_crowded_buckets(spark):
    rows = template_group(8, 160, 40)
    want = {i: c for i, (_, c) in brute(dict(rows), 1).items()}
    assert len(set(want.values())) == 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=1).collect()} == want


def test_crowded_limit_changes_no_result(spark):
    rows = [*corpus(3, 100), *((1000 + i, t) for i, t in template_group(9, 40, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute(dict(rows), 1).items()}
    for crowded, block in ((1, 5), (1, 2_000), (1_000, 5)):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=1, crowded=crowded, block=block).collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabÉé\x0b\x1c12", max_size=30), max_size=12))
def test_words_of_slices(texts):
    import pyarrow as pa

    counts = []
    for _, _, data, offsets in wordhash.text_slices(pa.array(texts, pa.string()), 16):
        _, rows = wordhash.word_hashes(data, offsets)
        counts += np.diff(rows).tolist()
    assert counts == [len(t.encode().split()) for t in texts]


def test_densified_bins_agree_as_the_sets_do():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(200):
        values, filled = np.zeros((2, 64), np.uint64), np.zeros((2, 64), bool)
        for b in rng.choice(64, 10, replace=False):
            filled[:, b] = True
            values[:, b] = rng.integers(1, 1 << 60)
        odd = np.flatnonzero(filled[0])[:2]
        values[1, odd] = rng.integers(1, 1 << 60, 2)  # two of ten bins differ
        out = densified(values, filled)
        same.append((out[0] == out[1]).mean())
    assert abs(np.mean(same) - 0.8) < 0.03


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, text), (2, text + " tail"), (3, "other text of a few words")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).where(F.col("doc_id") == F.col("component_id")).count()
    assert found == 2
