import math
import random
import re
from collections import Counter

import pytest
from pyspark.errors import NumberFormatException
from pyspark.sql import functions as F

from postsieve.llm import rules
from postsieve.llm.linededup import dedup_lines, line_decisions
from postsieve.llm.rules import judge_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(rows, least=5):
    lines = [(i, n, tuple(WORD.findall(x))) for i, t in sorted((i, t or "") for i, t in rows) for n, x in enumerate(t.lower().split("\n")) if WORD.search(x)]
    out = {}
    for i, n, w in lines:
        earlier = [x for a, b, x in lines if (a, b) < (i, n)]
        near = False
        for x in set(earlier):
            if x == w or min(len(x), len(w)) < least:
                continue
            if len(x) == len(w):
                near |= sum(a != b for a, b in zip(x, w, strict=True)) == 1
            elif abs(len(x) - len(w)) == 1:
                long, short = (x, w) if len(x) > len(w) else (w, x)
                near |= any(long[:k] + long[k + 1 :] == short for k in range(len(long)))
        # What holds for a line holds for its equals: the class goes if its first line does.
        out[(i, n)] = (w, near)
    first, gone = {}, {}
    for (i, n), (w, near) in out.items():
        first.setdefault(w, ((i, n), near))
    for key, (w, _) in out.items():
        gone[key] = True if first[w][1] else (False if first[w][0] != key else None)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_decisions_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(0, 5)):
            w = list(rng.choice(base))
            kind = rng.randrange(4)
            at = rng.randrange(len(w))
            if kind == 1:
                w[at] = rng.choice("abcdefgh")
            elif kind == 2:
                w.insert(at, rng.choice("abcdefgh"))
            elif kind == 3 and len(w) > 1:
                del w[at]
            text.append((" " if rng.random() < 0.8 else "  ").join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(text)))
    found = {(r.id, r.line): r.near for r in line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_lines(rows)


def test_dedup_lines_texts(spark):
    schema = "doc_id long, text string, line string, near string"
    rows = [(2, "a b c d e f\n\nnew", "k", None), (1, "a b c d e f\nshort", None, "n"), (3, None, None, None), (4, "", None, None), (None, "short", None, None), (5, "a b X d e f\nSHORT", None, None), (1, "a b c d e f\nshort", None, "n")]
    found = [(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, schema), text_col="text").collect()]
    assert sorted(found, key=str) == sorted([(2, "\nnew"), (1, "a b c d e f\nshort"), (1, "a b c d e f\nshort"), (3, None), (4, ""), (None, "short"), (5, "")], key=str)
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", "x", "y", 3), (2, "a b c d e f\nnew", "x", "y", 4)], "doc_id long, text string, __gone string, lines string, id int")
    assert sorted((r.doc_id, r.text, r["__gone"], r.id) for r in dedup_lines(clash).collect()) == [(1, "a b c d e f", "x", 3), (2, "new", "x", 4)]
    with pytest.raises(NumberFormatException):
        line_decisions(spark.createDataFrame([("k1", "a b")], "doc_id string, text string")).count()


def test_bound_for_lines_of_any_length(spark):
    rows = [(1, "a"), (2, "b"), (3, "a b"), (4, "a c d"), (5, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.line): r.near for r in line_decisions(df, min_words=1).collect()} == brute_lines(rows, least=1)


def test_one_long_line(spark):
    line = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, line), (2, line.replace("w2500 ", "changed ")), (3, line + " more"), (4, line.replace("w7 ", "x ").replace("w9 ", "y "))]
    found = {r.id: r.near for r in line_decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: None, 2: True, 3: True, 4: None}


def brute_counts(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\t", "|", "\x1c"]) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    texts += [None, "", " ", "x y x y x y x", "a b c " * 40, "The quick brown fox jumps over it. " * 3 + " ".join(f"word{i}" for i in range(80)) + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in judge_quality(df).collect():
        n = brute_counts(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert 0 <= r.quality <= 1 and not (r.kept and r.base_failed)


def plain_em(patterns, n_rules):
    """Expectation-maximisation over single documents, with the prior as documents of each class."""
    prior = rules.PRIOR
    docs = [v for v, n in patterns for _ in range(n)]
    good = {j: list(prior["good"]) for j in range(n_rules)}
    bad = {j: list(prior["bad"]) for j in range(n_rules)}
    odds = 8 / 2
    for _ in range(400):
        post = []
        for v in docs:
            x = odds
            for j in range(n_rules):
                x *= good[j][v[j]] / bad[j][v[j]]
            post.append(x / (1 + x))
        total = sum(post)
        odds = (total + 8) / (len(docs) - total + 2)
        for j in range(n_rules):
            for table, weight, name in ((good, post, "good"), (bad, [1 - x for x in post], "bad")):
                counts = [rules.PRIOR_COUNT * p for p in prior[name]]
                for v, w in zip(docs, weight, strict=True):
                    counts[v[j]] += w
                table[j] = [c / sum(counts) for c in counts]
    return [math.log(odds)] + [math.log(good[j][v] / bad[j][v]) for j in range(n_rules) for v in range(3)]


def test_em_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(rules, "SETTLED", 1e-9)
    monkeypatch.setattr(rules, "ROUNDS", 200)
    rng = random.Random(9)
    accuracy = [(0.9, 0.1), (0.85, 0.2), (0.95, 0.4), (0.7, 0.3)]
    patterns = {}
    for _ in range(600):
        well = rng.random() < 0.75
        v = tuple(1 if rng.random() < 0.1 else 2 * int(rng.random() < (g if well else b)) for g, b in accuracy)
        patterns[v] = patterns.get(v, 0) + 1
    rows = [(list(v), n) for v, n in patterns.items()]
    found = rules.fit_votes(spark.createDataFrame(rows, "votes array<int>, n long"), 4)
    assert found == pytest.approx(plain_em(rows, 4), abs=2e-3)


def test_repeated_windows_of_very_long_texts(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n)) for n in (20, 400, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_repeat_words for r in judge_quality(df).orderBy("doc_id").collect()] == [brute_counts(t)[4] for t in texts]
    long = spark.createDataFrame([(1, " ".join(f"w{i % 70_000}" for i in range(120_000)))], "doc_id long, text string")
    assert judge_quality(long).first().n_repeat_words == 2 * 50_000


def test_clean_text_is_kept_and_shouting_is_not(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join(" ".join(rng.choice(["river", "stone", "walks", "under", "green", "light"]) + str(rng.choice("abcdefghij")) for _ in range(9)).capitalize() + "." for _ in range(n))

    rows = [(i, prose(10)) for i in range(60)] + [(100 + i, prose(8).upper().replace(" ", "!! ")) for i in range(6)]
    kept = {r.doc_id for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(60))
    assert judge_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", 3)], "doc_id long, text string, votes string, quality string, n_words int")
    assert judge_quality(df).count() == 1
    assert line_decisions(df.withColumn("words", F.lit("w"))).count() == 1
