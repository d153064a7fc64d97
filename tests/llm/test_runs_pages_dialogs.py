import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postsieve.llm import dialogs, periodic, webtext
from postsieve.llm.queries import op11_periodic_runs, op12_html_text, op13_conversation_repair


def plain_runs(w, least=6, repeats=4):
    found = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if j > i and len(stretch) >= max(least, repeats * q) and not any(stretch[k:] == stretch[:-k] for k in range(1, q)):
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found)


@st.composite
def word_lists(draw):
    w = draw(st.lists(st.integers(0, draw(st.integers(0, 5))), max_size=60))
    for _ in range(draw(st.integers(0, 3))):
        if len(w) > 8:
            a, p = draw(st.integers(0, len(w) - 1)), draw(st.integers(1, 8))
            for i in range(a + p, min(len(w), a + p * draw(st.integers(2, 8)))):
                w[i] = w[i - p]
    return w


@settings(max_examples=600, deadline=None)
@given(word_lists(), st.sampled_from([(6, 4), (3, 3), (12, 5)]))
def test_runs_are_those_of_all_lags(w, bounds):
    assert periodic.runs_of(np.array(w, np.int64), *bounds) == plain_runs(w, *bounds)


@settings(max_examples=200, deadline=None)
@given(word_lists())
def test_segments_are_stable_and_hold_all_runs(w):
    segments = periodic.segments(np.array(w, np.int64))
    assert all(min(w[a:b].count(x) for x in w[a:b]) >= 4 for a, b in segments)
    assert all(any(a <= s and s + m <= b for a, b in segments) for s, m, _ in plain_runs(w))


@pytest.mark.parametrize("w", [[1] * 300_000, [0, 0, 1] * 100_000, list(range(40_000)) * 5, [0] * 50_000 + [1] + [0] * 50_000])
def test_long_texts(w):
    runs = periodic.runs_of(np.array(w, np.int64))
    assert sum(m for _, m, _ in runs) >= len(w) - 1 and len(runs) <= 2


def plain_op11(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_is_the_plain_version(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "c", "dé", "e\x1cf", "中"]) + rng.choice(["", "x", "\n", "\t "]) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, None), (None, "a a a a a a"), (401, None), (402, " \n\x0b"), (403, "a b " * 9), (403, "a b " * 9), (403, "z " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain_op11(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op11_periodic_runs(spark, str(tmp_path / "none")).count() == 0


def test_find_runs_with_names_of_its_own(spark):
    df = spark.createDataFrame([("k", 1, "x", "y y y y y y y z"), (None, 2, "x", None)], "runs string, id int, collapsed string, text string")
    found = {r.runs_: (r.n_words, [tuple(x) for x in r.found], r.c) for r in periodic.find_runs(df, id_col="id").toDF("runs_", "n_words", "found", "c").collect()}
    assert found == {1: (8, [(0, 7, 1)], "y z"), 2: (0, [], "")}


# Pages


@pytest.fixture(scope="module")
def tree(spark):
    return webtext.fit(spark)


P = "Some words that make a sentence of the page, long enough to be read."
PAGES = {
    "semantic": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><header><p>{P}</p></header><article><h1>A &amp; B</h1><p>{P}<p>One\n two&nbsp;three<br>four</p><p>Be.</p></article><footer>&copy; me</footer><script>var t='<p>no</p>'</script></body></html>", f"A & B\n\n{P}\n\nOne two three four\n\nBe."),
    "comments": (f"<main><h1>T</h1><p>{P}</p></main><section class='post-comments'><article><p>{P}</p></article></section>", f"T\n\n{P}"),
    "boxes": (f"<div class='cookie-notice'><p>{P}</p></div><article class='has-sidebar'><p>{P}</p><aside>{P}</aside><div class='ad'>{P}</div><form><p>{P}</p><input></form><p>End.</p></article><div class='sidebar'><article>{P}</article></div>", f"{P}\n\nEnd."),
    "soup": (f"<div><a href=a>one</a> | <a href=b>two</a></div><p>{P} {P}</p><p>{P}</p><div><a href=c>three more words here</a></div>", f"{P} {P}\n\n{P}"),
    "cut": (f"<article><h1>T</h1><p>{P} a&am", f"T\n\n{P} a&am"),
    "hidden": (f"<article><p style='display: none'>{P}</p><p>{P} <!-- not <p>this</p> --></p><noscript>{P}</noscript></article>", P),
    "inline": ("<article><p>un<b>broken</b> <a href=x>li<i>nk</i></a>ed</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "unbroken linked\n\na\n\nb\n\nc\n\nd"),
    "named": (f"<div id='page' class='article-page'><div class='main-menu'>{P}</div><div class='post'><p>{P}</p><p>Yes.</p></div></div>", f"{P}\n\nYes."),
    "beside": (f"<div class='widget'><article><p>{P}</p></article></div>", P),
    "empty": ("", ""), "null": (None, ""), "bare": ("hi", ""), "tags": ("<div><p></p></div>", ""),
}


def test_pages(spark, tree):
    df = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()] * 2, "k string, html string")
    got = webtext.extract_text(df, tree).collect()
    assert len(got) == 2 * len(PAGES) and {r.k: r.text for r in got} == {k: v[1] for k, v in PAGES.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_tree_holds_most_of_its_labels(tree):
    from pyspark.ml.linalg import Vectors

    pairs = [(int(tree.predict(Vectors.dense(b["f"]))), int(y)) for page, label in webtext.LABELLED for b, y in zip(webtext.flat_blocks(webtext._filled(page)), label, strict=True)]
    assert len(pairs) > 150 and sum(a == b for a, b in pairs) >= 0.97 * len(pairs)


def test_tree_judges_pages_that_it_has_not_seen(spark):
    """Each half of the labelled pages by a tree of the other."""
    from pyspark.ml.linalg import Vectors

    right = total = 0
    for i in range(2):
        tree = webtext.fit(spark, webtext.LABELLED[1 - i :: 2])
        for page, label in webtext.LABELLED[i::2]:
            pairs = [(int(tree.predict(Vectors.dense(b["f"]))), int(y)) for b, y in zip(webtext.flat_blocks(webtext._filled(page)), label, strict=True)]
            right, total = right + sum(a == b for a, b in pairs), total + len(pairs)
    assert right >= 0.8 * total


def test_pages_of_odd_shape(spark, tree):
    deep = "<div>" * 20_000 + P + "</p>" * 20_000
    pages = [deep, "<" * 50_000, "<p>" * 20_000 + P, "&" * 20_000, f"<article>{'<p>' + P + '</p>' * 3}</article>" * 2_000, "<a href='" * 5_000]
    got = webtext.extract_text(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string"), tree).collect()
    assert len(got) == len(pages) and {r.i: r.text for r in got}[4].count(P) == 2_000


def test_clashing_names_of_pages(spark, tree):
    df = spark.createDataFrame([(1, "b", f"<article>{P}</article>")], "c0 int, blocks string, html string")
    assert [tuple(r) for r in webtext.extract_text(df, tree).collect()] == [(1, "b", P, len(P))]
    with pytest.raises(ValueError):
        webtext.extract_text(df.withColumnRenamed("c0", "text"), tree)
    with pytest.raises(ValueError):
        webtext.fit(spark, [("<p>a</p><p>b</p>", "1")])


def test_op12_of_generated_pages(spark, tmp_path):
    import html

    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        parts = [" ".join(rng.choice(["of", "a&b", "thé", "word,"]) for _ in range(rng.choice([1, 3, 30, 90]))) for _ in range(rng.randrange(1, 9))]
        want[i] = "\n\n".join(parts)
        body = f"<h1>{html.escape(parts[0])}</h1>" + "".join(f"<p>{html.escape(p)}{rng.choice(['</p>', '', '<br>'])}" for p in parts[1:])
        rows.append((i, "u", f"<nav><ul><li><a href=x>{parts[0][:9]}</a></li></ul></nav><div class=ad>{parts[0][:60]}</div><article>{body}</article><footer>me</footer>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op12_html_text(spark, str(tmp_path)).collect()
    assert {r.page_id: r.text for r in got} == want and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


# Conversations


def plain_cheapest(rows):
    """Dijkstra's algorithm over (cost, edits)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        last = roles[-1:]
        if (at, last) in done:
            continue
        if at == len(rows) and last in ("", "a"):
            return cost, edits
        done.add((at, last))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        made = follow[-1]
        heapq.heappush(heap, (cost + 3, edits + "I", at, made))
        if at < len(rows):
            letter, dead, truncated = rows[at]
            heapq.heappush(heap, (cost + 4, edits + "D", at + 1, last))
            if not dead:
                heapq.heappush(heap, (cost + 3 + 3 * truncated, edits + "R", at + 1, made))
                if letter and letter in follow:
                    heapq.heappush(heap, (cost + 3 * truncated, edits + "K", at + 1, letter))
    return None


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans()).map(lambda r: (r[0], r[1], r[2] and not r[1])), max_size=12))
def test_auction_finds_the_cheapest_and_least_edits(rows):
    assert dialogs.cheapest(rows) == plain_cheapest(rows)


def test_long_conversation():
    rng = random.Random(2)
    rows = [(rng.choice("sua"), rng.random() < 0.1, False) for _ in range(20_000)]
    cost, edits = dialogs.cheapest(rows)
    assert sum(e != "I" for e in edits) == len(rows)
    assert cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in edits)
    assert dialogs.cheapest(rows[:300]) == plain_cheapest(rows[:300])


def plain_op13(turns):
    out = []
    for conv in {t[0] for t in turns}:
        rows = []
        for _, turn, role, text in [t for t in turns if t[0] == conv]:
            role, text = (" " if x is None else x for x in (role, text))
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            role = "user" if hit == 4 else role
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        flags, seen = [], set()
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            flags.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, edits = plain_cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, flags, strict=True)])
        at, kept = 0, []
        for e in edits:
            last = kept[-1][0][:1] if kept else ""
            if e == "I":
                kept.append(("assistant" if last == "u" else "user", ""))
                continue
            if e != "D":
                kept.append((rows[at][1] if e == "K" else "assistant" if last == "u" else "user", rows[at][2]))
            at += 1
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, flags.count("blank"), flags.count("duplicate"), flags.count("truncated"), illegal, cost, edits, sha))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", " \n", "", None, "Why? ", "a:b\nc.", "é."]
    rows = [(i, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) or None) for i in range(150) for t in range(rng.randrange(9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(1500)]
    rows += [(501, None, "user", "a."), (501, None, "user", "a."), (501, None, "assistant", "b."), (502, 7, "user", None), (503, 3, "user", "x."), (503, 3, "assistant", "y."), (503, 3, "user", "x.")]
    return rows + [(None, t, "user", "z.") for t in range(6)] + [(None, None, None, None)]


def test_op13_is_the_plain_version(spark, turns, tmp_path):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in op13_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_op13(turns)


def test_repair_in_small_batches_and_any_row_order(spark, turns):
    rows = [t for t in turns]
    schema = "conv_id long, turn long, role string, text string"
    _, want = dialogs.repair_conversations(spark.createDataFrame(rows, schema))
    want = sorted((tuple(r) for r in want.collect()), key=repr)
    random.Random(1).shuffle(rows)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        audits, got = dialogs.repair_conversations(spark.createDataFrame(rows, schema).repartition(3))
        got = sorted((tuple(r) for r in got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == want
    again, _ = dialogs.repair_conversations(spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in got], schema))
    assert {r.audit.replace("K", "") for r in again.where("blank + duplicate + truncated = 0").collect()} <= {""}


def test_no_turns_and_clashing_names(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    audits, rows = dialogs.repair_conversations(empty)
    assert audits.count() == 0 and rows.count() == 0
    df = spark.createDataFrame([("c", 1, "user", "A.", 1, "d"), ("c", 2, "assistant", "B.", 2, "d")], "id string, turn int, role string, text string, kind int, digest string")
    audits, rows = dialogs.repair_conversations(df, conv_col="id")
    assert [(r.id, r.cost, r.audit) for r in audits.collect()] == [("c", 0, "KK")]
    assert [tuple(r) for r in rows.orderBy("place").collect()] == [("c", 0, "K", "user", "A."), ("c", 1, "K", "assistant", "B.")]
