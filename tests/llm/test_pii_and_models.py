import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsieve.llm import cotraining, langid, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def plain(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [(a, b, k) for a, k, b in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789+@.-( )ab%é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 ( " * 40_000, "." * 1000 + "@" + "a." * 50_000):
        assert isinstance(pii.base_spans(text), list)
    for text in ("a" * 300_000 + "1", "1 " * 100_000, "(" * 100_000 + "1", "@ " * 100_000, "a@b " * 20_000, "7777777 " + "x" * 300_000 + "@"):
        assert isinstance(pii.nodes(text, pii.base_spans(text)), list)


def graph(rng, n, n_keys):
    return [{"label": rng.choice([-1, -1, -1, 0, 4]), "shapes": [rng.randrange(4)], "checks": rng.randrange(4), "context": rng.randrange(4), "allowed": rng.choice([31, 17, 19]), "key": rng.randrange(n_keys)} for _ in range(n)]


def exact_marginals(p, g):
    """All labellings of a small graph, each weighed by its potentials."""
    own = np.array([p.shape[n["shapes"][0]] + p.checks[n["checks"]] + p.context[n["context"]] for n in g])
    free = [[y for y in range(pii.LABELS) if (n["allowed"] >> y & 1 if n["label"] < 0 else y == n["label"])] for n in g]
    pairs = [(i, i + 1, p.chain) for i in range(len(g) - 1)] + [(a, b, p.skip) for a, b in pii._skips([n["key"] for n in g])]
    out = np.zeros((len(g), pii.LABELS))
    for labels in product(*free):
        fixed = sum(own[i, y] for i, y in enumerate(labels) if g[i]["label"] < 0)
        out[range(len(g)), labels] += np.exp(fixed + sum(t[labels[a], labels[b]] for a, b, t in pairs))
    return out / out.sum(axis=1, keepdims=True)


def test_belief_propagation_against_enumeration():
    rng = random.Random(3)
    cells = [(t, b, y, 0, float(rng.randrange(1, 30))) for t in ("shape", "checks", "context") for b in range(4) for y in range(pii.LABELS)]
    cells += [(t, 0, x, y, rng.randrange(1, 9) + (20.0 if x == y else 0.0)) for t in ("chain", "skip") for x in range(pii.LABELS) for y in range(pii.LABELS)]
    p = pii.Potentials(cells)
    trees = [graph(rng, n, 10**9) for n in (1, 2, 3, 5, 6) for _ in range(6)]  # no key twice: chains, where messages are exact once they have gone all the way
    found, at = p.marginals(trees), 0
    for g in trees:
        assert np.abs(found[at : at + len(g)] - exact_marginals(p, g)).max() < 0.01
        at += len(g)
    loops = [graph(rng, 6, 2) for _ in range(25)]
    found = p.marginals(loops).reshape(25, 6, -1)
    exact = np.array([exact_marginals(p, g) for g in loops])
    assert np.abs(found - exact).mean() < 0.03 and (found.argmax(axis=2) == exact.argmax(axis=2)).mean() > 0.95


def test_planted_spans_that_no_pattern_finds(spark):
    """Recall of numbers without their prefix and of addresses with blanks, where they stand elsewhere in full, and of other separators; nothing in clean texts."""
    rng = random.Random(7)
    filler = lambda n=6: " ".join(rng.choice(["river", "stone", "walks", "under", "green"]) for _ in range(n))
    rows, planted = [], {}

    def number():
        return f"{rng.randrange(200, 999)}", f"{rng.randrange(200, 999)}", f"{rng.randrange(1000, 9999)}"

    def card():
        while True:
            digits = "4" + "".join(str(rng.randrange(10)) for _ in range(15))
            if pii.luhn(digits):
                return digits

    for i in range(400):
        a, b, c = number()
        rows.append((i, f"{filler()} +1 ({a}) {b}-{c} {filler()} u{i}@mail{i % 7}.example {filler()} {card()} {filler()} {i % 250}.7.{i % 9}.21 {filler()}"))
    for i in range(1000, 1120):
        a, b, c = number()
        shown = [f"{b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"][i % 4]
        rows.append((i, f"{filler()} +1 ({a}) {b}-{c} {filler(30)} {shown} {filler()}"))
        planted[i] = ("phone", shown)
    for i in range(2000, 2040):
        rows.append((i, f"{filler()} u{i}@mail.example {filler(20)} u{i} @ mail.example {filler()}"))
        planted[i] = ("email", f"u{i} @ mail.example")
    for i in range(3000, 3040):
        digits = card()
        shown = ".".join(digits[j : j + 4] for j in range(0, 16, 4))
        rows.append((i, f"{filler()} {digits} {filler(20)} {shown} {filler()}"))
        planted[i] = ("card", shown)
    for i in range(5000, 5300):
        rows.append((i, f"{filler()} {rng.choice(['order', 'item'])} {rng.randrange(10**7, 10**8)} {filler()} token {rng.getrandbits(120):x} {filler()} {''.join(str(rng.randrange(10)) for _ in range(22))}"))
    texts_of = dict(rows)
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(f"{kind}:{texts_of[i].rindex(x)}:{texts_of[i].rindex(x) + len(x)}" in found[i].spans.split(",") for i, (kind, x) in planted.items())
    false = sum(found[i].spans != "" for i in range(5000, 5300))
    extra = sum(len(found[i].spans.split(",")) > 4 for i in range(400))
    assert hit >= 0.95 * len(planted), hit / len(planted)
    assert false == 0 and extra == 0


def test_skip_chain_carries_a_label(spark):
    rng = random.Random(1)
    rows = [(i, f"call +1 (152) 555-{rng.randrange(1000, 9999)} now" if i % 2 else f"mail u{i}@x.example now") for i in range(200)]
    rows += [(1000, "ring +1 (152) 555-8590 first. later ask for 555-8590 again"), (1001, None), (1002, ""), (1003, "nothing 12 here"), (None, "u@x.example"), (1000, "twice u@x.example")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.n_email): r for r in found}
    assert by[(1000, 0)].spans == "phone:5:22,phone:44:52" and by[(1000, 0)].n_phone == 1
    assert by[(1001, 0)].spans == "" and by[(1001, 0)].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[(None, 1)].spans == "email:0:11"
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redact(spark):
    rows = [(1, "x u@x.example y", "k", 7), (2, None, "k", 8), (3, "clean", None, 9), (None, "v@x.example", "z", 0), (1, "x u@x.example y", "k", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, k int")
    out = pii.redact(docs.dropDuplicates())
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.spans, r.k) for r in out.collect()} == {1: ("x [email] y", "k", 7), 2: (None, "k", 8), 3: ("clean", None, 9), None: ("v@x.example", "z", 0)}


WORDS = {"aa": ["kalo", "mira", "tose", "pune"], "bb": ["wüx", "zyrq", "jöhk", "vwex"], "cc": ["ñora", "edić", "ulić", "oñea"]}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


@pytest.fixture(scope="module")
def models(spark):
    return langid.fit(spark.createDataFrame(texts(400), "doc_id long, text string, lang string"))


def test_languages_of_held_out_texts(spark, models):
    rows = texts(200, seed=9)
    found = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), models).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows]) > 0.99
    assert sum(r.rejected for r in found.values()) == 0 and all(0 <= r.score <= 1 for r in found.values())


def test_texts_without_letters_and_foreign_ones(spark, models):
    rows = [(1, None), (2, ""), (3, "12 .. !"), (4, "KALO Mira"), (5, "qqqq#" * 400), (6, "kalo " * 50_000), (7, "漢字かな" * 50), (8, "\U00020000\U0001F600")]
    found = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(found[i].rejected and found[i].score == 0 for i in (1, 2, 3))
    assert found[4].lang_pred == "aa" and found[6].lang_pred == "aa" and not found[6].rejected
    assert found[7].rejected
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), models).count() == 0


def test_fit_without_rows(spark):
    empty = langid.fit(spark.createDataFrame([(1, None, "x"), (2, "a", None)], "doc_id long, text string, lang string"))
    assert langid.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), empty).first().lang_pred == "und"


def test_probabilities_sum_to_one(models):
    for model in models.models:
        context = np.uint64(ord("k")) << np.uint64(16) | np.uint64(ord("a")) << np.uint64(0)
        letters = np.unique(models.grams & np.uint64(0xFFFF))
        assert model.prob((context << np.uint64(16)) | letters).sum() + model.prob(np.array([(context << np.uint64(16)) | np.uint64(0xFFFE)]))[0] == pytest.approx(1, abs=1e-6)


def plain_kneser_ney(texts_of_lang, everything):
    """Probability of a letter after three, by the textbook recursion over dicts of strings."""

    def grams(t):
        out = " ".join(re.findall(r"[^\W\d_]+", t.lower()))
        lead = " " if t and not t[0].isalpha() and out else ""
        tail = " " if t and not t[-1].isalpha() and out else ""
        out = "\0\0\0" + (out + tail if not lead else out + tail)
        return [out[i - 3 : i + 1].replace("\0", " ") for i in range(3, len(out))]

    alphabet = len({g[-1] for t in everything for g in grams(t)}) + 1
    counts = [Counter(g for t in texts_of_lang for g in grams(t))]
    for n in (3, 2, 1):
        counts.append(Counter(g[-n:] for g in {k for k in counts[-1]}))
    discounts = []
    for c in counts:
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discounts.append(min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones + twos else 0.5)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / alphabet
        c, d = counts[4 - n], discounts[4 - n]
        after = [v for k, v in c.items() if k[:-1] == gram[:-1]]
        lower = p(gram[1:])
        return (max(c.get(gram, 0) - d, 0) + d * len(after) * lower) / sum(after) if after else lower

    return p, grams


def test_kneser_ney_against_a_plain_one(spark):
    rows = [(t, lang) for _, t, lang in texts(60, seed=3)]
    counted = {}
    import pyarrow as pa

    from postsieve.llm.wordhash import text_slices

    for lang in WORDS:
        codes = np.concatenate([langid.grams(d, o)[0] for _, _, d, o in text_slices(pa.array([t for t, x in rows if x == lang]))])
        counted[lang] = np.unique(codes, return_counts=True)
    models = langid.LanguageModels(counted)
    tests = ["kalo mira", "wüx zyrq!", "ñora", "xyz kalo", "edić tose Ulić"]
    for lang, model in zip(models.langs, models.models, strict=True):
        p, grams = plain_kneser_ney([t for t, x in rows if x == lang], [t for t, _ in rows])
        for t in tests:
            for _, _, d, o in text_slices(pa.array([t])):
                codes = langid.grams(d, o)[0]
                assert model.prob(codes) == pytest.approx([p(g) for g in grams(t)], abs=1e-9)
                assert models.cross_entropy(d, o)[0][0, models.langs.index(lang)] == pytest.approx(-np.mean([np.log(p(g)) for g in grams(t)]), abs=1e-4)


def test_repeated_texts_count_once_in_the_sample(spark):
    rows = [(i, "kalo mira tose", "aa") for i in range(3000)] + [(5000 + i, t, lang) for i, t, lang in texts(300, seed=5)]
    models = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=100)
    assert models.langs == ["aa", "bb", "cc"]
    assert all(m.levels[0].counts.sum() < 100 * 250 for m in models.models)
    found = langid.predict(spark.createDataFrame(texts(60, seed=8), "doc_id long, text string, lang string"), models).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.98


def test_co_training(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["river", "stone", "walks"] if good else ["BUY!!", "NOW!!", "$$$"]) for _ in range(20))
        rows.append((i, text, "en", f"s{rng.randrange(3) if good else 3 + rng.randrange(3)}", len(text)))
        if i % 3 == 0:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = cotraining.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    more = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "xx", "new", 0)], docs.schema)
    found = {r.doc_id: r for r in cotraining.score(docs.union(more), model).collect()}
    assert all(found[i].kept == ("river" in t or "stone" in t or "walks" in t) for i, t, *_ in rows)
    assert len(found) == 802 and all(0 <= r.score <= 1 for r in found.values())


def plain_co_training(rows, labels, held, rounds):
    """Co-training over lists and dicts of words and values, with no hashing; scores by id."""
    words = {i: (t or "").split() for i, t, *_ in rows}
    meta = {i: (source, lang, int(np.floor(np.log2(max(n, 1))))) for i, _, lang, source, n in rows}
    n_buckets = cotraining.BUCKETS

    def ratio(tables, x, smoothing, kinds):
        return np.log((tables[1].get(x, 0) + smoothing) / (sum(tables[1].values()) + smoothing * kinds)) - np.log((tables[0].get(x, 0) + smoothing) / (sum(tables[0].values()) + smoothing * kinds))

    def view_scores(for_text, for_meta):
        w = [Counter(x for i, y in for_text.items() if y == label for x in words[i]) for label in (0, 1)]
        m = [[Counter(meta[i][f] for i, y in for_meta.items() if y == label) for label in (0, 1)] for f in range(3)]
        prior = np.log(max(sum(m[0][1].values()), 1) / max(sum(m[0][0].values()), 1))
        text = {i: np.mean([ratio(w, x, 1.0, n_buckets) for x in words[i]]) if words[i] else 0.0 for i in words}
        seen = [set(t[0]) | set(t[1]) for t in m]
        known = {i: prior + sum(ratio(m[f], meta[i][f], 2.0, len(seen[f])) for f in range(3) if meta[i][f] in seen[f]) for i in meta}
        ids, y = sorted(held), np.array([labels[i] for i in sorted(held)])
        out = []
        for found in (text, known):
            scale = cotraining.logistic(np.array([[found[i]] for i in ids]), y)
            out.append({i: v * scale[0] + scale[1] for i, v in found.items()})
        return (*out, ids, y)

    own = {i: y for i, y in labels.items() if i not in held}
    for_text, for_meta = dict(own), dict(own)
    for _ in range(rounds):
        text, known, *_ = view_scores(for_text, for_meta)
        sure = lambda odds: {i: int(v > 0) for i, v in odds.items() if i not in labels and max(1 / (1 + np.exp(-v)), 1 / (1 + np.exp(v))) >= cotraining.SURE}
        for_text, for_meta = own | sure(known), own | sure(text)
    text, known, ids, y = view_scores(for_text, for_meta)
    w = cotraining.logistic(np.array([[text[i], known[i]] for i in ids]), y)
    return {i: 1 / (1 + np.exp(-(w[0] * text[i] + w[1] * known[i] + w[2]))) for i in words}


def test_co_training_against_a_plain_one(spark):
    rng = random.Random(4)
    rows, labels = [], {}
    for i in range(300):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(["river", "stone", "walks", "light"] if rng.random() < (0.75 if good else 0.3) else ["BUY!!", "NOW!!", "$$$"]) for _ in range(rng.randrange(5, 25)))
        rows.append((i, text, rng.choice(["en", "fr"]), f"s{rng.randrange(4) if good else 2 + rng.randrange(4)}", len(text)))
        if i % 2 == 0:
            labels[i] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = spark.createDataFrame([(i,) for i in labels], "id long")
    held = {r.id for r in ids.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1000)) < 300).collect()}
    model = cotraining.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    found = {r.doc_id: r.score for r in cotraining.score(docs, model).collect()}
    want = plain_co_training(rows, labels, held, cotraining.ROUNDS)
    assert max(abs(found[i] - want[i]) for i in want) < 1e-6


def test_co_training_takes_one_text_of_an_id_whatever_the_order(spark):
    rng = random.Random(5)
    rows = [(i % 60, " ".join(rng.choice("abcdef") for _ in range(8)), None, "s", i) for i in range(240)] + [(None, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, quality int")
    one, two = cotraining.fit(docs, labels), cotraining.fit(docs.repartition(7, "n_chars"), labels)
    assert np.allclose(one.views.words, two.views.words) and np.allclose(one.combined, two.combined)


def test_co_training_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    model = cotraining.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert cotraining.score(docs, model).first().score == pytest.approx(0.5)
