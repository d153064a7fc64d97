"""Ids that hold several texts, rare languages, and tables whose columns are named like the operators' own."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postsieve.llm import cotraining, decontam, dialogs, langid, linededup, minhash, mixing, periodic, pii, rules, tokenbin, tokencount, webtext
from postsieve.llm.queries import tokenizer_path


def words(rng, n):
    return [rng.choice("abcdefghijkl") + str(rng.randrange(30)) for _ in range(n)]


def linked(a, b):
    a, b = ({tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} for w in (a.split(), b.split()))
    return 100 * len(a & b) >= 80 * len(a | b)


def plain_components(rows):
    """The least id that links between rows, and ids that rows share, lead to."""
    found = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(rows, 2):
            least = min(found[i], found[j])
            if found[i] != found[j] and linked(a, b):
                found[i] = found[j] = least
                changed = True
    return found


def test_an_id_with_two_texts_links_by_both(spark):
    rng = random.Random(1)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, [*a, "more"]), (3, [*b, "more"])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in order], "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df.coalesce(1), shingle=2).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_repeated_ids_against_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, rng.randrange(10, 50)) for _ in range(25)]
    rows = []
    for _ in range(140):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(5))
        rows.append((rng.randrange(70), " ".join(w)))
    want = plain_components(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert {(r.doc_id, r.kept) for r in got} == {(i, i == c) for i, c in want.items()}


@pytest.mark.parametrize("n", [1, 5])
def test_every_language_is_learned(spark, n):
    rng = random.Random(n)
    rows = [("main", " ".join(words(rng, 30))) for _ in range(80)]
    rows += [(f"l{i:02d}", f"{chr(0x4E00 + 40 * i + k)}{chr(0x4E01 + 40 * i)}{chr(0x4E02 + 40 * i)} " * 8) for i in range(60) for k in range(n)]
    models = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert models.langs == sorted({r[0] for r in rows})
    found = langid.predict(spark.createDataFrame(rows, "lang string, text string"), models).collect()
    assert all(r.lang == r.lang_pred for r in found)


def test_few_texts_are_all_learned_from(spark):
    rows = [("en", "the cat"), ("de", "die katze"), ("fr", "le chat")]
    assert langid.fit(spark.createDataFrame(rows, "lang string, text string")).langs == ["de", "en", "fr"]


@pytest.mark.parametrize("seed", [1])
def test_mix_takes_what_the_plan_takes(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(12), " ".join(words(rng, rng.randrange(4))), f"s{rng.randrange(3)}", i) for i in range(150)] + [(7, "same text", "s1", 1000 + i) for i in range(9)] + [(None, None, None, 2000), (None, None, None, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    plan = mixing.plan_mix(docs).collect()
    want = Counter()
    for r in plan:
        want[r.id, r.source, r.size] += r.takes
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mix(docs).collect())
    assert +want == got
    one = spark.createDataFrame([(1, "w " * (i + 1), "a", i) for i in range(10)] + [(2, "w", "b", 0)], docs.schema)
    assert sum(len(r.text.split()) for r in mixing.mix(one).collect()) == sum(r.taken for r in mixing.plan_mix(one).collect())


NAMES = ("__text", "__position", "__id", "__k", "id", "key", "n", "k1", "position", "digest", "words", "take", "c0", "blocks", "runs", "bands", "point", "part", "h", "w")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 30)) + ".", "en" if i % 2 else "de", f"s{i % 3}", 9, *["v"] * len(NAMES)) for i in range(40)]
    rows += [(50, None, None, None, None, *[None] * len(NAMES)), (1, rows[1][1], "en", "s1", 9, *["v"] * len(NAMES)), (51, "", "en", "s1", 0, *[""] * len(NAMES))]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in NAMES)]))


OPERATORS = {
    "op1": lambda s, d: pii.find_pii(d), "op1_redact": lambda s, d: pii.redact(d), "op3": lambda s, d: tokencount.count_tokens(d, tokenizer_path("piece_bpe_32k.model")),
    "op2": lambda s, d: cotraining.score(d, cotraining.fit(d, s.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality long, toxic long"))),
    "op4": lambda s, d: linededup.dedup_lines(d), "op5": lambda s, d: langid.predict(d, langid.fit(d)), "op7": lambda s, d: rules.judge_quality(d), "op8": lambda s, d: minhash.near_duplicates(d),
    "op6": lambda s, d: tokenbin.read_tokens(tokenbin.write_tokens(d, tokenizer_path("byte_bpe_50k.json"), end_id=0), d.select("doc_id")),
    "op9": lambda s, d: decontam.decontaminate(d, s.createDataFrame([(1, "of no text at all in here")], "item_id long, text string")), "op10": lambda s, d: mixing.mix(d), "op11": lambda s, d: periodic.find_runs(d),
    "op12": lambda s, d: webtext.extract_text(d.drop("text", "n_chars").withColumn("html", F.col("lang"))), "op13": lambda s, d: dialogs.repair_conversations(d.withColumn("turn", F.lit(1)).withColumn("role", F.lit("user")), conv_col="doc_id")[1],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_named_like_the_operators_own(spark, odd, name):
    out = OPERATORS[name](spark, odd)
    assert len(set(out.columns)) == len(out.columns)
    assert len(out.select(out.columns).collect()) > 0


def test_kept_columns_named_like_outputs(spark, odd):
    with pytest.raises(ValueError, match="score"):
        langid.predict(odd.withColumnRenamed("n", "score"), langid.fit(odd))
    with pytest.raises(ValueError, match="n_tokens"):
        tokencount.count_tokens(odd.withColumnRenamed("n", "N_tokens"), tokenizer_path("piece_bpe_32k.model"))
    with pytest.raises(ValueError, match="position"):
        mixing.mix(odd, position_col="position")


def test_stages_with_such_columns(spark, odd, tmp_path):
    spark.createDataFrame([(1, "of no text at all in here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.token_ids(spark, docs, str(tmp_path)).count() == docs.count() > 0


def test_a_chunk_of_a_million_letters(spark):
    df = spark.createDataFrame([(1, "ab" * 500_000), (2, " " * 200_000)], "doc_id long, text string")
    counts = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, tokenizer_path("piece_bpe_32k.model")).collect()}
    assert 0 < counts[1] <= 1_000_001 and counts[2] > 0
