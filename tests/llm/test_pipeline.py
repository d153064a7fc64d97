import pytest

import corpus_pipeline
from postsieve.llm import mixing


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("sf"))
    words = ["kalo", "mira", "tose", "pune", "rilo", "sano", "vite", "dura"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefghijklmnop") for _ in range(n))
    item = text(20)
    rows = [(i, text(60), "en", f"src{i % 3}", 300) for i in range(60)]
    rows += [(100, rows[0][1], "en", "src0", 300), (101, rows[1][1] + " more", "en", "src1", 300), (102, f"{text(10)} {item} {text(10)}", "en", "src2", 300), (103, None, None, None, None), (104, "123 456", "en", "src0", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = set(range(60))
    assert ids == [clean | {100, 101, 102}, clean | {102}, clean]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) <= 60 and {r.doc_id for r in out} <= set(range(60))
    ends = sorted((r.start, r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_shards_follow_the_training_order(spark, tmp_path):
    rows = [(i, f"kalo{i} mira tose", "en", f"src{i % 3}", 15) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.doc_id for r in mixing.mix(docs, position_col="at").orderBy("at", "doc_id").collect()]
    assert want != sorted(want) and len(want) > len(set(want))
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.token_ids(spark, spark.read.parquet(str(tmp_path / "mixed")), "").orderBy("start").collect()
    assert [r.doc_id for r in out] == want
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))
    for i in set(want):
        assert [r.copy for r in out if r.doc_id == i] == list(range(want.count(i)))


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
