import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postsieve.llm.perfecthash import PerfectHash, fingerprints
from postsieve.llm.queries import tokenizer_path
from postsieve.llm.tokenbin import Encoder, read_tokens, write_tokens
from postsieve.llm.tokencount import Counter, count_tokens, sentencepiece_vocabulary

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ALPHABET = " \n\t abcé,.!?12'　\xa0\x1c中the▁😀<"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(BPE)


@pytest.fixture(scope="module")
def counter():
    return Counter(sentencepiece_vocabulary(PIECES))


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(sentencepiece_vocabulary(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_encoder_is_the_library(encoder, text):
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_encoder_special_strings(encoder):
    for text in ("a<|endoftext|>b", "<|endoftext|>", "don't stop", "x" * 3000, "ﬁ ÀÉ ß ŁÓ"):
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_counts_are_the_library(counter, unigram, text):
    assert counter.count(text) == len(unigram.encode(text, add_special_tokens=False).ids)


def test_tie_keeps_the_piece_that_begins_first():
    vocabulary = [(f"<0x{b:02X}>", -100.0) for b in range(256)] + [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -3.0)]
    assert Counter(vocabulary).best("▁ab") == (-3.0, 1)
    with pytest.raises(ValueError):
        Counter([("a", 0.0)])


def test_count_tokens_of_nulls_and_empty(spark, unigram):
    rows = [(1, None, 5), (2, "", 6), (3, "the the", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: (r.n_chars, r.n_tokens) for r in count_tokens(df, PIECES).collect()}
    assert found == {1: (5, 0), 2: (6, 0), 3: (7, len(unigram.encode("the the").ids))}
    assert count_tokens(df.limit(0), PIECES).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=400))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    other = keys ^ np.uint64(1 << 40)
    other = other[~np.isin(other, keys)]
    slots = h.slots(other)
    hit = slots >= 0
    own = np.empty(len(keys), np.uint32)
    own[h.slots(keys)] = fingerprints(keys)
    assert (own[slots[hit]] == fingerprints(other[hit])).sum() <= 1


def test_round_trip(spark, encoder):
    rng = random.Random(3)
    rows = [(i * 7 - 50, " ".join(rng.choice(["the", "ab,", "é", "12", "x\ny"]) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (None, "lost"), (2000, "twice"), (2000, "twice again"), (1 << 40, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    store = write_tokens(docs, BPE)
    found = {r.key: r for r in read_tokens(store, docs.select("doc_id")).collect()}
    start = len(encoder.encode("lost")) // 2 + 1  # a null key comes first
    for key in sorted({k for k, _ in rows if k is not None}):
        texts = [t or "" for k, t in rows if k == key]
        ids = [i for t in texts for i in [*np.frombuffer(encoder.encode(t), "<u2").tolist(), 0]]
        r = found[key]
        assert (r.start, r.n_tokens, r.n_rows) == (start, len(ids), len(texts))
        got = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert got == ids or (len(texts) > 1 and sorted(got) == sorted(ids))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        start += len(ids)
    assert len(found) == len({k for k, _ in rows if k is not None})
    unknown = spark.createDataFrame([(5_000_000,), (None,)], "k long")
    assert read_tokens(store, unknown).count() == 0
    empty = write_tokens(docs.limit(0), BPE)
    assert read_tokens(empty, docs.select("doc_id")).count() == 0
