from types import SimpleNamespace

import pytest

from postsieve.llm.store import shared_dir, written


def _session(master, **conf):
    held = SimpleNamespace(get=lambda k, default=None: conf.get(k, default))
    return SimpleNamespace(conf=held, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session("spark://host:7077"))
    assert shared_dir(_session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c"


def test_written_tables_are_equal(spark):
    assert sorted(tuple(r) for r in written(spark.createDataFrame([(1, "a"), (2, None)], "i long, t string"), "t").collect()) == [(1, "a"), (2, None)]


def test_workers_drop_what_other_operators_keep():
    from postsieve.llm import tokenbin, tokencount, workers
    from postsieve.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    tokenbin.encoder(path)
    tokenbin.encoder(path)
    assert path in tokenbin._encoders
    workers.begin("langid")
    assert not tokenbin._encoders and not tokencount._counters


def test_scratch_tables_go(spark):
    from postsieve.llm.store import Scratch

    scratch = Scratch(spark)
    df = scratch.written(spark.range(3), "three")
    (path,) = scratch.paths
    assert df.count() == 3
    scratch.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
