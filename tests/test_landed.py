"""Landed payload files, broken ones among them."""

import gzip
import json

from postsieve.sources.landed import FILE_BITS, read_landed, split_landed


def test_what_a_file_cannot_give_is_an_error_row(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "sub").mkdir(parents=True)
    b.mkdir()
    (a / "one.json").write_text(json.dumps({"jobs": [1]}))
    (a / "two.json").write_text('{"jobs": [')
    (a / "sub" / "three.json").write_bytes(b"\xff\xfe{}")
    (a / "_hidden").write_text("{}")
    (a / "empty.json").write_text("")
    (b / "x.json.gz").write_bytes(gzip.compress(b'{"k": "\xc3\xa9"}'))
    (b / "y.json.gz").write_text("{}")
    (b / "z.json.gz").write_bytes(gzip.compress(b"{}" * 1000)[:20])
    rows = read_landed(spark, [("a", str(a), "none"), ("gone", str(tmp_path / "none"), "none"), ("b", f"file://{b}", "gzip")]).collect()
    found = {(r.source, r.token): (r.payload, r.error and r.error.split(":")[0]) for r in rows}
    assert found[("a", "one")] == ('{"jobs": [1]}', None) and found[("b", "x")] == ('{"k": "é"}', None)
    assert {k: e for k, (p, e) in found.items() if p is None} == {("a", "two"): "JSONDecodeError", ("a", "three"): "UnicodeDecodeError", ("a", "empty"): "JSONDecodeError", ("gone", None): "FileNotFoundError", ("b", "y"): "BadGzipFile", ("b", "z"): "EOFError"}
    by_seq = [(r.source, r.token, r.seq >> FILE_BITS) for r in sorted(rows, key=lambda r: r.seq)]
    assert by_seq == [("a", "empty", 0), ("a", "one", 0), ("a", "three", 0), ("a", "two", 0), ("gone", None, 1), ("b", "x", 2), ("b", "y", 2), ("b", "z", 2)]


def test_a_file_that_goes_between_listing_and_reading(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("{}")
    landed = read_landed(spark, [("s", str(tmp_path), "none")])
    assert landed.count() == 2 and landed.rdd.getNumPartitions() == 2
    rows = landed.select("token", "error")
    rows._jdf.queryExecution().executedPlan()  # listed
    (tmp_path / "a.json").unlink()
    assert {r.token for r in rows.collect()} >= {"b"}


def test_no_files_and_no_sources(spark, tmp_path):
    good, bad = split_landed(read_landed(spark, [("s", str(tmp_path), "none")]))
    assert good.count() == bad.count() == 0
    assert read_landed(spark, []).count() == 0
