"""Streams run to their end equal the batch results."""

import math
import random
import time
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postsieve.operators import dedup
from postsieve.plans.queries import QUERIES
from postsieve.streaming import flows

T0 = datetime(2024, 1, 1)


def run(stream, tmp_path, name):
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def source(spark, tmp_path, rows, schema, files=1):
    df = spark.createDataFrame(rows, schema)
    for i in range(files):
        df.where(F.lit(i) == F.floor(F.col("i") * files / len(rows))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_first_seen(spark, tmp_path):
    rows = [(i, f"k{i % 4}", T0 + timedelta(hours=i)) for i in range(24)]
    out = run(flows.first_seen(source(spark, tmp_path, rows, "i int, key string, ts timestamp", 3), "key"), tmp_path, "out")
    assert sorted(r.key for r in out.collect()) == ["k0", "k1", "k2", "k3"]


def test_split_fresh_loses_nothing_and_repeats_safely(spark, tmp_path):
    rows = [(i, "linkedin" if i % 2 else "x", None if i % 3 == 0 else T0 - timedelta(hours=i)) for i in range(40)]
    stream = source(spark, tmp_path, rows, "i int, source string, posted_at timestamp", 2)
    write = flows.split_fresh_to(T0, 24, ["linkedin"], str(tmp_path / "fresh"), str(tmp_path / "stale"))

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    fresh, stale = dedup.split_fresh(spark.createDataFrame(rows, "i int, source string, posted_at timestamp"), T0, 24, ["linkedin"])
    for name, want in (("fresh", fresh), ("stale", stale)):
        assert sorted(r.i for r in spark.read.parquet(str(tmp_path / name)).collect()) == sorted(r.i for r in want.collect())


def test_stage_counts(spark, tmp_path):
    rows = [(i, f"s{i % 2}", "REJECT", T0 + timedelta(hours=6 * i)) for i in range(20)]
    out = run(flows.stage_counts(source(spark, tmp_path, rows, "i int, stage string, verdict string, ts timestamp"), late="0 seconds"), tmp_path, "out")
    assert {(r.day.day, r.stage): r.n for r in out.collect()} == {(d, s): 2 for d in range(1, 5) for s in ("s0", "s1")}


def test_verdict_lifetimes(spark, tmp_path):
    day = timedelta(days=1)
    rows = [(0, "a", True, T0), (1, "a", True, T0 + 10 * day), (2, "a", False, T0 + 11 * day), (3, "a", False, T0 + 15 * day), (4, "a", False, T0 + 19 * day), (5, "b", False, T0 + day), (6, "b", False, T0 + 7 * day)]
    with flows.state_with_lifetimes(spark):
        out = run(flows.verdict_ttl(source(spark, tmp_path, rows, "i int, company_key string, verified boolean, ts timestamp")), tmp_path, "out")
    assert sorted((r.company_key, r.verified, r.ts) for r in out.collect()) == [("a", False, T0 + 11 * day), ("a", False, T0 + 19 * day), ("a", True, T0), ("b", False, T0 + day)]


def test_full_queries_count_every_event(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.ts.date(), r.event_type, r.value) for r in spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz")).collect()]
    assert max(r[0] for r in rows).isoformat() >= "2024-01-20"
    counts, usage = Counter((day, kind, "DAILY" if kind == "purchase" else "REJECT") for day, kind, _ in rows), {}
    for day, kind, value in rows:
        for back in range(7):
            u = usage.setdefault((day - timedelta(days=back), "other" if kind == "error" else kind), [0, 0])
            u[0] += 1
            u[1] += math.floor(value * 100)
    assert {(r.day, r.stage, r.verdict): r.n for r in QUERIES["stream_stage_counts"](spark, d).collect()} == counts
    found = QUERIES["stream_usage"](spark, d).withColumn("start", F.col("start").cast("date")).collect()
    assert {(r.start, r.purpose): [r.calls, r.input_tokens] for r in found} == usage


def test_verdicts_over_batches_as_in_one(spark, tmp_path):
    """Verdicts that repeat, contradict and run out, in one batch and in several, against a loop."""
    rng = random.Random(9)
    rows = sorted(((i, f"k{rng.randrange(6)}", rng.random() < 0.6, T0 + timedelta(hours=rng.randrange(24 * 60), microseconds=rng.randrange(10**6))) for i in range(300)), key=lambda r: r[3])
    want, known = [], {}
    for _, key, verified, ts in rows:
        held = known.get(key)
        if held is None or held[0] != verified or ts - held[1] >= timedelta(days=5 if held[0] else 2):
            known[key] = (verified, ts)
            want.append((key, verified, ts))
    schema = "i int, company_key string, verified boolean, ts timestamp"
    for parts in (1, 4):
        folder = tmp_path / f"in{parts}"
        for k in range(parts):
            spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
            time.sleep(1.1)  # files are read in the order of their times
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        with flows.state_with_lifetimes(spark):
            out = run(flows.verdict_ttl(stream, positive_days=5, negative_days=2), tmp_path, f"out{parts}")
        assert sorted((r.company_key, r.verified, r.ts) for r in out.collect()) == sorted(want)
    assert {v for _, v, _ in want} == {True, False} and len(want) < len(rows)


def test_verdicts_on_the_store_clock(spark, tmp_path):
    rows = [(0, "a", True, T0), (1, "a", True, T0 + timedelta(days=1)), (2, "b", None, T0), (3, None, True, T0)]
    stream = flows.verdict_ttl(source(spark, tmp_path, rows, "i int, company_key string, verified boolean, ts timestamp"), clock="processing")
    with flows.state_with_lifetimes(spark):  # an available-now run would wait for lifetimes on and on
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out")).awaitTermination(200)
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert sorted((r.company_key or "", r.verified) for r in out.collect()) == [("", True), ("a", True)]
