"""Mixing sources to target weights along a curriculum.

Every source gets a share of the words of the whole mix by weight, but at most
``max_repeat`` times its own size; what it can't take is shared again by weight.
Within a source the documents stand in the order of the MD5 of their ids and are taken
whole, as often as the target asks: all of them in each full pass, and in the last pass
those whose middle word lies before the target.

A source's weight runs along the training time t in [0, 1] as ``share * (1 + a * (1 - 2 t))``
and integrates to its share; the slopes a sum to 0 over the shares, so that the mix is full
at any time.  A take whose middle is the fraction y of its source's words is due when the
integral ``t * (1 + a) - a * t**2`` reaches y.  Rows are range-sorted by that position.

Cumulative sizes are taken in two steps, over MD5 prefixes and within them, so that a large
source is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import n_words
from .store import written

#: Hex digits of the MD5 prefixes; 16**3 parts of a source.
PREFIX_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int, slope: float) -> DataFrame:
    """(source, source_size, target, a), one row a source; ``sizes`` has source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # windows over one row a source
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeat)
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    step = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(full), F.lit(0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(full), F.lit(0))).alias("open_weight"),
    )
    # With the sources before this one at their caps, the others share the rest at this level; the true level is the first that this source's cap holds.
    step = step.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    step = step.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("capped", "level"))).over(everything)["level"])
    step = step.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)))
    n = F.max("rank").over(everything)
    step = step.withColumn("raw", slope * (1 - 2 * F.col("rank") / F.greatest(n, F.lit(1))))
    mean = F.coalesce(F.sum(F.col("raw") * F.col("target")).over(everything) / F.nullif(F.sum("target").over(everything), F.lit(0.0)), F.lit(0.0))
    return step.select("source", "source_size", "target", (F.col("raw") - mean).alias("a"))


def _row_key(row_id: Column, source: Column, text: Column) -> tuple[Column, Column]:
    """128 bits of hash that rows share only with rows of the same id, source and text."""
    parts = [F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("v"), c.isNull().alias("n")) for c in (row_id, source, text)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, slope: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, source, size (words), source_size, target, takes, taken (words), before (words of its source ahead of it), a, and
    k1 and k2, a hash of id, source and text.

    Sources weigh ``weights`` in turn, in the order of their names, null last.  A null text has size 0; a document of size
    0 is taken as often as its neighbours are.  Rows that repeat an id are documents of their own.  Where all sizes are 0 the targets are 0.
    """
    text = F.col(text_col).cast("string")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit(""))))))  # rows without an id lie apart too
    key = [k.alias(n) for k, n in zip(_row_key(F.col(id_col), F.col(source_col), text), ("k1", "k2"), strict=True)]
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), digest.alias("digest"), *key)
    sizes = written(sizes.withColumn("part", F.substring("digest", 1, PREFIX_DIGITS)), "sizes")
    targets = written(source_targets(sizes, weights, max_repeat, slope), "targets")
    parts = sizes.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_before"))
    inside = Window.partitionBy("source", "part").orderBy("digest", "id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("before", F.col("part_before") + F.col("inside"))
    placed = placed.select("id", "source", "size", "before", "k1", "k2").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    passes = F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    rest = F.col("target") - passes * F.col("source_size")
    takes = passes + F.when(F.col("before") + F.col("size") / 2 <= rest, 1).otherwise(0)
    placed = placed.withColumn("takes", F.least(takes, F.lit(max_repeat)).cast("int"))
    return placed.withColumn("taken", F.col("size") * F.col("takes"))


def with_positions(plan: DataFrame) -> DataFrame:
    """``plan`` with positions, an array of the training position in (0, 1] of each take of its row: copy 0, 1, ..., the later the higher."""

    def position(copy: Column) -> Column:
        done = (copy * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.nullif("target", F.lit(0.0))
        y = F.least(F.coalesce(done, F.lit(0.0)), F.lit(1.0))
        b = 1 + F.col("a")
        return 2 * y / (b + F.sqrt(F.greatest(b * b - 4 * F.col("a") * y, F.lit(0.0))))

    every = F.filter(F.sequence(F.lit(0), F.greatest(F.col("takes") - 1, F.lit(0))), lambda copy: copy < F.col("takes"))
    return plan.withColumn("positions", F.transform(every, position))


def positions(plan: DataFrame) -> DataFrame:
    """One row per take of ``plan_mix``: id, copy (0, 1, ...) and position in (0, 1]."""
    return with_positions(plan).select("id", F.posexplode("positions").alias("copy", "position"))


def curriculum(plan: DataFrame) -> DataFrame:
    """``plan`` with positions, range-sorted by each row's first; rows without a take stand last."""
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    placed = with_positions(plan).withColumn("__first", first)
    return placed.repartitionByRange("__first", F.xxhash64("id")).sortWithinPartitions("__first", "id").drop("__first")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", position_col: str | None = None, **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan_mix`` takes it, range-sorted by training position.

    Rows without a take go.  Columns are those of ``docs``, and the position if ``position_col`` names one, which must be a new name.  Rows that repeat an id are
    documents of their own; of those with the same id, source and text, equal in any other column or not, each gets the takes of one of their rows of the plan.
    """
    if position_col is not None and position_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{position_col} is a column already")
    columns = [f"c{i}" for i in range(len(docs.columns))]  # no name of docs can clash with those of the plan
    rows = docs.toDF(*columns)
    of = lambda name: F.col(columns[docs.columns.index(name)])
    rows = rows.select("*", *[k.alias(n) for k, n in zip(_row_key(of(id_col), of(source_col), of(text_col).cast("string")), ("k1", "k2"), strict=True)])
    plan = plan_mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).select("id", "size", "before", "takes", "source_size", "target", "a", "k1", "k2")
    plan = written(plan, "plan")
    key = ["k1", "k2"]
    if plan.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        plan, rows = plan.withColumn("n", F.lit(1)), rows.withColumn("n", F.lit(1))
    else:
        plan = plan.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("before")))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*[c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]))))
    takes = with_positions(plan).where("takes > 0").select("k1", "k2", "n", F.explode("positions").alias("position"))
    joined = rows.join(takes, ["k1", "k2", "n"]).repartitionByRange("position", "k1", "k2").sortWithinPartitions("position", "k1", "k2")
    return joined.select(*columns, *(["position"] if position_col else [])).toDF(*docs.columns, *([position_col] if position_col else []))
