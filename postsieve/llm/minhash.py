"""Near-duplicate documents by one-permutation MinHash.

Every document's set of word shingles is hashed once.  The hash's high bits choose
one of ``bands * rows`` bins, and a bin keeps its least hash; an empty bin borrows
from bins drawn by a fixed sequence until a filled one is met (optimal
densification), so that any two documents agree on a bin with the probability of
their Jaccard similarity.  Documents that agree on all bins of a band meet in a
bucket, and a bucket of m documents gives m - 1 candidate edges, a star.

A bucket's star is drawn round its least id, and once more round the point that meets
most others anywhere.  Buckets whose points are not yet connected get one more star, round a
point drawn by a hash of bucket and id, so that the buckets of one group have centres of their own.
The number of stars is fixed, and what is left is done exactly: all pairs of unconnected points
of a bucket are tested, or, for the points of crowded buckets, all pairs that share a shingle
among the rarest of both, without which no pair is similar enough (prefix filter).
Every link is confirmed on the full sets.  Exact copies are one point from the start.

At similarity 0.8 two documents share none of 32 bands of 4 rows with
probability 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash, workers
from .columns import let
from .components import connected_components
from .skew import join_hot
from .store import Scratch, written

#: Bits of the sketch that may differ, of 128, before a candidate is dropped unseen: at similarity 0.8 12.8 differ on
#: average, with a standard deviation of 3.4 to 3.9 for sets of ``SKETCHED`` shingles or more; unlike texts differ in about 63.
#: Smaller sets, whose bins borrow much of each other, are never dropped by it.
SKETCH_BITS, SKETCHED = 40, 32
#: Points of a bucket up to which all its pairs are tested; those of larger ones meet by rare shingles.
CROWDED = 64
#: Counts by which shingles are ordered from rare to frequent.
CELLS = 1 << 18
#: Points of one rare shingle that a task pairs with as many others.
BLOCK = 2_000


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Give each empty bin the value of the first originally filled bin in the bin's own fixed pseudo-random sequence."""
    n_bins = values.shape[1]
    todo = np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1))
    ids, attempt = np.arange(n_bins, dtype=np.uint64), 0
    missing = ~filled
    while len(todo):
        attempt += 1
        source = (wordhash.mix(ids * np.uint64(0x9E3779B9) + np.uint64(attempt << 20)) % np.uint64(n_bins)).astype(np.int64)
        take = missing[todo] & filled[todo][:, source]
        rows, bins = np.nonzero(take)
        values[todo[rows], bins] = values[todo[rows], source[bins]]
        missing[todo[rows], bins] = False
        todo = todo[missing[todo].any(axis=1)]
    return values


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x bands) and two 64-bit sketches, from sorted distinct shingle hashes."""
    bins = bands * rows
    values = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # grows with s: the first of a bin is its least
            first = np.flatnonzero(np.diff(at, prepend=np.uint64(bins)))
            values[i, at[first].astype(np.int64)] = s[first]
            filled[i, at[first].astype(np.int64)] = True
    values = wordhash.mix(densified(values, filled) + np.uint64(1))
    banded = values.reshape(len(sets), bands, rows)
    hashes = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        hashes = wordhash.mix(hashes * np.uint64(31) + banded[:, :, r])
    hashes = wordhash.mix(hashes + np.arange(bands, dtype=np.uint64))
    bits = np.zeros((len(sets), 128), np.uint8)
    bits[:, : min(bins, 128)] = (values[:, :128] & np.uint64(1)).astype(np.uint8)
    return hashes.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def _contents(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and 128 bits of hash of each set: equal for equal sets, and only for those."""
    mixed = [wordhash.mix(s) for s in sets]
    sums = np.array([s.sum(dtype=np.uint64) for s in mixed], np.uint64).view(np.int64)
    parities = np.array([np.bitwise_xor.reduce(s, initial=np.uint64(0)) for s in mixed], np.uint64).view(np.int64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(sums), pa.array(parities)]


def _profile(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("minhash")
        for batch in batches:
            for a, b, data, offsets in wordhash.text_slices(batch.column(1)):
                sets = list(wordhash.shingle_sets(*wordhash.word_hashes(data, offsets), shingle))
                hashes, sketch = _signatures(sets, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *_contents(sets),
                        _lists(hashes.ravel(), np.full(b - a, bands)),
                        pa.array(sketch[:, 0]),
                        pa.array(sketch[:, 1]),
                    ],
                    ["id", "n_shingles", "c1", "c2", "bands", "s1", "s2"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("minhash")
        for batch in batches:
            for a, b, data, offsets in wordhash.text_slices(batch.column(1)):
                sets = list(wordhash.shingle_sets(*wordhash.word_hashes(data, offsets), shingle))
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_contents(sets), _lists(values.view(np.int64), np.array([len(s) for s in sets]))], ["first", "n_shingles", "c1", "c2", "shingles"])

    return run


def _similar(a: Column, b: Column, percent: int) -> Column:
    return let(F.size(F.array_intersect(a, b)).cast("long"), lambda s: 100 * s >= percent * (F.size(a) + F.size(b) - s))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the sets that a task has read fall in each cell of the table of frequencies."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        total += np.bincount(_cells(batch.column(0).flatten().to_numpy()), minlength=CELLS)
    seen = np.flatnonzero(total)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["cell", "c"])


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)


def _prefixes(shared, percent: int):
    """The rows of a point (id, n, s1, s2, component, shingles) for the shingles of its prefix that other sets may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists, row, found, place = batch.column("shingles"), [], [], []
            values, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own, n = values[x:y], int(y - x)
                counts = table[_cells(own)]
                at = np.lexsort((own, counts))[: n - -(-percent * n // 100) + 1]
                kept = np.flatnonzero(counts[at] > 1)  # in a cell of its own a shingle is alone
                row.append(np.full(len(kept), i))
                found.append(own[at[kept]])
                place.append(kept)
            if row:
                taken = batch.select(["id", "n", "s1", "s2", "component"]).take(pa.array(np.concatenate(row)))
                n, k = taken.column("n").to_numpy(), np.concatenate(place)
                short = k <= n - -(-2 * percent * n // (100 + percent))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(found), pa.int64()), pa.array(k, pa.int64()), pa.array(short)], [*taken.schema.names, "shingle", "place", "short"])

    return run


def _rare_shingles(pool: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The rows of ``pool`` (id, n, s1, s2, component) once per shingle of its prefix: shingle, place (from 0, rarest first) and short.

    Sets that are similar enough have their first common shingle, in any order that all sets keep, inside the prefix of both, and where ``short`` holds in the
    smaller one.  The order is by how many shingles share a cell of a table of ``CELLS`` counts, then by hash: the table is of fixed size, so that no shingle is joined to
    its count.
    """
    found = scratch.written(pool.join(sets, "id"), "pool")
    counts = found.select("shingles").mapInArrow(_frequencies, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()  # at most CELLS rows
    table = np.zeros(CELLS, np.int64)
    table[counts["cell"]] = counts["c"]
    shared = pool.sparkSession.sparkContext.broadcast(table)
    return found.mapInArrow(_prefixes(shared, percent), "id long, n long, s1 long, s2 long, component long, shingle long, place long, short boolean")


def _meetings(rare: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges from a point (id, ...) to a point of at least its size (c) that may be similar enough by the places of a shingle of both."""
    keys = rare.groupBy("shingle").agg(F.count("*").alias("m"), F.count_if("short").alias("shorts"), F.min("component").alias("x"), F.max("component").alias("y"))
    keys = keys.where("shorts > 0 and x <> y").select("shingle", "m", F.expr(f"(shorts - 1) div {block} + 1").alias("p"), F.expr(f"(m - 1) div {block} + 1").alias("q"))
    keyed = join_hot(rare, keys, ["shingle"], count="m", total=rare.count(), spread=["id"])
    own = lambda parts: F.pmod(F.xxhash64("id", "shingle"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    a = keyed.where("short").withColumn("i", own("p")).withColumn("j", every("q")).drop("p", "q", "short")
    b = keyed.withColumn("j", own("q")).withColumn("i", every("p")).select("shingle", "i", "j", F.struct("id", "n", "s1", "s2", "component", "place").alias("c"))
    rest = F.least(F.col("n") - F.col("place"), F.col("c.n") - F.col("c.place"))
    met = a.join(b, ["shingle", "i", "j"]).where("component <> c.component").where("n < c.n or n = c.n and id < c.id")
    return met.where((100 + percent) * rest >= percent * (F.col("n") + F.col("c.n")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links lead to, itself included) and kept (id = component_id).

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``shingle``-word
    sequences, over ASCII-lower-cased words ``[^\\x20\\x09-\\x0D]+``.  A text of fewer words is one shingle.
    A null or blank text has no shingle and no link.  A row with a null id has no link either: its component_id is
    null and it is kept.  Rows that repeat an id are one document, which links wherever one of its texts does.  Other columns are not read.
    Ids are whole numbers; an id that does not read as one raises CAST_INVALID_INPUT.
    ``crowded`` and ``block`` change the work, not the result.
    """
    scratch = Scratch(docs.sparkSession)  # what the result doesn't read
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = written(source.mapInArrow(_profile(shingle, bands, rows), "id long, n_shingles long, c1 long, c2 long, bands array<long>, s1 long, s2 long"), "profiles")

    linkable = profile.where("id is not null and n_shingles > 0")
    content = ["c1", "c2", "n_shingles"]
    # A point is a class of rows with equal sets, whose first id stands for it; it has a number of its own, as one id may stand for several.
    classes = linkable.groupBy(*content).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("point", F.monotonically_increasing_id()), "classes")
    n_rows = profile.count()
    member = written(join_hot(linkable.select("id", *content), classes.drop("first"), content, count="copies", total=n_rows, spread=["id"]).select("id", "point").distinct(), "members")
    one_row = [*content, "first"]
    firsts = linkable.withColumnRenamed("id", "first").join(classes, one_row).dropDuplicates(one_row)
    points = scratch.written(firsts.select(F.col("point").alias("id"), "n_shingles", "bands", "s1", "s2"), "points")
    texts_of = member.groupBy("id").agg(F.min("point").alias("u"), F.max("point").alias("w"), F.count("*").alias("n")).where("u < w").drop("w")
    same = scratch.written(join_hot(member, texts_of, ["id"], count="n", total=n_rows, spread=["point"]).where("u <> point").select("u", F.col("point").alias("v")), "same")

    met = points.select("id", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("others")).where("least < most").select("bucket", "others", F.col("others").alias("m"))
    met = scratch.written(join_hot(met, shared, ["bucket"], count="m", total=bands * points.count(), spread=["id"]), "buckets")
    facts = points.select("id", F.col("n_shingles").alias("n"), "s1", "s2").join(met.groupBy("id").agg(F.sum("others").alias("weight")), "id")
    met = scratch.written(met.select("bucket", "id").join(facts, "id"), "points")
    used = classes.join(facts.select(F.col("id").alias("point")), "point").select("first", *content, "point")
    found = source.join(used.select(F.col("first").alias("id")).distinct(), "id", "left_semi").mapInArrow(_sets(shingle), "first long, n_shingles long, c1 long, c2 long, shingles array<long>")
    sets = scratch.written(found.join(used, one_row).dropDuplicates(one_row).select(F.col("point").alias("id"), "shingles"), "sets")

    def components(*tests: DataFrame) -> DataFrame:
        links = same
        for tested in tests:
            links = links.union(tested.where("linked").select("u", "v"))
        return connected_components(links)

    def near(edges: DataFrame) -> DataFrame:
        """(u, v) of the edges from points to centres that sizes and sketches don't rule out."""
        a, b = F.col("n"), F.col("c.n")
        edges = edges.where(F.col("id") != F.col("c.id")).where(100 * F.least(a, b) >= percent * F.greatest(a, b))
        differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("c.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("c.s2")))
        return edges.where((F.least(a, b) < SKETCHED) | (differ <= SKETCH_BITS)).select(F.least("id", "c.id").alias("u"), F.greatest("id", "c.id").alias("v")).distinct()

    def confirmed(edges: DataFrame) -> DataFrame:
        full = edges.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v")), "v")
        return scratch.written(full.select("u", "v", _similar(F.col("set_u"), F.col("set_v"), percent).alias("linked")), "candidates")

    def still_open(placed: DataFrame, component: DataFrame) -> DataFrame:
        """The rows of buckets whose points are not all connected, with their component and the bucket's number of rows."""
        placed = placed.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        parted = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket", "m", F.col("m").alias("rows"))
        return scratch.written(join_hot(placed, parted, ["bucket"], count="rows", total=n_met, spread=["id"]), "open")

    def star(placed: DataFrame, *centres: Column) -> DataFrame:
        """Candidates of every bucket round each of its centres."""
        named = [f"c{i}" for i in range(len(centres))]
        first = placed.groupBy("bucket").agg(*[c.alias(n) for c, n in zip(centres, named, strict=True)], F.count("*").alias("rows"))
        each = join_hot(placed, first, ["bucket"], count="rows", total=n_met, spread=["id"]).withColumn("c", F.explode(F.array(*named)))
        return near(each.where("component <> c.component")).distinct()

    n_met = met.count()
    point = F.struct("id", "n", "s1", "s2", "component")
    alone = met.withColumn("component", F.col("id"))
    tested = confirmed(star(alone, F.min(point), F.max(F.struct("weight", point.alias("p")))["p"]))
    component = components(tested)
    placed = still_open(met.drop("weight"), component)
    tried = confirmed(star(placed, F.max(F.struct(F.xxhash64("id", "bucket").alias("o"), point.alias("p")))["p"]).join(tested, ["u", "v"], "left_anti"))
    tested = tested.union(tried)
    if not tried.where("linked").isEmpty():
        component = components(tested)
        placed = still_open(placed.drop("component", "m"), component)

    few = placed.where(F.col("m") <= crowded)
    pairs = few.join(few.select("bucket", point.alias("c")), "bucket").where("component <> c.component and id < c.id")
    pool = placed.where(F.col("m") > crowded).select("id", "n", "s1", "s2", "component").distinct()
    edges = near(pairs)
    if not pool.isEmpty():
        rare = scratch.written(_rare_shingles(pool, sets, percent, scratch), "rare")
        edges = edges.union(near(_meetings(rare, percent, block))).distinct()
    tried = confirmed(edges.join(tested, ["u", "v"], "left_anti"))
    if not tried.where("linked").isEmpty():
        component = components(tested, tried)
    scratch.drop()

    placed = classes.join(component, F.col("point") == F.col("node"), "left").select("point", "first", "copies", F.coalesce("component", "point").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    of_points = join_hot(placed, least, ["component"], count="m", total=n_rows, spread=["point"]).select("point", "copies", "component_id")
    of_ids = join_hot(member, of_points, ["point"], count="copies", total=n_rows, spread=["id"]).groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = profile.select("id", "n_shingles").join(of_ids, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
