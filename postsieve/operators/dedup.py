"""One row per key, known rows, and set operations by key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.text import fingerprint, norm_title


def is_fresh(as_of: datetime, hours: int, trusted: Sequence[str], posted: str = "posted_at", source: str = "source") -> Column:
    """Posted within ``hours`` of ``as_of``, or undated from a source that lists new rows only."""
    cutoff = F.lit(as_of) - F.make_interval(hours=F.lit(hours))
    return F.when(F.col(posted).isNotNull(), F.col(posted) >= cutoff).otherwise(F.coalesce(F.col(source).isin(*trusted) if trusted else F.lit(False), F.lit(False)))


def split_fresh(df: DataFrame, as_of: datetime, hours: int, trusted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(fresh rows, stale rows); nothing is lost."""
    marked = df.withColumn("__fresh", is_fresh(as_of, hours, trusted))
    return marked.where("__fresh").drop("__fresh"), marked.where("not __fresh").drop("__fresh")


def _best(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first by ``order``, largest values first, nulls last.

    Spark keeps one row a key and task before the shuffle (a window group limit), so a frequent key is no heavy one, and columns that nobody asks for later are never read.
    """
    window = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def dedup_prefer_fresh(df: DataFrame, as_of: datetime, hours: int, trusted: Sequence[str]) -> DataFrame:
    """One row per fingerprint: fresh before stale, dated before undated, later before earlier, the latest arrival last of all."""
    posted = F.col("posted_at")
    return _best(df, [fingerprint(F.col("company"), F.col("title"))], [is_fresh(as_of, hours, trusted), posted.isNotNull(), F.coalesce(posted, F.lit(datetime(1, 1, 1))), F.col("seq")])


def dedup_best_confidence(df: DataFrame) -> DataFrame:
    """One row per fingerprint: the highest confidence, null as 0, then the first to arrive."""
    return _best(df, [fingerprint(F.col("company"), F.col("title"))], [F.coalesce("confidence", F.lit(0)), -F.col("seq")])


#: How telling an outcome is; those not listed are the least.
OUTCOME_RANK = {"offer": 6, "interview": 5, "phone_screen": 4, "reached_out": 3, "rejected": 2, "no_response": 1}


def outcome_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in OUTCOME_RANK.items() for x in pair])[c], F.lit(0))


def dedup_outcomes(feedback: DataFrame) -> DataFrame:
    """One row per company and normalised title: the most telling outcome, then the first id."""
    return _best(feedback, [F.lower("company"), norm_title(F.col("title"))], [outcome_rank(F.col("outcome")), -F.col("id")])


def merge_newer_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return _best(both, [key], [F.col("__v")]).drop("__v")


def known_keys(jobs: DataFrame, audit: DataFrame, feedback: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Fingerprints stored or audited within ``days``, or ever applied to."""
    since = F.lit(as_of) - F.make_interval(days=F.lit(days))
    recent = [t.where(F.col("created_at") >= since).select("job_fingerprint") for t in (jobs, audit)]
    return recent[0].union(recent[1]).union(feedback.select("job_fingerprint")).distinct()


#: Bits of a key filter for each key that it holds, and bits of the largest, 64 MB; fuller ones only let more rows through.
BITS_PER_KEY, MOST_BITS = 16, 1 << 29
#: Places of a key in the filter.
PROBES = 2
_BITMAP_BITS = 32_768  # of Spark's bitmaps


class KeyFilter:
    """Which keys a table surely lacks: a bitmap of hashes, built by ``bitmap_construct_agg`` in parts that tasks merge, and broadcast.

    Two of ``BITS_PER_KEY`` bits a key are set, so that about 1.4 % of strange keys look known; at ``MOST_BITS`` and n keys it is (1 - exp(-2 n / MOST_BITS))**2.
    """

    def __init__(self, table: DataFrame, key: str, n_keys: int | None = None):
        n_keys = table.select(F.approx_count_distinct(key)).first()[0] if n_keys is None else n_keys
        bits = BITS_PER_KEY * max(n_keys, 1)
        self.bits = min(MOST_BITS, -(-bits // _BITMAP_BITS) * _BITMAP_BITS)
        places = table.where(F.col(key).isNotNull()).select(F.explode(F.array(*self._places(F.col(key)))).alias("at"))
        self.parts = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))  # bits / _BITMAP_BITS rows of 4 KB

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.bits)) + 1 for i in range(PROBES)]

    def marked(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a column that is false where the table surely lacks the key; a null key is lacking."""
        seen = F.lit(True)
        columns = df.columns
        for i, place in enumerate(self._places(key)):
            bit = F.bitmap_bit_position(place)
            byte = F.conv(F.hex(F.substring(f"__m{i}", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            parts = self.parts.select(F.col("bucket").alias(f"__b{i}"), F.col("bitmap").alias(f"__m{i}"))
            df = df.join(F.broadcast(parts), F.bitmap_bucket_number(place) == F.col(f"__b{i}"), "left")
            seen = seen & F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))
        return df.select(*columns, (seen & key.isNotNull()).alias(name))


def anti_join_known(df: DataFrame, key: Column, known: DataFrame, known_key: str, use: KeyFilter | None = None) -> DataFrame:
    """``df`` without the rows whose key ``known`` holds.

    Rows whose key the filter rules out are passed on where they are read; only the others, the known ones and about one in 70, are shuffled and
    joined.  The source is read once for each of the two.
    """
    use = use or KeyFilter(known, known_key)
    marked = use.marked(df, key, "__maybe")
    columns = df.columns
    fresh = marked.where("not __maybe").select(columns)
    rest = marked.where("__maybe").withColumn("__key", key).join(known.select(F.col(known_key).alias("__key")), "__key", "left_anti").select(columns)
    return fresh.union(rest)


def drop_known(df: DataFrame, known: DataFrame, use: KeyFilter | None = None) -> DataFrame:
    return anti_join_known(df, fingerprint(F.col("company"), F.col("title")), known, "job_fingerprint", use)


def known_subset(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return keys.join(df.select(key), key, "left_semi")


def except_by_key(df: DataFrame, gone: DataFrame, key: str, use: KeyFilter | None = None) -> DataFrame:
    return anti_join_known(df, F.col(key), gone, key, use)


def best_board(hits: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Boards (kind, name, token, total, relevant) that are the largest of their name or of their token, once per token, the most relevant first.

    Tokens of ``registered`` (kind, token) are left out, whatever the case.
    """
    by_name = _best(hits, ["kind", F.lower("name")], [F.col("total"), -F.col("seq")])
    by_token = _best(hits, ["kind", F.lower("token")], [F.col("total"), -F.col("seq")])
    found = _best(by_name.union(by_token).distinct(), ["kind", F.lower("token")], [F.col("relevant"), F.col("total"), -F.col("seq")])
    if registered is None:
        return found
    known = registered.select(F.col("kind").alias("__k"), F.lower("token").alias("__t"))
    return found.join(known, (F.col("kind") == F.col("__k")) & (F.lower("token") == F.col("__t")), "left_anti")


def row_number_by(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
