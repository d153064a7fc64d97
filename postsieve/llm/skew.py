"""Joins whose many side may hold one key in a third of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may lie in one task: a share of all rows, so that fewer than ``SHARES`` keys are ever dealt out, but at least ``FEW``.
SHARES, FEW = 5_000, 500


def hot_parts(counted: DataFrame, keys: Sequence[str], *, count: str, total: int) -> DataFrame:
    """The keys, of a table with one row a key, that have more than a share of ``total`` rows in ``count``, and the number of parts they are dealt out to; fewer than ``SHARES`` rows."""
    limit = max(FEW, total // SHARES)
    return counted.where(F.col(count) > limit).select(*keys, F.expr(f"({count} - 1) div {limit} + 1").alias("__parts"))


def dealt_join(many: DataFrame, one: DataFrame, keys: Sequence[str], parts: DataFrame, *, spread: Sequence[str | Column]) -> DataFrame:
    """``many`` inner joined to ``one``, with the rows of the keys in ``parts`` (see ``hot_parts``, broadcast) dealt out.

    A key's rows of ``one`` are repeated for each of its parts, and a row of ``many`` goes to the part that the hash of ``spread`` names.
    """
    parts = F.broadcast(parts)
    of = F.coalesce("__parts", F.lit(1).cast("long"))
    dealt = many.join(parts, list(keys), "left").withColumn("__part", F.pmod(F.xxhash64(*spread), of)).drop("__parts")
    copies = one.join(parts, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), of - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


def join_hot(many: DataFrame, one: DataFrame, keys: Sequence[str], *, count: str, total: int, spread: Sequence[str | Column]) -> DataFrame:
    """``many`` inner joined to its row of ``one`` (one row a key), with a frequent key's rows dealt out to several tasks.

    ``count`` is a column of ``one``, not null, with the rows that its key has in ``many``, which come to ``total`` in all.  Keys of more than a share of those are
    frequent; their list, of fewer than ``SHARES`` rows, is broadcast.
    """
    return dealt_join(many, one.drop(count), keys, hot_parts(one, keys, count=count, total=total), spread=spread)
