"""Column expressions that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters between words, as for ``translate`` and ``btrim``: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, [] for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def beside_text(docs: DataFrame, keep: Sequence[str], text_col: str, outputs: Collection[str]) -> DataFrame:
    """The columns ``keep``, renamed c0, c1, ..., and the text, last, so that no name can clash on the way.

    Raises ValueError where a kept column has the name of an output, as neither could be told from the other.
    """
    clash = {c.lower() for c in keep} & {c.lower() for c in outputs}
    if clash:
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].cast("string")).toDF(*(f"c{i}" for i in range(len(keep) + 1)))
