"""Periodic runs of words by recursive frequency splitting.

A run is a longest stretch of consecutive words in which words ``q`` apart are equal, ``q`` being
the least such number, and which has at least ``least`` words and ``repeats`` periods.  Every word of
it occurs ``repeats`` times in it.  So a word that is rarer than that within a segment lies in no run of the
segment, and splits it there; the pieces are split again by their own counts until all words of a segment are frequent
enough.  A piece's counts are taken afresh, but the largest piece of a split keeps its segment's,
less those of the rest, so that a text of n words costs O(n log² n) however it falls apart.

The segments that are left are scanned lag by lag.  A run of period q holds at least
``repeats - 1`` multiples of q whose word is that q further on, so only those places are compared,
m / q of a segment of m words; where enough of them agree in a row, the stretch around them is measured.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run and periods in it, at least.
LEAST, REPEATS = 6, 4
#: Words whose agreement is looked at before a stretch is measured.
PROBE = 16
#: Runs before a place that are tried first as the stretch around it; others are found by measuring.
NEAR = 8
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Whole numbers that are equal where words are."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def segments(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """The (start, end) of the segments in which every word occurs at least ``repeats`` times, by start."""
    found, open_ = [], [(0, len(ids))]
    while open_:
        base, end = open_.pop()
        if end - base < least:
            continue
        _, own, counts = np.unique(ids[base:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[own] < repeats)
        if not len(rare):
            found.append((base, end))
            continue
        places, firsts = np.argsort(own, kind="stable"), np.concatenate([[0], np.cumsum(counts)])
        a, b = 0, end - base
        while len(rare):
            edges = np.concatenate([[a - 1], rare, [b]])
            sizes = np.diff(edges) - 1
            largest = int(sizes.argmax())
            open_ += [(base + int(edges[i]) + 1, base + int(edges[i + 1])) for i in np.flatnonzero(sizes >= least) if i != largest]
            x, y = int(edges[largest]) + 1, int(edges[largest + 1])
            gone = np.concatenate([own[a:x], own[y:b]])
            np.subtract.at(counts, gone, 1)
            a, b = x, y
            if b - a < least:
                break
            scarce = np.unique(gone)
            scarce = scarce[(counts[scarce] > 0) & (counts[scarce] < repeats)]
            inside = [p[np.searchsorted(p, a) : np.searchsorted(p, b)] for p in (places[firsts[w] : firsts[w + 1]] for w in scarce)]
            rare = np.sort(np.concatenate(inside)) if inside else scarce
        else:
            found.append((base + a, base + b))
    return sorted(found)


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first pairs agree, in blocks that double."""
    at, step, n = 0, PROBE, len(x)
    while at < n:
        differ = np.flatnonzero(x[at : at + step] != y[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def lag_scan(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n, runs, seen = len(ids), [], set()
    for q in range(1, n // repeats + 1):
        places = np.arange(0, n - q, q)
        same = ids[: n - q : q] == ids[q::q]
        alike = same[: len(same) - (repeats - 2)].copy()
        for k in range(1, repeats - 1):
            alike &= same[k : len(same) - (repeats - 2) + k]
        at = places[: len(alike)][alike]
        for k in range(1, min(q, PROBE)):  # the words behind them, too
            at = at[ids[at + k] == ids[at + k + q]] if len(at) else at
        done, i = -1, 0
        while i < len(at):
            p = int(at[i])
            i += 1
            if p < done:
                continue
            # A run seen at a lesser lag that divides q and covers two periods here is the stretch itself.
            near = bisect_right(runs, (p, n, n))
            covered = [s + m for s, m, r in runs[max(0, near - NEAR) : near] if q % r == 0 and s + m >= p + 2 * q]
            if covered:
                done = max(covered) - q
                i = int(np.searchsorted(at, done))
                continue
            right = p + _reach(ids[p : n - q], ids[p + q :])
            left = p - _reach(ids[:p][::-1], ids[q : p + q][::-1])
            done, length = right, right + q - left
            if length >= max(least, repeats * q) and (left, length) not in seen:  # seen there, it has a lesser period
                seen.add((left, length))
                insort(runs, (left, length, q))
        if runs and runs[0][:2] == (0, n):  # by then no greater lag is a least period in here
            break
    return runs


def runs_of(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    return sorted((s + a, m, q) for a, b in segments(ids, least, repeats) for s, m, q in lag_scan(ids[a:b], least, repeats))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, with one space between them."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, m, q in runs:
        keep[s + q : s + m] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _find(least: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: one text's words are the most that a task holds
                words = (batch.column(1)[i].as_py() or "").encode().split()
                runs = runs_of(word_ids(words), least, repeats)
                found = [{"start": s, "length": m, "period": q} for s, m, q in runs]
                text = collapsed(words, runs).decode()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(words)], pa.int64()), pa.array([found], _RUNS), pa.array([text], pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length and period in words, by start and then period) and collapsed, the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or blank text has no word, no run and an empty ``collapsed``.  Rows that repeat an id, and rows
    with a null one, are found each on its own; other columns are not read.  ``repeats`` is at least 3.
    """
    if repeats < 3 or least < repeats:
        raise ValueError("repeats must be at least 3, and least at least repeats")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_find(least, repeats), f"id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
