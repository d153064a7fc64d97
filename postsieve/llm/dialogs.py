"""Repair of conversations by an auction algorithm for shortest paths.

A conversation should read ``(system?(user assistant)+)?`` by the first letters of its roles.  Rows may be kept (0, and
3 for one that ends in mid-sentence), given the role user or assistant (3 more) or deleted (4; blank rows and repeats must be), and
empty turns of user or assistant may be inserted anywhere (3).  Rows in order and the four states
(nothing yet, behind a system, user or assistant row) span a lattice, whose arcs are these edits.

The auction keeps a price for every node, never above an arc's cost plus the price of its head, and a path.  At the path's
end the price rises to the least cost plus price of its arcs; if that changes it, the path contracts by
a node, else it extends along the best arc.  Origins are taken from the last row back, and a path that meets a node with a converged
price ends there and makes its own nodes converge, so that work grows with the number of rows.  Of
converged prices the tight arcs, whose cost is the difference of the prices, are those of cheapest repairs, and the
least letters along them give the one that comes first among the equals.

Texts stay out of this: a task takes rows of one conversation in order, as a letter, two flags and a digest each.  The
edits then go over the rows as a stream, a text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import BLANKS
from .store import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Letters of the states; the first has no row yet.
STATES = ("", "s", "u", "a")
#: For each state the letters that may follow it, with the state behind them, and those that an edit can make.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = ((2,), (2,), (3,), (2,))
ENDS = (0, 3)
LEGAL = frozenset(["su", "ua", "au"])
ROLES = {"u": "user", "a": "assistant"}
_FACTS = "n_rows long, min_turn long, max_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def arcs(letter: str, dead: bool, truncated: bool, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, next state) of a row with that first letter of its role; ``dead`` rows can only be deleted."""
    out = [(DELETE, DELETE_COST, 1, state)]
    if not dead:
        late = TRUNCATED_COST if truncated else 0
        if letter in FOLLOW[state]:
            out.append((KEEP, late, 1, FOLLOW[state][letter]))
        out += [(REROLE, REROLE_COST + late, 1, to) for to in MADE[state]]
    return out + [(INSERT, INSERT_COST, 0, to) for to in MADE[state]]


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of rows (letter, dead, truncated), the least edits of those of equal cost."""
    n = len(rows)
    price, converged = [[0] * 4 for _ in range(n + 1)], [[False] * 4 for _ in range(n + 1)]

    def heads(at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, row, state) of a node's arcs; the one without an edit leads to the end, whose price is 0."""
        if at < n:
            return [(edit, cost, at + taken, to) for edit, cost, taken, to in arcs(*rows[at], state)]
        end = [("", 0, n, -1)] if state in ENDS else []
        return end + [(INSERT, INSERT_COST, n, to) for to in MADE[state]]

    def bid(arc: tuple[str, int, int, int]) -> int:
        return arc[1] + (price[arc[2]][arc[3]] if arc[3] >= 0 else 0)

    for origin in range(n, -1, -1):
        for state in range(4):
            path = [] if converged[origin][state] else [(origin, state)]
            while path:
                at, own = path[-1]
                best = min(heads(at, own), key=bid)
                if price[at][own] < bid(best):
                    price[at][own] = bid(best)
                    if len(path) > 1:
                        path.pop()
                elif best[3] < 0 or converged[best[2]][best[3]]:
                    for i, j in path:
                        converged[i][j] = True
                    path = []
                else:
                    path.append((best[2], best[3]))
    edits, at, state = [], 0, 0
    while state >= 0:
        edit, _, at, state = min(arc for arc in heads(at, state) if bid(arc) == price[at][state])
        edits.append(edit)
    return price[0][0], "".join(edits)


class Conversation:
    """What is gathered of one conversation's rows."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, bool, bool]] = []
        self.seen: set[bytes] = set()
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, letter: str, blank: bool, open_end: bool, digest: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        duplicate = not blank and digest in self.seen
        truncated = not blank and not duplicate and open_end
        self.seen.add(digest)
        if self.rows:
            self.illegal += self.rows[-1][0] + letter not in LEGAL
        self.rows.append((letter, blank or duplicate, truncated))
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated

    def facts(self) -> tuple:
        return (len(self.rows), self.least, self.most, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(self.rows))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, turn, letter, blank, open_end, digest), a conversation's together and in order, to a row of facts each."""
    names = [part.split()[0] for part in _FACTS.split(", ")]
    types = [pa.int64()] * (len(names) - 1) + [pa.string()]
    held: tuple | None = None  # the id of the conversation at hand, as an array of one, and what is gathered of it
    for batch in batches:
        ids, done = batch.column(0), []
        values = ids.to_pylist()
        for i, row in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 6)), strict=True)):
            if held is None or held[1] != values[i]:
                done += [held] if held else []
                held = (ids.slice(i, 1), values[i], Conversation())
            held[2].add(*row)
        if done:
            yield _facts_batch(done, names, types)
    if held:
        yield _facts_batch([held], names, types)


def _facts_batch(done: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*(c.facts() for _, _, c in done), strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([i for i, _, _ in done]), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", *names])


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("id").sortWithinPartitions("id", *order)


def _prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    # The length tells where the role ends.
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def audit(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, n_rows, min_turn, max_turn, n_turns, blank, duplicate, truncated, illegal, cost and audit.

    Rows stand by turn, nulls first, and rows of one turn by the MD5 of role and text.  A row's first fault counts: blank (no character but
    ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (its last such character is none of ``.!?``).
    ``illegal`` counts neighbours whose first letters of roles are none of su, ua, au.  ``cost`` and ``audit`` are those of the cheapest
    edits, of equal ones the first in ASCII order.  A null role or text is one space; an empty role has no letter and is never kept
    as it is.  Rows with a null id are one conversation.  Other columns are not read.
    """
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col)
    trimmed = F.btrim("text", F.lit(BLANKS))
    facts = rows.select("id", "turn", F.substring("role", 1, 1).alias("letter"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open_end"), "digest")
    id_type = turns.schema[conv_col].dataType.simpleString()
    found = _in_order(facts, "turn", "digest").mapInArrow(_audit, f"id {id_type}, {_FACTS}")
    return found.withColumnRenamed("id", conv_col)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, audit, role, text), a conversation's together, its audit first and then its rows in order, to repaired rows."""
    edits, at, last, place = "", 0, "", 0
    for batch in batches:
        source, places, changes, roles, texts = [], [], [], [], []

        def put(i: int, edit: str, role: str, text: str) -> None:
            nonlocal last, place
            for values, value in zip((source, places, changes, roles, texts), (i, place, edit, role, text), strict=True):
                values.append(value)
            last, place = role[:1], place + 1

        def made() -> str:
            return ROLES["a" if last == "u" else "u"]

        def inserted(i: int) -> None:
            nonlocal at
            while edits[at : at + 1] == INSERT:
                put(i, INSERT, made(), "")
                at += 1

        for i, (audit_, role, text) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
            if audit_ is not None:
                edits, at, last, place = audit_, 0, "", 0
                inserted(i)
                continue
            edit, at = edits[at], at + 1
            if edit != DELETE:
                put(i, edit, made() if edit == REROLE else role, text)
            inserted(i)
        if source:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), pa.array(places, pa.int64()), pa.array(changes), pa.array(roles), pa.array(texts)], ["id", "place", "edit", "role", "text"])


def repair(turns: DataFrame, audits: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows: id, place (from 0), edit (K, R or I), role and text, by the ``audit`` of the same rows.

    A conversation's rows lie in one partition, together and in order; no more than a batch of them is held.
    """
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col)
    rows = rows.select("id", F.lit(1).alias("kind"), "turn", "digest", F.lit(None).cast("string").alias("audit"), "role", "text")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    heads = audits.select(F.col(conv_col).alias("id"), F.lit(0).alias("kind"), none("turn", "long"), none("digest", "binary"), "audit", none("role", "string"), none("text", "string"))
    id_type = turns.schema[conv_col].dataType.simpleString()
    ordered = _in_order(heads.unionByName(rows), "kind", "turn", "digest").select("id", "audit", "role", "text")
    return ordered.mapInArrow(_apply, f"id {id_type}, place long, edit string, role string, text string").withColumnRenamed("id", conv_col)


def repair_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``audit``, ``repair``) of ``turns``; the first is written as a table, as the second reads it too."""
    columns = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    audits = written(audit(turns, **columns), "audits")
    return audits, repair(turns, audits, **columns)
