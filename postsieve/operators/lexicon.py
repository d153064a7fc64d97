"""One pass over a text for all patterns of a lexicon.

Most keys of a lexicon don't occur in most texts.  From every branch of a key's pattern a literal is taken that each of its
matches holds.  All literals together are one pattern in the shape of a trie, which is tried at every place of the text without
moving past a match, so that a single scan tells which literals occur, however they overlap.  Only keys with such a literal
are then looked for by their own patterns, and those whose branches are literals throughout not even that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a literal, at least; keys with a branch that has no such literal are looked for in every text.
LEAST_LITERAL = 2
_TOKEN = re.compile(r"\\[pP]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{\d+(?:,\d*)?\}|.", re.S)
#: Escapes that stand for no text, and those that stand for a class of characters.
_EDGES, _CLASSES = frozenset(r"\b \B \A \z \Z".split()), frozenset(r"\d \D \s \S \w \W \h \H \v \V \R".split())


def _branches(pattern: str) -> list[list[str]] | None:
    """The top-level alternatives of a pattern, each as its pieces: plain characters, and ``""`` for all else; None if it has escapes or flags that aren't known here."""
    out: list[list[str]] = [[]]
    depth = 0
    for found in _TOKEN.finditer(pattern):
        token = found[0]
        kind = token[:2]
        if kind[0] == "\\" and kind not in _EDGES | _CLASSES and kind not in (r"\p", r"\P") and kind[1:].isalnum() or re.match(r"\(\?[a-zA-Z-]", pattern[found.start() :]):
            return None
        if token in ("(", ")"):
            depth += 1 if token == "(" else -1
            out[-1].append("")
        elif depth:
            continue
        elif token == "|":
            out.append([])
        elif token in ("*", "?") or kind[0] == "{" and len(token) > 1:
            out[-1][-1:] = [""]  # the piece before may be missing
        elif token == "+" or token in (".", "^", "$") or len(token) > 2 or kind in _EDGES | _CLASSES:
            out[-1].append("")
        else:
            out[-1].append(token[-1])
    return out


def required_literals(pattern: str) -> tuple[list[str], bool] | None:
    """Literals of which every match of the pattern holds one, and whether any of them in a text makes a match; None if some branch has none.

    The literal of a branch is its longest run of plain characters.
    """
    branches = _branches(pattern)
    if branches is None:
        return None
    longest = [max("".join(p or "\0" for p in pieces).split("\0"), key=len) for pieces in branches]
    if min(map(len, longest)) < LEAST_LITERAL:
        return None
    return longest, all(all(pieces) for pieces in branches)


#: Branches that a pattern may be spread into.
MOST_BRANCHES = 16
_CLASS = re.compile(r"\[([^\]\\^&\[-][^\]\\&\[-]*|-[^\]\\&\[-]*)\]")


def spread(pattern: str) -> str:
    """A pattern that occurs in the same texts, with longer literals: short classes of plain characters become branches, and a letter that may be missing at a branch's end is left out."""
    if _branches(pattern) is None or "(" in pattern or any(q in pattern for q in ("??", "?+", r"\|", r"\?", r"\[")):
        return pattern
    out = []
    for branch in re.split(r"\|(?![^\[]*\])", pattern):
        found, rest = [""], re.sub(r"(?<=[\w\]])(?<!\\\w)\w\?$", "", branch)
        while rest:
            inner = _CLASS.match(rest)
            if inner and not re.match(r"[?*+{]", rest[inner.end() :]):
                found = [x + ("\\" + ch if not ch.isalnum() and ch not in " -" else ch) for x in found for ch in dict.fromkeys(inner[1])]
            else:
                inner = re.compile(_TOKEN).match(rest)
                found = [x + inner[0] for x in found]
            rest = rest[inner.end() :]
        out += found
    return "|".join(out) if len(out) <= MOST_BRANCHES else pattern


def trie_pattern(literals: Iterable[str]) -> str:
    """A pattern that matches the longest of the literals that begins at a place."""
    trie: dict = {}
    for literal in literals:
        node = trie
        for ch in literal:
            node = node.setdefault(ch, {})
        node[""] = {}

    def shown(node: dict) -> str:
        text = ""
        while len(node) == 1 and "" not in node:
            ((ch, node),) = node.items()
            text += re.escape(ch) if ch.isascii() else ch
        rest = [(re.escape(ch) if ch.isascii() else ch) + shown(below) for ch, below in sorted(node.items()) if ch]
        return text + (f"(?:{'|'.join(rest)}){'?' if '' in node else ''}" if rest else "")

    return shown(trie)


class Lexicon:
    """Keys and their patterns over lower-case text, ready to be looked for."""

    def __init__(self, patterns: Mapping[str, str]):
        self.patterns = dict(patterns)
        literals = {k: required_literals(spread(p)) for k, p in self.patterns.items()}
        self.always = {k for k, found in literals.items() if found is None}
        self.exact = {k for k, found in literals.items() if found and found[1]}
        every = sorted({x for found in literals.values() if found for x in found[0]})
        self.trie = f"(?=({trie_pattern(every)}))" if every else None
        # A literal says that those which begin it occur, too.
        self.keys_of = {x: [k for k, found in literals.items() if found and any(x.startswith(y) for y in found[0])] for x in every}

    def _candidates(self, lowered: Column) -> Column:
        """Keys that may occur in a text, those that are always looked for apart."""
        if not self.trie:
            return F.expr("cast(array() as array<string>)")
        seen = F.array_distinct(F.regexp_extract_all(lowered, F.lit(self.trie), 1))
        keys_of = F.create_map(*[x for literal, keys in self.keys_of.items() for x in (F.lit(literal), F.array(*map(F.lit, keys)))])
        return F.array_distinct(F.flatten(F.transform(seen, lambda x: keys_of[x])))

    def over(self, lowered: Column, value: Callable[[Column, Callable[[str], Column]], Column]) -> Column:
        """``value`` of the text and of ``maybe``, which tells whether a key may occur in it; both are computed once for the row."""
        state = F.struct(lowered.alias("t"), self._candidates(lowered).alias("c"))
        return F.transform(F.array(state), lambda s: value(s["t"], lambda key: F.lit(True) if key in self.always else F.array_contains(s["c"], key)))[0]

    def present(self, lowered: Column) -> Column:
        """The keys that occur, in the lexicon's order."""

        def value(t: Column, maybe: Callable[[str], Column]) -> Column:
            hit = lambda k, p: maybe(k) if k in self.exact else F.when(maybe(k), t.rlike(p)).otherwise(False)
            return F.array_compact(F.array(*[F.when(hit(k, p), F.lit(k)) for k, p in self.patterns.items()]))

        return self.over(lowered, value)

    def counted(self, lowered: Column) -> Column:
        """Map of the keys that occur to their numbers of matches."""

        def value(t: Column, maybe: Callable[[str], Column]) -> Column:
            one = lambda k, p: F.struct(F.lit(k).alias("k"), F.when(maybe(k), F.regexp_count(t, F.lit(p))).otherwise(0).alias("n"))
            return F.map_from_entries(F.filter(F.array(*[one(k, p) for k, p in self.patterns.items()]), lambda e: e["n"] > 0))

        return self.over(lowered, value)
