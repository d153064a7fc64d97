"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton finds every piece that ends at each character.  A dynamic
programme over the characters carries the best score and its number of pieces.  The
tie rules are those of the ``tokenizers`` library's Unigram model: of equal scores the
piece that begins first stays; a character that is no piece itself may be unknown, at
the lowest score less 10, and then counts as its UTF-8 bytes (byte fallback).

As in that library's ``Metaspace`` step a space is U+2581, and one is put in front of a
text that has none.  No piece holds U+2581 behind another character, so the best path
of a text is made of the best paths of the chunks before each run of them, and equal
chunks are counted once; the same goes for line ends if no piece holds them.  Scores
that are whole numbers, such as ranks, add up exactly in any order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from . import workers
from .columns import beside_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks whose counts a counter keeps.
CACHE_CHUNKS = 600_000

_counters: dict[str, Counter] = {}
workers.keep("tokencount", _counters.clear)


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        pieces = dict(vocabulary)
        if any(f"<0x{b:02X}>" not in pieces for b in range(256)):
            raise ValueError("the vocabulary needs a piece for each byte")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        self.by_chunk = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.by_line = self.by_chunk and not any("\n" in p for p in pieces)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.run = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def best(self, chunk: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        n = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(chunk):
            ends[end + 1].append(match)
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best = None
            for length, score in sorted(ends[end], reverse=True):  # the piece that begins first comes first
                score += scores[end - length]
                if best is None or score > best:
                    best, counts[end] = score, counts[end - length] + 1
            if chunk[end - 1] not in self.single:
                score = scores[end - 1] + self.unknown
                if best is None or score > best:
                    best, counts[end] = score, counts[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))
            scores[end] = best
        return scores[n], counts[n]

    def _sum(self, chunks: list[str], cache: dict[str, int], lead: str) -> int:
        found = list(map(cache.get, chunks))
        for at in [i for i, n in enumerate(found) if n is None]:
            n = cache.get(chunks[at])
            if n is None:
                n = self.best(lead + chunks[at])[1]
                if len(cache) < CACHE_CHUNKS:
                    cache[chunks[at]] = n
            found[at] = n
        return sum(found)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if not text.startswith(SPACE):
            text = SPACE + text
        if not self.by_chunk:
            return self.best(text)[1]
        lines = text.split("\n") if self.by_line else [text]
        total = (len(lines) - 1) * (self._sum(["\n"], self.first, "") if len(lines) > 1 else 0)
        firsts, laters = [], []
        for line in lines:
            if SPACE + SPACE in line or line.endswith(SPACE):
                firsts += self.run.findall(line)
            else:
                head, *rest = line.split(SPACE)
                if head:
                    firsts.append(head)
                laters += rest
        return total + self._sum(firsts, self.first, "") + self._sum(laters, self.later, SPACE)


def counter(path: str) -> Counter:
    workers.begin("tokencount")
    if path not in _counters:
        _counters[path] = Counter(sentencepiece_vocabulary(path))
    return _counters[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            *kept, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array([own.count(t.as_py() or "") for t in texts], pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row (all but the text if None) and n_tokens of its whole text under the model file ``vocabulary``.

    A null or empty text has 0 tokens.  A kept column can't be named n_tokens.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    given = beside_text(docs, keep, text_col, ["n_tokens"])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "n_tokens long"])
    return given.mapInArrow(_counts(vocabulary), schema).toDF(*keep, "n_tokens")
