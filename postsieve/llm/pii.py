"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers; those
spans always stay.  The field adds what the patterns miss: a number that stands once with its
country code and elsewhere without, a card with dots between its groups, an address with blanks round its ``@``.

Nodes are the patterns' spans, words with an ``@``, and runs of at least ``MIN_DIGITS`` digits with blanks, brackets,
dots, hyphens or slashes between them, of one word or several.  A node's
own potential comes from its shape, from how many digits it has and which kinds' checks it passes, and from the words beside it.
A chain edge joins nodes that follow each other, and a skip edge joins a node to the one before it with the
same normal form, or the same last seven digits, however far apart.  All potentials are
log ratios of counts over the whole corpus (piecewise training), with the patterns' spans
as labels; shapes are hashed into ``BUCKETS`` buckets, so the tables stay small.  A node that passes no kind's check is clean.  One that
may be personal but that no pattern decides weighs ``UNDECIDED`` of a clean one in training, as it is not known to be either.  Where
patterns have found a span the label is fixed.  Loopy belief propagation over the document's graph gives the
label probabilities, and a free node that reaches ``THRESHOLD`` becomes a span.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is no personal data; label i is KINDS[i - 1].
LABELS = 1 + len(KINDS)
MIN_DIGITS = 7
BUCKETS = 1 << 12
THRESHOLD = 0.9
ROUNDS, DAMPING = 12, 0.5
#: Nodes that are propagated side by side, about 3 KB each at the most; a text of more is by itself.
NODES_AT_ONCE = 20_000
SMOOTHING = 1.0
UNDECIDED = 0.1
#: Characters of a word or number that its shape looks at.
SHAPED = 64

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]++")
_RUN = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,3}+[0-9])*+")
_GROUP = re.compile(r"[^\x20]++")
_EDGE = "\"'()[]{}<>.,;:!?"
NODE = {"start": pa.int32(), "end": pa.int32(), "label": pa.int32(), "shapes": pa.list_(pa.int32()), "checks": pa.int32(), "context": pa.int32(), "allowed": pa.int32(), "key": pa.int64()}
_NODE_SQL = "start: int, end: int, label: int, shapes: array<int>, checks: int, context: int, allowed: int, key: bigint"
_EDGES_SCHEMA = "table string, bucket int, label int, other int, n double"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all pattern matches, by start and then kind."""
    if not text or not _ANY.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _shape(token: str) -> str:
    """Digits and letters by class, any separators as one, runs of over four cut short."""
    out = re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "a", token[:SHAPED]))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", re.sub(r"[ ().\-/]+", "-", out).strip("-"))[:32]


def _shapes(token: str, label: int) -> list[str]:
    """A node's shape; for a labelled phone number also those of it without its first groups: what its pattern asks for must not be all that is learned."""
    out = [_shape(token)]
    if label == 4:
        groups = re.split(r"[ ().\-/]+", token)
        out += [_shape("-".join(groups[i:])) for i in range(1, len(groups)) if len(_digits("".join(groups[i:]))) >= MIN_DIGITS]
    return out


def _allowed(token: str) -> int:
    """Bits of the labels that a token's digits allow: what fails a kind's own check is never of that kind."""
    if "@" in token:
        local, _, host = token.partition("@")
        return 1 | (2 if local.strip() and host.strip() else 0)
    parts = [p for p in re.split(r"[^0-9]+", token) if p]
    digits = "".join(parts)
    bits = 1
    if len(digits) <= 19:
        bits |= 4 if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else 0
        bits |= 8 if len(digits) >= 14 and luhn(digits) else 0
        bits |= 16 if MIN_DIGITS <= len(digits) <= 15 else 0
    return bits


def _bucket(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass")) % BUCKETS


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of digits within a part of the text; a run with several numbers of their own is taken apart at its blanks."""
    for m in _RUN.finditer(text, start, end):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        n = len(_digits(m[0]))
        if n < MIN_DIGITS:
            continue
        alone = sum(len(_digits(text[a:b])) >= MIN_DIGITS for a, b in groups)
        for a, b in groups if alone > 1 or n > 19 else [m.span()]:
            around = text[a - 1 : a] + text[b : b + 1]
            if len(_digits(text[a:b])) >= MIN_DIGITS and not any(c.isalnum() or c in "_@" for c in around):
                yield a, b


def _addresses(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Words with an ``@`` inside, and words beside one that stands alone."""
    if text.find("@", start, end) < 0:
        return
    before, loose = None, None
    for m in _WORD.finditer(text, start, end):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if loose is not None:
            if a < b:
                yield loose, b
            before = loose = None
        elif m[0] == "@":
            loose = before
        elif a < b:
            if text.find("@", a, b) >= 0:
                yield a, b
            before = a


def nodes(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """A ``NODE`` for each node: label -1 where nothing decides, the buckets of its shapes (its own first), of its checks and its context, allowed labels, key.

    A pattern's span is one node; nothing that touches one makes a node of its own.
    """
    if not text or not _ANY.search(text):
        return []
    found, at = [(a, b, k + 1) for a, b, k in spans], 0
    for a, b in [*((a, b) for a, b, _ in spans), (len(text), len(text))]:
        if a > at:
            own = sorted({*_numbers(text, at, a), *_addresses(text, at, a)})
            for i, (x, y) in enumerate(own):
                touches = x == at > 0 or y == a < len(text) or (i and own[i - 1][1] > x)
                if not touches:
                    found.append((x, y, -1))
        at = max(at, b)
    out = []
    for start, end, label in sorted(found):
        token = text[start:end]
        digits, allowed = _digits(token), _allowed(token)
        label = 0 if label < 0 and allowed == 1 else label
        same = digits[-7:] if "@" not in token and len(digits) >= 7 else "".join(token.lower().split())
        key = int.from_bytes(hashlib.blake2b(same.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        before, after = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
        context = _bucket("c", before[-1].lower().strip(_EDGE) if before else "", _shape(after[0]) if after else "")
        shapes = [_bucket("s", x) for x in _shapes(token, label)]
        out.append((start, end, label, shapes, _bucket("n", str(min(len(digits), 20)), str(allowed)), context, allowed, key))
    return out


def _skips(keys: list[int]) -> list[tuple[int, int]]:
    last: dict[int, int] = {}
    edges = []
    for i, key in enumerate(keys):
        if key in last:
            edges.append((last[key], i))
        last[key] = i
    return edges


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
    graph = pa.list_(pa.struct(list(NODE.items())))
    for batch in batches:
        spans, graphs = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            own = base_spans(text)
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
            graphs.append([dict(zip(NODE, n, strict=True)) for n in nodes(text, own)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kinds), pa.array(graphs, graph)], ["id", "base", "nodes"])


def _cooccurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts behind the potentials, of nodes, and of pairs of which one at least is decided."""
    for batch in batches:
        counts: dict[tuple[str, int, int, int], float] = {}

        def add(*cell, n=1.0, counts=counts):
            counts[cell] = counts.get(cell, 0.0) + n

        for graph in batch.column(0).to_pylist():
            labels = [max(n["label"], 0) for n in graph]
            weights = [UNDECIDED if n["label"] < 0 else 1.0 for n in graph]
            for n, y, w in zip(graph, labels, weights, strict=True):
                for shape in n["shapes"]:
                    add("shape", shape, y, 0, n=w)
                add("checks", n["checks"], y, 0, n=w)
                add("context", n["context"], y, 0, n=w)
            for i in range(len(graph) - 1):
                add("chain", 0, labels[i], labels[i + 1], n=weights[i] * weights[i + 1])
            for a, b in _skips([n["key"] for n in graph]):
                add("skip", 0, labels[a], labels[b], n=weights[a] * weights[b])
        if counts:
            cells = list(zip(*counts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cells[0]), *(pa.array(c, pa.int32()) for c in cells[1:]), pa.array(list(counts.values()), pa.float64())], ["table", "bucket", "label", "other", "n"])


class Potentials:
    def __init__(self, cells: list[tuple[str, int, int, int, float]]):
        own = {name: np.zeros((BUCKETS, LABELS)) for name in ("shape", "checks", "context")}
        pair = {name: np.zeros((LABELS, LABELS)) for name in ("chain", "skip")}
        for table, bucket, label, other, n in cells:
            if table in own:
                own[table][bucket, label] += n
            else:
                pair[table][label, other] += n
        prior = own["context"].sum(axis=0) + SMOOTHING  # a node counts once there
        prior /= prior.sum()
        share = {name: np.log((t + s * prior) / (t.sum(axis=1, keepdims=True) + s)) for (name, t), s in zip(own.items(), (SMOOTHING, 8.0, 8.0), strict=True)}
        self.shape, self.checks, self.context = share["shape"], share["checks"] - np.log(prior), share["context"] - np.log(prior)
        self.chain, self.skip = self._pair(pair["chain"], prior, 0.0), self._pair(pair["skip"], prior, 4.0)

    @staticmethod
    def _pair(counts: np.ndarray, prior: np.ndarray, agree: float) -> np.ndarray:
        """Log ratio of a pair's share to that by chance, within 6; labels of a skip edge that agree count ``agree`` times more before anything is seen."""
        both = counts + counts.T + (10.0 * np.outer(prior, prior) * LABELS)
        both += np.diag(agree * prior * LABELS * 10)
        share = both / both.sum()
        alone = share.sum(axis=0)
        return np.clip(np.log(share) - np.log(np.outer(alone, alone)), -6, 6)

    def marginals(self, graphs: list[list[dict]]) -> np.ndarray:
        """Label probabilities of all nodes of several documents, by damped loopy belief propagation over their graphs side by side."""
        flat = [n for g in graphs for n in g]
        own = self.shape[[n["shapes"][0] for n in flat]] + self.checks[[n["checks"] for n in flat]] + self.context[[n["context"] for n in flat]]
        own[(np.array([n["allowed"] for n in flat])[:, None] >> np.arange(LABELS)) & 1 == 0] = -30.0
        labels = np.array([n["label"] for n in flat])
        fixed = labels >= 0
        own[fixed] = -30.0
        own[fixed, labels[fixed]] = 0.0
        pairs, kinds, at = [], [], 0
        for g in graphs:
            chain = [(at + i, at + i + 1) for i in range(len(g) - 1)]
            skip = [(at + a, at + b) for a, b in _skips([n["key"] for n in g])]
            pairs += chain + skip
            kinds += [0] * len(chain) + [1] * len(skip)
            at += len(g)
        belief = own
        if pairs:
            e, kind = np.array(pairs), np.array(kinds)
            source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            table = np.stack([self.chain, self.skip])[np.concatenate([kind, kind])]
            message = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, target, message)
                out = (belief[source] - message[back])[:, :, None] + table
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                message = DAMPING * message + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
            belief = own.copy()
            np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _side_by_side(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Indexes of ``sizes`` in order, in runs whose sum is at most ``most``; a size above that is a run of its own."""
    run, total = [], 0
    for i, n in enumerate(sizes):
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(i)
        total += n
    if run:
        yield run


def _decode(shared):
    def text_of(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        potentials = shared.value
        for batch in batches:
            bases, graphs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [[(s["start"], s["end"], s["kind"]) for s in b] for b in bases]
            counts = [[sum(s[2] == k for s in b) for b in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(text_of(b).encode()).hexdigest() for b in found]
            open_rows = [i for i, g in enumerate(graphs) if any(n["label"] < 0 for n in g)]
            for run in _side_by_side([len(graphs[i]) for i in open_rows], NODES_AT_ONCE):
                rows = [open_rows[k] for k in run]
                p, i = potentials.marginals([graphs[r] for r in rows]), 0
                for r in rows:
                    for n in graphs[r]:
                        best = int(p[i].argmax())
                        if n["label"] < 0 and best and p[i, best] >= THRESHOLD:
                            found[r].append((n["start"], n["end"], best - 1))
                        i += 1
                    found[r].sort(key=lambda s: (s[0], s[2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array([text_of(s) for s in found])], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card and n_phone of the patterns' matches, base_sha256 of those and spans of all.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined.  A null text is empty and has none.
    Rows that repeat an id are found each on its own.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(rows.mapInArrow(_scan, f"id {id_type}, base array<struct<start: int, end: int, kind: int>>, nodes array<struct<{_NODE_SQL}>>"), "pii")
    cells = scanned.where(F.size("nodes") > 0).select("nodes").mapInArrow(_cooccurrences, _EDGES_SCHEMA)
    cells = cells.groupBy("table", "bucket", "label", "other").agg(F.sum("n").alias("n")).collect()  # at most 3 * BUCKETS * LABELS rows and the pairs of labels
    shared = docs.sparkSession.sparkContext.broadcast(Potentials([tuple(c) for c in cells]))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return scanned.mapInArrow(_decode(shared), f"id {id_type}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``find_pii`` replaced by its kind in square brackets; of overlapping spans the first stays.

    Ids must be unique and not null; texts of other rows stay as they are.
    """
    spans = find_pii(docs, id_col=id_col, text_col=text_col).where("spans <> ''").select(F.col(id_col).alias("k"), "spans")

    @F.pandas_udf("string")
    def cut(texts, found):
        def one(text, spans):
            if text is None or spans is None:
                return text
            out, at = [], 0
            for span in spans.split(","):
                kind, a, b = span.split(":")
                if int(a) >= at:
                    out += [text[at : int(a)], f"[{kind}]"]
                    at = int(b)
            return "".join(out) + text[at:]

        return texts.combine(found, one)

    rows, found = docs.alias("d"), spans.alias("p")
    joined = rows.join(found, F.col(f"d.`{id_col}`") == F.col("p.k"), "left")
    text = F.col(f"d.`{text_col}`")
    redacted = F.when(F.col("p.spans").isNull(), text).otherwise(cut(text, F.col("p.spans")))
    return joined.select(*[redacted.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
