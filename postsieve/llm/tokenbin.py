"""Token ids in binary shards with a minimal perfect hash index over document keys.

``write_tokens`` deals the documents out in ascending key order and encodes each
partition into one shard, a file of the raw little-endian ids, 2 bytes each where the
vocabulary allows, else 4.  A shard is written under a name of its own attempt and
only counts once Spark has committed the rows that name it, so a task that is run
again does no harm.  The width, the shards and their first ids are in a manifest table.

The index is split by key hash into parts of bounded size.  A part holds a minimal
perfect hash and, by slot, a 32-bit fingerprint, the shard, the offset and the
number of ids and rows.  Finding a key takes one part, one slot and one read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workers
from .perfecthash import PerfectHash, fingerprints
from .store import new_dir, written

#: Keys of one part of the index, about.
PART_KEYS = 50_000
#: Words whose ids an encoder keeps.
CACHE_WORDS = 800_000
_FLUSH = 4 << 20
#: ASCII marks without the apostrophe, which can begin a piece with letters.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The rule of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_encoders: dict[str, Encoder] = {}
workers.keep("tokenbin", _encoders.clear)


class Encoder:
    """Ids of whole texts, as bytes; what a byte-level BPE splits at each single space is encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        self.by_word = config["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not config.get("normalizer")
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.pre, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        #: A space after other white space belongs to that run.
        self.run = re.compile(r"\s ")

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        """A plain word, with punctuation behind it or not, is split here; the library's own splitter, slower, does all others."""
        letters = word.rstrip(_PUNCTUATION)
        if letters.isalpha() and max(letters) < "\u0250":
            pieces = [self._byte_level(lead + letters)]
            if len(letters) < len(word):
                pieces.append(word[len(letters) :])
        else:
            pieces = [piece for piece, _ in self.pre.pre_tokenize_str(lead + word)]
        return self._ids([t.id for piece in pieces for t in self.model.tokenize(piece)])

    def _byte_level(self, text: str) -> str:
        """Each UTF-8 byte as the letter that stands for it."""
        return text.encode().decode("latin-1").translate(_BYTE_LETTERS)

    def _known(self, words: list[str], cache: dict[str, bytes], lead: str) -> list[bytes]:
        out = list(map(cache.get, words))
        for at in [i for i, ids in enumerate(out) if ids is None]:
            ids = cache.get(words[at])
            if ids is None:
                ids = self._word(lead, words[at])
                if len(cache) < CACHE_WORDS:
                    cache[words[at]] = ids
            out[at] = ids
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or text[0] == " " or text[-1] == " " or any(t in text for t in self.added) or self.run.search(text):
            return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.split(" ")
        return b"".join(self._known(words[:1], self.first, "") + self._known(words[1:], self.later, " "))


def encoder(path: str) -> Encoder:
    workers.begin("tokenbin")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _encode_shards(directory: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        fs, root = _filesystem(directory)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        out, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.body")
            counts, held, size = [], [], 0
            for text in batch.column(1):
                ids = code.encode(text.as_py() or "") + end
                counts.append(len(ids) // code.width)
                held.append(ids)
                size += len(ids)
                if size > _FLUSH:
                    out.write(b"".join(held))
                    held, size = [], 0
            out.write(b"".join(held))
            n = np.array(counts, np.int64)
            offsets = total + np.cumsum(n) - n
            total += int(n.sum())
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(rows, shard)), pa.array([name] * rows), pa.array(np.full(rows, code.width)), pa.array(offsets), pa.array(n)], ["key", "shard", "file", "width", "offset", "n_tokens"])
        if out is not None:
            out.close()
            fs.move(f"{root}/{name}.body", f"{root}/{name}")

    return run


def _index_part(part: pa.Table) -> pa.Table:
    keys = part.column("key").to_numpy().astype(np.int64).view(np.uint64)
    found = PerfectHash.build(keys)
    order = np.argsort(found.slots(keys))
    blob = {c: part.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("shard", "offset", "n_tokens", "rows")}
    return pa.table({"part": part.column("part")[:1], "n_keys": [len(keys)], "hash": [found.to_bytes()], "prints": [fingerprints(keys[order]).astype("<u4").tobytes()], **{c: [v] for c, v in blob.items()}})


def _find_part(asked: pa.Table, index: pa.Table) -> pa.Table:
    keys = asked.column("key").to_numpy().astype(np.int64)
    if not index.num_rows or not len(keys):
        return pa.table({"key": pa.array([], pa.int64()), **{c: pa.array([], pa.int64()) for c in ("shard", "offset", "n_tokens", "rows")}})
    found = PerfectHash.from_bytes(index.column("hash")[0].as_py())
    slots = found.slots(keys.view(np.uint64))
    prints = np.frombuffer(index.column("prints")[0].as_py(), "<u4")
    hit = slots >= 0
    hit[hit] = prints[slots[hit]] == fingerprints(keys.view(np.uint64)[hit])
    columns = {c: np.frombuffer(index.column(c)[0].as_py(), "<i8")[slots[hit]] for c in ("shard", "offset", "n_tokens", "rows")}
    return pa.table({"key": keys[hit], **columns})


def _read_payload(directory: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(directory)
        name, source = None, None
        for batch in batches:
            keys, held, size = [], [], 0
            for key, file, offset, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                data = source.read_at(n * width, offset * width)
                if len(data) != n * width:
                    raise OSError(f"{file} ends before id {offset + n}")
                keys.append(key)
                held.append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
                size += 4 * n
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary())], ["key", "ids"])
                    keys, held, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary())], ["key", "ids"])
        if source is not None:
            source.close()

    return run


@dataclass(frozen=True)
class TokenStore:
    """Where the shards are, and the tables that describe them."""

    directory: str
    manifest: DataFrame
    index: DataFrame
    parts: int
    width: int


def write_tokens(docs: DataFrame, tokenizer: str, *, key_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> TokenStore:
    """Encode whole texts, append ``end_id`` to each, and write shards and index.

    A null or empty text is the end id alone.  Rows that repeat a key lie side by side and are found together.  A row
    with a null key is written, before all others, but no key finds it.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    directory = new_dir(spark, "tokens")
    rows = docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    entries = written(rows.mapInArrow(_encode_shards(directory, tokenizer, end_id), "key long, shard long, file string, width long, offset long, n_tokens long"), "entries")

    shards = entries.groupBy("shard", "file").agg(F.max("width").alias("width"), F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = written(shards.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")
    n_rows, width = manifest.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.max("width"), F.lit(2))).first()

    parts = max(1, -(-n_rows // PART_KEYS))
    keyed = entries.where("key is not null").groupBy("key").agg(F.min("shard").alias("shard"), F.min("offset").alias("offset"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    index = keyed.groupBy("part").applyInArrow(_index_part, "part long, n_keys long, hash binary, prints binary, shard binary, offset binary, n_tokens binary, rows binary")
    return TokenStore(directory, manifest, written(index, "index"), parts, width)


def read_tokens(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(key, start, n_tokens, n_rows, ids) for each distinct indexed key of ``keys`` (one column), read from the shards.

    start: ids of all rows before; ids: little-endian unsigned 32-bit.  A key that was not indexed gives no row, but for
    one in 2**32 whose fingerprint happens to agree; nulls give none.
    """
    asked = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).where("key is not null").distinct()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(store.parts)))
    found = asked.groupBy("part").cogroup(store.index.groupBy("part")).applyInArrow(_find_part, "key long, shard long, offset long, n_tokens long, rows long")
    placed = written(found.join(store.manifest.select("shard", "file", "first_id"), "shard"), "places")
    reads = placed.select("key", "file", "offset", "n_tokens", "shard").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").drop("shard")
    ids = reads.mapInArrow(_read_payload(store.directory, store.width), "key long, ids binary")
    facts = placed.select("key", (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", F.col("rows").alias("n_rows"))
    return facts.join(ids.select("key", F.crc32("ids").alias("ids_crc32"), "ids"), "key")
