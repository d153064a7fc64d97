"""Landed payload files as a data source with a partition per file.

What one file can't give is a row with an error, found when it is read, so that a broken or vanished payload stops neither its source nor the others.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, source_ord int, token string, seq long, payload string, error string"
#: Files of a source and sources that the arrival number has room for.
FILE_BITS = 40
COMPRESSIONS = {"none": lambda data: data, "gzip": gzip.decompress}


class PayloadFile(InputPartition):
    def __init__(self, source: str, source_ord: int, seq: int, path: str | None, compression: str, error: str | None = None):
        self.source, self.source_ord, self.seq, self.path, self.compression, self.error = source, source_ord, seq, path, compression, error


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _token(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


class LandedReader(DataSourceReader):
    def __init__(self, sources: Sequence[tuple[str, str, str]]):
        self.sources = sources

    def partitions(self) -> list[PayloadFile]:
        """A partition per file, in the order of the sources and of the names; a source that can't be listed is one with its error."""
        from pyarrow import fs

        out: list[PayloadFile] = []
        for i, (name, folder, compression) in enumerate(self.sources):
            try:
                system, path = _file_system(folder)
                listed = system.get_file_info(fs.FileSelector(path, recursive=True))
                files = sorted(f.path for f in listed if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
            except (OSError, ValueError) as e:
                out.append(PayloadFile(name, i, i << FILE_BITS, None, compression, f"{type(e).__name__}: {folder}"))
                continue
            scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
            out += [PayloadFile(name, i, (i << FILE_BITS) + k, scheme + f, compression) for k, f in enumerate(files)]
        return out or [PayloadFile("", -1, -1, None, "none")]

    def read(self, partition: PayloadFile) -> Iterator[tuple]:
        p = partition
        if p.source_ord < 0:
            return
        payload, error = None, p.error
        if p.path is not None:
            try:
                system, path = _file_system(p.path)
                with system.open_input_stream(path, compression=None) as f:
                    payload = COMPRESSIONS[p.compression](f.read()).decode("utf-8")
                json.loads(payload)
            except (OSError, EOFError, ValueError) as e:
                payload, error = None, f"{type(e).__name__}: {e}"[:200]
        yield p.source, p.source_ord, _token(p.path) if p.path else None, p.seq, payload, error


class Landed(DataSource):
    """``sources`` is a JSON list of [name, folder, compression]."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        sources = [tuple(s) for s in json.loads(self.options["sources"])]
        unknown = {c for _, _, c in sources} - COMPRESSIONS.keys()
        if unknown:
            raise ValueError(f"unknown compression: {sorted(unknown)}")
        return LandedReader(sources)


def read_landed(spark: SparkSession, sources: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(source, source_ord, token, seq, payload, error), a row per file of the folders of (name, folder, compression).

    ``seq`` numbers arrivals by source and then file name; ``token`` is the file's name up to its first dot.  A file that can't be read, decompressed, decoded or parsed as JSON
    has an error and no payload; so has, as one row without a token, a folder that can't be listed.
    """
    spark.dataSource.register(Landed)
    return spark.read.format("landed").option("sources", json.dumps([list(s) for s in sources])).load()


def split_landed(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a payload, rows with an error)."""
    return landed.where("error is null").drop("error"), landed.where("error is not null").drop("payload")
