"""The corpus as a Spark data source: planned partitions, pruned by source, kind and year, and a stream of new files.

``register(spark)`` once, then ``spark.read.format("docloom_corpus").option("path", root).load()`` or ``readStream``.
A file's first two folders below the root are its source and kind, a folder of four digits its year.  Filters on these
with ``=`` or ``IN`` cut the listing itself: other folders are not even opened.  Files are dealt to partitions by number and
bytes, so one task neither opens too many nor holds a huge one beside others.

A stream goes by time of change, then by path: what is new or was changed since the last run is read, nothing else.  Files
younger than ``settleSeconds`` (2) wait for the next batch, so that one which is still being written is not missed.  A file
that is put in place with an old time of change is not seen by a running stream; a full read has it.

Any file system that pyarrow opens will do.  Listing is done by one process, as Spark's own file sources do it for
streams; reading is done in tasks.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .front_matter import split_document

NAME = "docloom_corpus"
SCHEMA = "path string, source string, kind string, year int, modified timestamp, title string, attrs map<string,string>, lists map<string,array<string>>, records map<string,string>, body string, error string"
_PRUNED = ("source", "kind", "year")
_YEAR = re.compile(r"^(?:19|20)\d\d$")


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    changed: int  # nanoseconds


@dataclass
class Files(InputPartition):
    files: Sequence[Found]


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    found, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return found, base.rstrip("/")


def _parts(base: str, path: str) -> tuple[str | None, str | None, int | None]:
    """(source, kind, year) of a file."""
    folders = path[len(base) :].strip("/").split("/")[:-1]
    year = next((int(f) for f in folders if _YEAR.match(f)), None)
    return folders[0] if folders else None, folders[1] if len(folders) > 1 else None, year


def listed(root: str, pattern: str, wanted: dict[str, set]) -> list[Found]:
    """The files below ``root``; folders that no wanted file can lie in are not opened."""
    system, base = _opened(root)
    out, open_ = [], [(base, 0)]
    while open_:
        folder, depth = open_.pop()
        for x in system.get_file_info(fs.FileSelector(folder)):
            if x.type == fs.FileType.Directory:
                column = ("source", "kind")[depth] if depth < 2 else None
                if column in wanted and x.base_name not in wanted[column]:
                    continue
                if "year" in wanted and _YEAR.match(x.base_name) and int(x.base_name) not in wanted["year"]:
                    continue
                open_.append((x.path, depth + 1))
            elif fnmatch(x.base_name, pattern):
                mine = dict(zip(_PRUNED, _parts(base, x.path), strict=True))
                if all(mine[c] in values for c, values in wanted.items()):
                    out.append(Found(x.path, x.size or 0, x.mtime_ns or 0))
    return sorted(out, key=lambda f: (f.changed, f.path))


def dealt(files: Sequence[Found], most_files: int, most_bytes: int) -> list[Files]:
    """Partitions of neighbouring paths, each with so many files and bytes at most, or one file."""
    out: list[list[Found]] = []
    size = 0
    for f in sorted(files, key=lambda f: f.path):
        if not out or len(out[-1]) >= most_files or size + f.size > most_bytes:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size
    return [Files(tuple(x)) for x in out]


_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us", tz="UTC"), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def _row(system: fs.FileSystem, base: str, f: Found) -> tuple:
    """A document; one that cannot be read or has no front matter is a row with ``error``."""
    keys, title, body, error = {}, "", None, None
    try:
        with system.open_input_file(f.path) as x:
            keys, title, body, error = split_document(x.read().decode())
    except (OSError, UnicodeDecodeError) as e:
        error = f"{type(e).__name__}: {e}"
    flat = [(k, v) for k, v in keys.items() if v is None or isinstance(v, str)]
    held = {k: v for k, v in keys.items() if isinstance(v, dict) or isinstance(v, list)}
    plain = lambda v: isinstance(v, list) and not any(isinstance(x, dict) for x in v)
    lists = [(k, [x for x in v if x is None or isinstance(x, str)]) for k, v in held.items() if plain(v)]
    records = [(k, json.dumps(v, ensure_ascii=False)) for k, v in held.items() if not plain(v)]
    changed = datetime.fromtimestamp(f.changed / 1e9, timezone.utc)
    return (f.path, *_parts(base, f.path), changed, title, flat, lists, records, body, error)


def _read(root: str, files: Sequence[Found]) -> Iterator[pa.RecordBatch]:
    system, base = _opened(root)
    for f in files:  # a file at a time: a batch of long texts would have to be held whole
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_row(system, base, f), _KINDS, strict=True)], names=_NAMES)


class _Options:
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.md")
        self.most_files, self.most_bytes = int(options.get("filesPerPartition", 512)), int(options.get("bytesPerPartition", 64 << 20))
        self.settle = float(options.get("settleSeconds", 2))


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = _Options(options), {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in _PRUNED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f  # Spark's own to apply

    def partitions(self) -> Sequence[InputPartition]:
        o = self.options
        return dealt(listed(o.root, o.pattern, self.wanted), o.most_files, o.most_bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.options.root, partition.files)


class CorpusStream(DataSourceStreamReader):
    """Offsets are the (time of change, path) of the last file."""

    def __init__(self, options: dict):
        self.options = _Options(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.time_ns() - int(self.options.settle * 1e9)
        files = [f for f in listed(self.options.root, self.options.pattern, {}) if f.changed <= now]
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        o, key = self.options, lambda x: (x["changed"], x["path"])
        new = [f for f in listed(o.root, o.pattern, {}) if key(start) < (f.changed, f.path) <= key(end)]
        return dealt(new, o.most_files, o.most_bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.options.root, partition.files)

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch that is done."""


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)

    def streamReader(self, schema) -> CorpusStream:  # noqa: N802
        return CorpusStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Corpus)
    return spark
