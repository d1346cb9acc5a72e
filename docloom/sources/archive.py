"""Zip archives as tables: members of good archives, and members carved out of damaged ones.

Archives are files of any size and are never held whole.  A directory, or the places where members can start, become rows
of numbers; these are dealt to tasks, and each task reads the bytes of its own members from the file, so one huge archive
is read by many tasks and memory holds one large member or a few small ones.  Errors are rows, not failures.  Any file system that pyarrow opens
will do.
"""

from __future__ import annotations

import io
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Members above this size are reported, not read.
MOST_BYTES = 200 * 1024 * 1024
#: Extensions of documents, and of those that are looked for in damaged archives.
EXTENSIONS = (".pdf", ".docx", ".odt", ".xlsx", ".ods", ".md", ".txt", ".doc", ".pptx", ".odp", ".csv", ".rtf", ".tsv", ".html", ".xls", ".json", ".vtt", ".srt", ".odg")
RECOVERED = (".pdf", ".docx", ".odt", ".xlsx", ".ods", ".md", ".txt", ".doc", ".pptx", ".odp", ".csv", ".rtf")
#: Bytes of a file that one task searches for members' starts.
BLOCK = 64 * 1024 * 1024
LOCAL, DESCRIPTOR, END = b"PK\x03\x04", b"PK\x07\x08", b"PK\x05\x06"
_HEADER = struct.Struct("<4sHHHHHIIIHH")
_SCHEMA = "archive string, name string, size long, status string, content binary"
_CHUNK = 1 << 20
#: Bytes of contents in a batch of rows, at least, where there are so many.
BATCH = 4 << 20


# ---- one member of an open file ---------------------------------------------------------------------------------


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _length(file) -> int:
    return file.seek(0, 2)


def _at(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def _chunks(file, start: int) -> Iterator[bytes]:
    """The file from ``start`` on, in chunks that grow, as most members are small."""
    size = 1 << 14
    while part := _at(file, start, size):
        yield part
        start, size = start + len(part), min(2 * size, _CHUNK)


def _inflated(file, start: int, most: int) -> tuple[bytes | None, int, int, int | None]:
    """(content, size, CRC, end) of the deflate stream at ``start``; no content beyond ``most``, no end if it is cut off."""
    stream, chunks, kept = zlib.decompressobj(-15), _chunks(file, start), []
    rest, read, size, crc = b"", 0, 0, 0
    while not stream.eof:
        if not rest:
            rest = next(chunks, b"")
            read += len(rest)
        part = stream.decompress(rest, _CHUNK)
        if not rest and not part:
            return None, size, crc, None
        rest, size, crc = stream.unconsumed_tail, size + len(part), zlib.crc32(part, crc)
        if size > most:
            kept.clear()
        else:
            kept.append(part)
    return (b"".join(kept) if size <= most else None), size, crc, start + read - len(stream.unused_data)


def _described(file, start: int, most: int) -> tuple[bytes | None, int | None]:
    """(payload, CRC) of a stored payload before a descriptor that tells its length and CRC, or nothing."""
    data, searched, done, crc = bytearray(), 0, 0, 0
    for part in _chunks(file, start):
        data += part
        at = data.find(DESCRIPTOR, searched)
        while 0 <= at <= len(data) - 16:
            told, size = struct.unpack_from("<II", data, at + 4)
            if size == at:
                crc, done = zlib.crc32(data[done:at], crc), at
                if crc == told:
                    return bytes(data[:at]), crc
            at = data.find(DESCRIPTOR, at + 4)
        searched = at if at >= 0 else max(0, len(data) - 3)
        if searched > most:
            break
    return None, None


def _last_end(file, start: int) -> int:
    """Where the last end-of-directory record behind ``start`` ends, or the file."""
    length = _length(file)
    high = length
    while high > start:
        low = max(start, high - _CHUNK)
        found = _at(file, low, min(high + 3, length) - low).rfind(END)
        if found >= 0:
            return min(low + found + 22, length)
        high = low
    return length


def member_at(file, at: int, following: int | None = None, most: int = MOST_BYTES) -> tuple[str, bytes | None, int | None, str, int]:
    """(name, content, size, status, end) of the member whose local header stands at ``at``; the next one's is known or None.

    Its length comes from the header, from the deflate stream, or from the descriptor behind it whose length and CRC
    agree; without these it ends at the next header, or, for the last one, with the last end-of-directory record.
    A descriptor is looked for within ``most`` bytes.
    """
    length = _length(file)
    head = _at(file, at, 30)
    if len(head) < 30 or head[:4] != LOCAL:
        return "", None, None, "FAIL no local header", at + 4
    _, _, flags, method, _, _, crc, packed, _, n_name, n_extra = _HEADER.unpack(head)
    name, start = file.read(n_name).decode("utf-8", "replace"), at + 30 + n_name + n_extra
    if flags & 1:
        return name, None, None, "FAIL encrypted", start
    if method == 8:
        try:
            content, size, own, end = _inflated(file, start, most)
        except zlib.error as e:
            return name, None, None, f"FAIL {e}", start
        if end is None:
            return name, None, size, "FAIL cut off", length
        if flags & 8:
            tail = _at(file, end, 8)
            crc = struct.unpack_from("<I", tail, 4)[0] if tail[:4] == DESCRIPTOR and len(tail) == 8 else None
    elif method == 0:
        content = None
        if flags & 8:
            content, crc = _described(file, start, most)
            end = start + len(content) if content is not None else following if following is not None else _last_end(file, start)
            if end < start:
                return name, None, None, "FAIL next hit inside the header", start
            if content is None:
                end -= next((n for n in (24, 16) if end - n >= start and _at(file, end - n, 4) == DESCRIPTOR), 0)
        else:
            end = start + packed
        size = end - start
        if end > length:
            return name, None, size, "FAIL cut off", length
        if content is None and size <= most:
            content = _at(file, start, size)
        own = zlib.crc32(content) if content is not None else None
    else:
        return name, None, None, f"FAIL method {method}", start
    if content is None:
        return name, None, size, "SKIP too large", end
    if crc is not None and own != crc:
        return name, None, size, "FAIL checksum", end
    return name, content, size, "OK" if crc is not None else "OK without checksum", end


# ---- good archives ----------------------------------------------------------------------------------------------


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _small(file):
    """The file, or its bytes if they are few: a search for the end may look before the start of a tiny archive."""
    length = _length(file)
    return io.BytesIO(_at(file, 0, length)) if length < _CHUNK else file


def _directories(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The directory of each archive: its end is read, and nothing else."""
    for path in (p for b in batches for p in b.column("archive").to_pylist()):
        rows, problem = [], None
        try:
            with _open(path) as file, zipfile.ZipFile(_small(file)) as z:
                rows = [(m.filename, m.file_size, m.header_offset) for m in z.infolist()]
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
            rows, problem = [(None, None, None)], f"FAIL {e}"
        for i in range(0, len(rows), 10_000):
            names, sizes, places = zip(*rows[i : i + 10_000], strict=True)
            n = len(names)
            yield _table({"archive": ([path] * n, pa.string()), "name": (names, pa.string()), "size": (sizes, pa.int64()), "at": (places, pa.int64()), "status": ([problem] * n, pa.string())})


def _wanted(name: Column, extensions: tuple[str, ...]) -> Column:
    """Files, not folders, with one of the extensions."""
    low, ends = F.lower(name), F.lit(False)
    for x in extensions:
        ends = ends | low.endswith(x)
    return ends & ~name.endswith("/")


def _rows(members: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ("archive", "name", "size", "status", "content")
    return _table(dict(zip(names, zip(map(list, zip(*members, strict=True)), types, strict=True), strict=True)))


def _contents(listed: bool, most: int):
    """Members of rows ``archive, at, following``; in listed archives ``name`` and ``status`` are known already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, ready, held = None, None, [], 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["status"] is None:
                        if row["archive"] != path:
                            if file is not None:
                                file.close()
                            path, file = row["archive"], _open(row["archive"])
                        name, content, size, status, _ = member_at(file, row["at"], row["following"], most)
                        row |= {"content": content, "status": status, "size": size if not listed or status.startswith("OK") else row["size"], "name": row["name"] if listed else name}
                    ready.append((row["archive"], row["name"], row["size"], row["status"], row.get("content")))
                    held += len(row.get("content") or b"")
                    if held >= BATCH:  # small members together, a large one at once
                        yield _rows(ready)
                        ready, held = [], 0
                if ready:
                    yield _rows(ready)
                    ready, held = [], 0
        finally:
            if file is not None:
                file.close()

    return run


def _read(members: DataFrame, listed: bool, most: int) -> DataFrame:
    """Members by number to tasks, and those of one archive in a task by place."""
    dealt = members.repartition(F.col("archive"), F.floor(F.col("at") / BLOCK)).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(_contents(listed, most), _SCHEMA)


def _archives(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``archive, length`` of the files below ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("archive"), "length")


def read_members(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, most: int = MOST_BYTES, pattern: str = "*.zip") -> DataFrame:
    """``archive, name, size, status, content`` of the archives' documents.

    Members of other methods than stored and deflated, and encrypted ones, are rows with an error.
    """
    found = _archives(spark, path, pattern).select("archive").mapInArrow(_directories, "archive string, name string, size long, at long, status string")
    wanted = found.filter(F.col("status").isNotNull() | _wanted(F.col("name"), extensions))
    status = F.when(F.col("size") > most, F.lit("SKIP too large")).otherwise(F.col("status"))
    return _read(wanted.withColumn("status", status).withColumn("following", F.lit(None).cast("long")), True, most)


# ---- damaged archives -------------------------------------------------------------------------------------------


def carve(data: bytes, offsets: list[int] | None = None, extensions: tuple[str, ...] = RECOVERED) -> Iterator[tuple[str, bytes | None, str]]:
    """(name, content, status) of a damaged archive's documents, at ``offsets`` or wherever a member can start.

    Without offsets headers inside a member are passed over, so the members of nested archives do not come out.
    """
    file, places = io.BytesIO(data), sorted(set(offsets)) if offsets is not None else None
    at = places[0] if places else data.find(LOCAL) if places is None else -1
    while at >= 0:
        following = next((x for x in places if x > at), None) if places is not None else None
        name, content, _, status, end = member_at(file, at, following, sys.maxsize)
        if not name.endswith("/") and (not name or name.lower().endswith(extensions)):
            yield name, content, status
        at = (following if following is not None else -1) if places is not None else data.find(LOCAL, max(end, at + 4))


def _carve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, hits in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("hits").to_pylist(), strict=True):
            for name, x, status in carve(content.as_py(), hits):
                yield _table({"archive": ([path], pa.string()), "name": ([name], pa.string()), "size": ([len(x) if x is not None else None], pa.int64()), "status": ([status], pa.string()), "content": ([x], pa.binary())})


def recover_members(archives: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Members carved out of small ``archives`` whose contents are rows (path, content); see ``recover_files``."""
    none = F.lit(None).cast("array<bigint>").alias("hits")
    with_hits = archives.select("path", "content", none) if hits is None else archives.join(hits, "path", "left").select("path", "content", "hits")
    return with_hits.mapInArrow(_carve, _SCHEMA)


def hit_offsets(lists: DataFrame, column: str = "value") -> DataFrame:
    """Offsets from JSON hit lists ``[[offset, ...], ...]`` (path, text)."""
    parsed = F.from_json(F.col(column), "array<array<bigint>>")
    return lists.select("path", F.transform(parsed, lambda x: F.element_at(x, 1)).alias("hits"))


def _starts(block: int):
    """Where a local header's mark stands in each block of a file; a mark across two blocks belongs to the first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low in zip(batch.column("archive").to_pylist(), batch.column("low").to_pylist(), strict=True):
                with _open(path) as file:
                    data = _at(file, low, block + 3)
                places, at = [], data.find(LOCAL)
                while at >= 0:
                    places.append(low + at)
                    at = data.find(LOCAL, at + 4)
                yield _table({"archive": ([path] * len(places), pa.string()), "at": (places, pa.int64())})

    return run


def header_offsets(spark: SparkSession, path: str, pattern: str = "*.zip", block: int = BLOCK) -> DataFrame:
    """``archive, at`` of each place in the files where a member can start; a task searches one block at a time."""
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block).cast("long")))
    blocks = _archives(spark, path, pattern).select("archive", lows.alias("low"))
    return blocks.repartition("archive", "low").mapInArrow(_starts(block), "archive string, at long")


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, file = None, None
    try:
        for batch in batches:
            paths, places, names, beyond = batch.column("archive").to_pylist(), batch.column("at").to_pylist(), [], []
            for p, at in zip(paths, places, strict=True):
                if p != path:
                    if file is not None:
                        file.close()
                    path, file = p, _open(p)
                name, _, _, _, end = member_at(file, at)
                names.append(name)
                beyond.append(max(end, at + 4))
            yield _table({"archive": (paths, pa.string()), "at": (places, pa.int64()), "name": (names, pa.string()), "beyond": (beyond, pa.int64())})
    finally:
        if file is not None:
            file.close()


def _outer(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of place, without those inside a kept one; what is kept of the rows before is one number."""
    path, reached = None, 0
    for frame in frames:
        keep = []
        for p, at, beyond in zip(frame["archive"], frame["at"], frame["beyond"], strict=True):
            if p != path:
                path, reached = p, 0
            keep.append(at >= reached)
            if at >= reached:
                reached = beyond
        yield frame[keep]


def recover_files(spark: SparkSession, path: str, hits: DataFrame | None = None, extensions: tuple[str, ...] = RECOVERED, most: int = MOST_BYTES, pattern: str = "*.zip", block: int = BLOCK) -> DataFrame:
    """``archive, name, size, status, content`` of documents carved out of damaged archives, without their directories.

    With ``hits`` (archive, at: places of headers) a member of unknown length ends at the next hit.  Without them all
    places where a member can start are tried, and those inside a member are passed over.  The rows are those of ``carve``.
    """
    named = F.coalesce(F.col("name") == "", F.lit(True)) | _wanted(F.col("name"), extensions)
    if hits is not None:
        places = _archives(spark, path, pattern).join(hits.select("archive", "at").distinct(), "archive")
        order = Window.partitionBy("archive").orderBy("at")  # numbers only
        found = places.select("archive", "at", F.lead("at").over(order).alias("following"))
        read = _read(found.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("size", "long"), ("status", "string"))]), False, most)
        return read.filter(named)
    tried = header_offsets(spark, path, pattern, block).repartition(F.col("archive"), F.floor(F.col("at") / BLOCK)).sortWithinPartitions("archive", "at")
    ended = tried.mapInArrow(_ends, "archive string, at long, name string, beyond long")
    outer = ended.repartition("archive").sortWithinPartitions("archive", "at").mapInPandas(_outer, ended.schema)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("following", "long"), ("size", "long"), ("status", "string"))]
    return _read(outer.filter(named).select("archive", "at", "name", *none), False, most)


# ---- writing ----------------------------------------------------------------------------------------------------


def _packed(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        path, n = f"{base}/part-{task.partitionId():05d}.zip", 0
        aside = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}"
        with system.open_output_stream(aside) as file, zipfile.ZipFile(file, "w") as z:
            for batch in batches:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    z.writestr(zipfile.ZipInfo(name), content.as_py() or b"", zipfile.ZIP_STORED if n % 2 else zipfile.ZIP_DEFLATED)
                    n += 1
        system.move(aside, path)
        yield _table({"archive": ([path], pa.string()), "members": ([n], pa.int64())})

    return run


def write_archives(files: DataFrame, folder: str) -> int:
    """Write rows ``name, content`` as archives, one for each partition, and tell the number of members.

    An archive is written aside and moved into place, so a task that runs again replaces its own.
    """
    written = files.select("name", "content").mapInArrow(_packed(folder), "archive string, members long")
    return written.agg(F.sum("members")).first()[0] or 0


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, ext, size`` of every file below ``root``, without reading contents."""
    from ..functions.text import extension

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    return files.select(path.alias("path"), extension(path).alias("ext"), F.col("length").alias("size"))
