"""Substring deduplication by seed and extend.

A word is removed if one of the ``min_words``-word windows that cover it also occurs in a document with a smaller
id.  Windows are judged on the input texts.

1. **Seeds.**  Every text is cut into words; of the ``gram``-word hashes in each window the least one is the
   window's anchor (winnowing), so equal windows in any two documents have equal anchors at the same offset.  About
   2 of ``min_words - gram + 2`` positions become anchors.
2. **Join.**  An anchor that occurs in two documents gets a leader: its occurrence with the least (id, position).
   Every other occurrence is joined to its leader only, never to all others, so a passage in a million documents
   makes a million rows.  Anchors of one document and leader on one diagonal form one segment.
3. **Extend.**  The leader's words around a segment are fetched once for each distinct range and compared word by
   word with the document, both ways from the anchors.  Runs of at least ``min_words`` equal words are maximal
   repeats; the words themselves are compared, so hash collisions cannot remove anything.
4. **The rest.**  A window whose anchor is shared but which differs from the leader's context may still equal a
   window of a third document.  Whether that holds depends on the window's words alone, so all its occurrences
   are in the same case; they are grouped by 128 bits of hash, from two independent hashes of each word, and compared
   with the least id of the group.  Two given windows are taken for one with a chance of 2^-128.

Defined results: a null text has no words; a text of fewer than ``min_words`` words is kept whole; rows that repeat
an id are each judged and returned, and do not count as each other's source; rows with a null id are kept whole and are no
source; of equal windows the one with the least id stays; an empty table gives an empty table.  Other columns are
carried only if named in ``carry``; one that bears a result's name comes out with ``_in`` behind it.  A text is held
whole in its task, with some 30 bytes for each word; an id that is no whole number is
refused with a TypeError before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._names import Carried, quoted, whole_numbers
from ._store import materialize, release
from ._text import gram_hashes, sliding_argmin, word_bounds, word_digests, word_hashes


def _texts(batch: pa.RecordBatch, name: str = "_text") -> Iterator[bytes]:
    for value in batch.column(name):
        yield (value.as_py() or "").encode()


def winnow(words: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) for each anchor; a window counts for the anchor it selects."""
    grams = gram_hashes(words, gram)
    chosen = sliding_argmin(grams, min_words - gram + 1)
    if not len(chosen):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
    at = chosen[first]
    return grams[at], at, first, last


def _by_anchor(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[list[int] | None]]:
    """Anchors without repeats, the first (position, first and last window) of each, and its further ones in a row."""
    a, *places = found
    rows = np.stack(places, axis=1)
    if len(np.unique(a)) == len(a):
        return a, rows, [None] * len(a)
    _, first, group = np.unique(a, return_index=True, return_inverse=True)
    more: list[list[int] | None] = [None] * len(first)
    for i in np.flatnonzero(first[group] != np.arange(len(a))).tolist():
        g = group[i]
        if more[g] is None:
            more[g] = []
        more[g] += rows[i].tolist()
    return a[first], rows[first], more


def anchors(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """``a, id, h, pos, lo, hi, more``: each text's anchors and the windows that select them.

    An anchor has one row for each text; ``more`` has (pos, lo, hi) of its further places, so that a text of one line
    over and over does not fill a join key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_by_anchor(winnow(word_hashes(text), min_words, gram)) for text in _texts(batch)]
            if not parts:
                continue
            sizes = [len(p[0]) for p in parts]
            places = np.concatenate([p[1] for p in parts])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                    pa.array(np.repeat(batch.column("_id").to_numpy(zero_copy_only=False), sizes)),
                    pa.array(np.repeat(batch.column("_h").to_numpy(zero_copy_only=False), sizes)),
                    *(pa.array(places[:, i].astype(np.int32)) for i in range(3)),
                    pa.array([m for p in parts for m in p[2]], pa.list_(pa.int32())),
                ],
                names=["a", "id", "h", "pos", "lo", "hi", "more"],
            )

    return docs.select("_id", "_h", "_text").mapInArrow(run, "a long, id long, h long, pos int, lo int, hi int, more array<int>")


def segments(found: DataFrame) -> DataFrame:
    """``id, h, leader, lh, start, end, places``: ranges of leaders' words, and where they lie in each document.

    Ids and text hashes name documents.  ``places`` holds for each diagonal the word of the document that stands at
    ``start``, and its anchors' windows.
    """
    # Both choices follow the order by id alone, so they come from one row.
    leaders = (
        found.groupBy("a")
        .agg(F.min("id").alias("leader"), F.max("id").alias("most"), F.min_by("h", "id").alias("lh"), F.min_by("pos", "id").alias("at"))
        .filter("leader < most")
        .drop("most")
    )
    others = F.transform(F.sequence(F.lit(0), F.size("more") - 3, F.lit(3)), lambda i: F.struct(F.get("more", i).alias("pos"), F.get("more", i + 1).alias("lo"), F.get("more", i + 2).alias("hi")))
    met = found.join(leaders, "a")
    once = met.select("id", "h", "leader", "lh", "at", "pos", "lo", "hi")
    again = met.filter("more is not null").select("id", "h", "leader", "lh", "at", F.inline(others))
    paired = once.unionByName(again).filter("id != leader or h != lh or pos != at").withColumn("diag", F.col("pos") - F.col("at"))
    runs = paired.groupBy("id", "h", "leader", "lh", "diag").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("windows"))
    return (
        runs.select("id", "h", "leader", "lh", (F.col("first") - F.col("diag")).alias("start"), (F.col("last") - F.col("diag")).alias("end"), F.struct("first", "windows").alias("place"))
        .groupBy("id", "h", "leader", "lh", "start", "end")
        .agg(F.collect_list("place").alias("places"))
    )


def _fetch(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leader, h, text, ranges in zip(batch.column("_id").to_pylist(), batch.column("_h").to_pylist(), _texts(batch), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                cut = [(max(0, r["start"]), r["start"], r["end"]) for r in ranges]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([leader] * len(cut), pa.int64()),
                        pa.array([h] * len(cut), pa.int64()),
                        pa.array([s for _, s, _ in cut], pa.int32()),
                        pa.array([e for *_, e in cut], pa.int32()),
                        pa.array([b" ".join(words[max(0, f) : max(0, e + min_words)]) for f, _, e in cut], pa.binary()),
                    ],
                    names=["leader", "lh", "start", "end", "words"],
                )

    return run


def equal_runs(a: Sequence[bytes], b: Sequence[bytes], least: int) -> list[tuple[int, int]]:
    """Maximal [start, end) ranges of at least ``least`` positions at which two sequences agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return [(0, n)] if n >= least else []
    ends = [-1, *(i for i in range(n) if a[i] != b[i]), n]
    return [(x + 1, y) for x, y in zip(ends, ends[1:], strict=False) if y - x - 1 >= least]


def _extend(min_words: int):
    """For each document: covered ranges (h2 null), and the windows left to compare by hash.

    A window that the document repeats has one row, its further places in ``more``, so that a text of one line over
    and over does not fill a join key.
    """

    def rows(doc: int, words: list[bytes], found: list[dict]) -> tuple[list, list]:
        covered, left = [], []
        for seg in found:
            other, skip = seg["words"].split(), max(0, -seg["start"])
            for place in seg["places"]:
                at = place["first"] + skip
                runs = [(at + x, at + y) for x, y in equal_runs(words[at : at + len(other)], other, min_words)]
                if seg["leader"] < doc:
                    covered += runs
                for w in place["windows"]:
                    lo = w["lo"]
                    for x, y in runs:  # the windows that start in [x, y - min_words] equal the leader's
                        if y - min_words < lo or x > w["hi"]:
                            continue
                        if x > lo:
                            left.append((lo, x - 1))
                        lo = y - min_words + 1
                    if lo <= w["hi"]:
                        left.append((lo, w["hi"]))
        return merged(covered), [(x, y - 1) for x, y in merged([(x, y + 1) for x, y in left])]

    def out(h1, h2, doc: int, h: int, lo, hi, more) -> pa.RecordBatch:
        n = len(lo)
        columns = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(more, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "id", "h", "lo", "hi", "more"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, h, text, found in zip(batch.column("_id").to_pylist(), batch.column("_h").to_pylist(), _texts(batch), batch.column("found").to_pylist(), strict=True):
                words = text.split()
                covered, left = rows(doc, words, found)
                h1, h2, start = [], [], []
                for x, y in left:
                    for hashes, of_word in zip((h1, h2), word_digests(words[x : y + min_words]), strict=True):
                        hashes.append(gram_hashes(of_word, min_words))
                    start.append(np.arange(x, x + len(h1[-1]), dtype=np.int32))
                if covered:
                    n = len(covered)
                    yield out([doc] * n, [None] * n, doc, h, [x for x, _ in covered], [y for _, y in covered], [None] * n)
                if start:
                    s, a, b = np.concatenate(start), np.concatenate(h1), np.concatenate(h2)
                    _, first, group = np.unique(a ^ (b << np.uint64(1)), return_index=True, return_inverse=True)
                    more: list[list[int] | None] = [None] * len(first)
                    if len(first) < len(s):
                        for i in np.flatnonzero(first[group] != np.arange(len(s))).tolist():
                            g = group[i]
                            if more[g] is None:
                                more[g] = []
                            more[g].append(int(s[i]))
                    yield out(a[first].view(np.int64), b[first].view(np.int64), doc, h, s[first], s[first] + np.int32(min_words), more)

    return run


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of [start, end) ranges, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _cut(keep_layout: bool, min_words: int):
    def one(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, str]:
        if not ranges and keep_layout:
            return len(text.split()), 0, text.decode()
        words = text.split()
        gone = sum(min(y, len(words)) - x for x, y in ranges)
        if not keep_layout:
            kept, at = [], 0
            for x, y in ranges:
                kept += words[at:x]
                at = y
            return len(words), gone, b" ".join(kept + words[at:]).decode()
        starts, _ = word_bounds(text)
        kept, at = [], 0
        for x, y in ranges:  # a removed word goes with the white space behind it
            kept.append(text[at : starts[x]])
            at = int(starts[y]) if y < len(starts) else len(text)
        return len(words), gone, b"".join([*kept, text[at:]]).decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [merged(x for r in f or () for x in [(r["lo"], r["hi"]), *((m, m + min_words) for m in r["more"] or ())]) for f in batch.column("found").to_pylist()]
            out = [one(text, r) for text, r in zip(_texts(batch), ranges, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_rest"),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in r] for r in ranges], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["_id", "_rest", "n_words", "n_removed", "kept", "removed"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, gram: int = 8, carry: Sequence[str] = (), keep_layout: bool = False) -> DataFrame:
    """Each row's id, ``n_words``, ``n_removed``, ``kept`` text and ``removed`` word ranges, then ``carry``.

    ``kept`` has the remaining words joined by one space or, with ``keep_layout``, the text as it was without the
    removed words and the white space behind each.
    """
    if not 0 < gram <= min_words:
        raise ValueError("gram must be between 1 and min_words")
    whole_numbers(docs, id_col)
    carried = Carried(carry, (id_col, "n_words", "n_removed", "kept", "removed"))
    rows = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(text_col).cast("string").alias("_text"), carried.struct().alias("_rest"))
    rows = rows.withColumn("_h", F.xxhash64("_text"))  # tells rows that share an id apart
    keyed = rows.filter("_id is not null")
    found = materialize(anchors(keyed, min_words, gram), "anchors")
    segs = materialize(segments(found), "segments")  # one choice of leaders for both uses
    release(found)
    # The three joins below share one exchange of the texts: each takes all columns of ``keyed``.
    ranges = segs.groupBy(F.col("leader").alias("_id"), F.col("lh").alias("_h")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    contexts = keyed.join(ranges, ["_id", "_h"]).mapInArrow(_fetch(min_words), "leader long, lh long, start int, end int, words binary")
    contexts = contexts.groupBy("leader", "lh", "start", "end").agg(F.first("words").alias("words"))  # repeated rows have the same
    own = segs.join(contexts, ["leader", "lh", "start", "end"]).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("leader", "start", "places", "words")).alias("found"))
    seen = materialize(keyed.join(own, ["_id", "_h"]).mapInArrow(_extend(min_words), "h1 long, h2 long, id long, h long, lo int, hi int, more array<int>"), "windows")
    release(segs)
    first = seen.filter("h2 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    hits = seen.join(first, ["h1", "h2"], "left").filter("h2 is null or least < id")
    cover = hits.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("lo", "hi", "more")).alias("found"))
    empty = F.lit(None).cast("array<struct<lo:int,hi:int,more:array<int>>>").alias("found")
    schema = f"_id long, _rest {rows.schema['_rest'].dataType.simpleString()}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"
    out = keyed.join(cover, ["_id", "_h"], "left").unionByName(rows.filter("_id is null").select("*", empty)).mapInArrow(_cut(keep_layout, min_words), schema)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept", "removed", *carried.columns("_rest"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows from every window of 50 words, for DuckDB.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS s, words FROM w WHERE len(words) >= 50),
key AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS k FROM win),
least AS (SELECT k, min(doc_id) AS d FROM key GROUP BY k HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT key.doc_id, key.s FROM key JOIN least USING (k) WHERE least.d < key.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS i FROM hit),
g AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id),
-- one list per document, in order
pos AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w WHERE len(words) > 0),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.i) AS t FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.i = gone.i GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
