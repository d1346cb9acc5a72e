"""Divergence of sources within each language, by systolic rotation of compressed term vectors.

A term is a run of letters A-Z, a-z and characters beyond ASCII, with A-Z in lower case.  A language keeps the V terms
that at least ``least_docs`` of its documents hold.  In each group (language and source), and in each language as a
whole, a kept term with ``count`` occurrences has p = 1 + floor(10^9 (count + 5) / (N + 5 V)), where N is the sum of
the counts.  Two groups diverge by the sum of |p - q| over all kept terms of their language; a term marks a group by how
much its p there is over that of the whole language.

Documents are cut and counted once, in Arrow batches, with sums of bounded size before the shuffle.  Each language's kept
terms are dealt to blocks of about ``block`` terms and its groups to a ring of seats.  The groups of a seat stay in
its partition for all rounds, and their vectors of one block are packed into one compressed row.  In round r a copy of the
vectors of seat i visits seat i + r on the ring, so any two seats meet once, and a meeting gives both directions.  Each
partition keeps the best terms of its groups in a heap; only these are ranked across blocks.  All numbers are integers
and exact: the division is carried out in three steps of 1,000, in 64 bits.

Resident rows are a written table that is also cached by partition: a lost executor costs one more read of that table.
A round shuffles the visitors only.  A task holds one seat's vectors of one block, ``seat_groups`` groups at most on
average, and one visitor seat.  The number of rounds grows with the number of seats, the result with the square of a
language's sources, as asked.

Defined results: null text, language or source count as ''; every group that occurs has rows, also without terms, where
V = 0 gives value 0; a language with a single source has no pairs; ties go to the item that is less in UTF-8 bytes;
repeated rows count each time; an empty table gives an empty table; a text of any length is cut in one pass, at the cost
of its words; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._join import attach
from ._names import quoted
from ._store import materialize, release

LEAST_DOCS, TOP = 30, 50
#: Terms of a block, and groups of a seat at most; a language's ring has this many seats unless they would hold more.
BLOCK, SEAT_GROUPS, SEATS = 8192, 256, 8
#: A task's counts are sent on when there are so many of them.
HELD = 400_000

#: Bytes of UTF-8 text: A-Z to lower case, other ASCII characters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms; the term '' stands for the group itself."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def emptied() -> pa.RecordBatch:
        groups = [(k, t) for k, t in held.items()]
        n = [len(t) for _, t in groups]
        out = [
            pa.array([k[0] for (k, _), m in zip(groups, n, strict=True) for _ in range(m)], pa.string()),
            pa.array([k[1] for (k, _), m in zip(groups, n, strict=True) for _ in range(m)], pa.string()),
            pa.array([w for _, t in groups for w in t], pa.binary()).cast(pa.string()),
            pa.array([x[0] for _, t in groups for x in t.values()], pa.int64()),
            pa.array([x[1] for _, t in groups for x in t.values()], pa.int64()),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary()), strict=True):
            group = held.setdefault((lang, source), {})
            before = len(group)
            group.setdefault(b"", [0, 0])[1] += 1
            for word, n in Counter(terms(text.as_py())).items():
                x = group.get(word)
                if x is None:
                    group[word] = [n, 1]
                else:
                    x[0] += n
                    x[1] += 1
            size += len(group) - before
            if size > HELD:
                yield emptied()
                size = 0
    if held:
        yield emptied()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs`` of each group, and a row with term '' for the group itself.

    Rows lie together by language and term, so further sums over a language's term need no shuffle.
    """
    filled = docs.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    parts = filled.mapInArrow(_count, _COUNTS)
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact for totals below 9 * 10^15."""
    q, r, d = np.zeros(len(count), np.int64), count.astype(np.int64) + 5, total + 5 * kept
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // d, r % d
    return q + 1


def _packed(rows: list[tuple[bytes, bytes, np.ndarray, np.ndarray]]) -> bytes:
    """Places and counts of a seat's groups in one compressed string: lengths, steps between places, counts."""
    sizes = np.array([len(p) for *_, p, _ in rows], np.int32)
    steps = [np.diff(p, prepend=0).astype(np.int32) for *_, p, _ in rows]
    return zlib.compress(b"".join([sizes.tobytes(), *[s.tobytes() for s in steps], *[n.astype(np.int64).tobytes() for *_, n in rows]]), 1)


def _unpacked(data: bytes, groups: int) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = zlib.decompress(data)
    sizes = np.frombuffer(raw, np.int32, groups)
    whole = int(sizes.sum())
    steps = np.frombuffer(raw, np.int32, whole, 4 * groups)
    counts = np.frombuffer(raw, np.int64, whole, 4 * groups + 4 * whole)
    out, at = [], 0
    for n in sizes.tolist():
        out.append((np.cumsum(steps[at : at + n]), counts[at : at + n]))
        at += n
    return out


_SEATED = "kind string, lang string, block int, seat int, seats int, width int, kept long, sources array<string>, totals array<long>, vectors binary, source string, term string, value long"


def _seat(top: int):
    """The resident row of a seat's block, and the best terms of each of its groups there."""

    def run(key: tuple, groups: pa.Table, counts: pa.Table) -> pa.Table:
        lang, block, seat = (k.as_py() for k in key)
        if not groups.num_rows:
            return pa.table({f: pa.array([], t) for f, t in _ARROW.items()})
        groups = groups.sort_by("source")
        g = groups.to_pydict()
        held = {s: ([], [], [], []) for s in g["source"]}
        counts = counts.sort_by("place")
        for s, *row in zip(*(counts.column(c).to_pylist() for c in ("source", "place", "n", "whole", "term")), strict=True):
            for part, x in zip(held[s], row, strict=True):
                part.append(x)
        packed, best = [], []
        kept = g["kept"][0]
        for source, total, whole_total in zip(g["source"], g["total"], g["whole_total"], strict=True):
            places, n, whole, names = held[source]
            n = np.array(n, np.int64)
            packed.append((lang, source, np.array(places, np.int64), n))
            if names:
                value = share(n, total, kept) - share(np.array(whole, np.int64), whole_total, kept)
                over = [(-int(value[i]), names[i].encode()) for i in np.flatnonzero(value > 0)]
                best += [(source, t.decode(), -v) for v, t in heapq.nsmallest(top, over)]
        resident = ("seat", lang, block, seat, g["seats"][0], g["width"][0], kept, g["source"], g["total"], _packed(packed), None, None, None)
        rows = [resident, *[("term", lang, block, seat, None, None, None, None, None, None, *x) for x in best]]
        return pa.table({f: pa.array([r[i] for r in rows], t) for i, (f, t) in enumerate(_ARROW.items())})

    return run


_ARROW = {
    "kind": pa.string(), "lang": pa.string(), "block": pa.int32(), "seat": pa.int32(), "seats": pa.int32(), "width": pa.int32(), "kept": pa.int64(),
    "sources": pa.list_(pa.string()), "totals": pa.list_(pa.int64()), "vectors": pa.binary(), "source": pa.string(), "term": pa.string(), "value": pa.int64(),
}


def _shares(row: dict, side: str) -> Iterator[tuple[str, np.ndarray]]:
    """Each group's p over all places of the block."""
    zero = np.zeros(1, np.int64)
    totals = row[f"{side}_totals"]
    for source, total, (places, n) in zip(row[f"{side}_sources"], totals, _unpacked(row[f"{side}_vectors"], len(totals)), strict=True):
        p = np.full(row["width"], share(zero, total, row["kept"])[0] if row["kept"] else 0, np.int64)
        if len(places):
            p[places] = share(n, total, row["kept"])
        yield source, p


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each pair of groups of a resident seat and its visitor; in round 0 a seat meets itself."""
    for batch in batches:
        for row in batch.to_pylist():
            own = list(_shares(row, "own"))
            if not own:
                continue
            names, matrix = [s for s, _ in own], np.stack([p for _, p in own])
            a, b, f = [], [], []
            for i, (source, p) in enumerate(own if row["round"] == 0 else _shares(row, "peer")):
                first = i + 1 if row["round"] == 0 else 0
                values = np.abs(matrix[first:] - p).sum(axis=1).tolist()
                for other, value in zip(names[first:], values, strict=True):
                    a += [source, other]
                    b += [other, source]
                    f += [value, value]
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(f, pa.int64())], names=["lang", "source", "item", "value"])


def _meetings(resident: DataFrame, round_: int) -> DataFrame:
    """The pairs of groups whose seats meet in a round: the visitor comes from ``round_`` seats before."""
    own = ["lang", "block", "seat"]
    here = resident.filter(F.lit(round_) * 2 <= F.col("seats"))
    if round_ == 0:
        met = here.select("lang", "width", "kept", *[F.col(c).alias(f"own_{c}") for c in ("sources", "totals", "vectors")])
    else:
        visitors = here.select("lang", "block", F.pmod(F.col("seat") + round_, F.col("seats")).alias("seat"), *[F.col(c).alias(f"peer_{c}") for c in ("sources", "totals", "vectors")])
        # Half-way round the ring both seats of a pair would visit each other; the lower half stays at home then.
        host = here.filter((F.lit(2 * round_) < F.col("seats")) | (F.col("seat") < round_))
        met = host.join(visitors.hint("shuffle_merge"), own).select("lang", "width", "kept", *[F.col(c).alias(f"own_{c}") for c in ("sources", "totals", "vectors")], "peer_sources", "peer_totals", "peer_vectors")
    return met.withColumn("round", F.lit(round_)).mapInArrow(_meet, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, seat_groups: int = SEAT_GROUPS, seats: int = SEATS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's distances from the other sources of its language, and the
    ``top`` terms in which it is over the language."""
    spark = docs.sparkSession
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "counts")
    whole = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(whole, "kept")
    groups = counts.filter("term = ''").select("lang", "source")
    # One row for each language: its kept terms, blocks, groups and seats.
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("whole_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left").fillna(0, ["kept", "whole_total"])
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block)).cast("int"))
    langs = langs.withColumn("seats", F.greatest(F.least(F.lit(seats), F.ceil(F.col("groups") / 2)), F.ceil(F.col("groups") / seat_groups)).cast("int"))
    langs = materialize(langs, "langs")

    dealt = attach(kept, langs.select("lang", "blocks", F.greatest("kept", "groups").alias("n_rows")), "lang", "n_rows")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).select("lang", "term", "block", "place", "whole")
    held = materialize(counts.filter("term != ''").drop("docs").join(placed, ["lang", "term"]), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    widths = placed.groupBy("lang", "block").agg(F.count("*").cast("int").alias("width"))

    seated = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    seated = attach(seated, langs.withColumnRenamed("groups", "n_rows"), "lang", "n_rows")
    seat = F.pmod(F.xxhash64("source"), F.col("seats")).cast("int")
    seated = seated.select("lang", "source", "total", "kept", "whole_total", "seats", seat.alias("seat"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    seated = seated.join(widths, ["lang", "block"], "left").fillna(0, ["width"])
    rows = attach(held, langs.select("lang", "seats", F.greatest("kept", "groups").alias("n_rows")), "lang", "n_rows").withColumn("seat", seat)
    key = ["lang", "block", "seat"]
    packed = seated.groupBy(*key).cogroup(rows.select(*key, "source", "place", "n", "whole", "term").groupBy(*key)).applyInArrow(_seat(top), _SEATED)
    packed = materialize(packed, "seats")

    resident = packed.filter("kind = 'seat'").select("lang", "block", "seat", "seats", "width", "kept", "sources", "totals", "vectors")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = resident.repartition(partitions, *key).persist()
    rounds = (langs.agg(F.coalesce(F.max("seats"), F.lit(0))).first()[0]) // 2
    parts = [materialize(_meetings(resident, r), "meetings") for r in range(rounds + 1)]
    resident.unpersist()
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    marks = packed.filter("kind = 'term'").select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = marks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
    out = materialize(ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "audit")
    release(counts, kept, langs, held, packed, *parts)
    return out


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
r AS (SELECT no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM r GROUP BY 1, 2 HAVING count(DISTINCT no) >= 30),
c AS (SELECT r.lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM r JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM k GROUP BY 1),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 50"""
