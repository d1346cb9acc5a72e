"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced clustering of a bounded sample: groups are split, with a price on crowded clusters, until
none has more vectors than its share.  Every vector goes to the list of its nearest centroid and, if it lies near a
boundary, to further lists whose centroid is at most ``1 + near`` times as far (``most_copies`` lists in all).  A query
searches the lists whose centroid is at most ``1 + wide`` times as far as its nearest one, however many these are.  For
both, centroids are found by walking a graph of neighbouring centroids that each task holds in memory.

Only centroids and their graph are broadcast: about ``most_lists`` rows, whatever the table's size.  Lists of
neighbouring centroids make a cell, where a query and a vector meet once if they share a list.  A large cell is dealt
to shards and its queries to groups, so a task compares ``SHARD`` vectors with ``QUERIES`` queries at a time; what leaves
it is a row with each query's best.  Equal vectors are one member of the index with their ``k + 1`` least ids, as no query
can have more of them among its nearest, and equal queries are searched once; so a vector with millions of copies
makes no long list.  Distances are computed from differences of the original numbers in double precision; a product of
matrices only chooses which, with a margin for its rounding.

Measures on the test tables are in the README; ``recall`` compares with a search of all vectors in blocks.

Defined results: vectors that are null, zero, or hold a null, NaN or infinite number take no part, nor do rows with
a null id, nor vectors of another length than most have (ties: the shorter); of rows that share an id each searches, and none is
another's neighbour; such an id is one neighbour, at its least distance; ties go to the smaller id; fewer than ``k``
other vectors are all returned, if their lists are searched (with ``whole_below`` rows or fewer every list is); an empty table gives an
empty table; extra columns are ignored.  Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._names import quoted
from ._store import materialize

#: The sample that centroids are fitted to, and lists, at most; vectors for each list until then.
SAMPLE, MOST_LISTS, LIST_ROWS = 65_536, 4096, 128
NEAR, MOST_COPIES, WIDE = 0.1, 4, 0.15
#: Centroids that each one is linked with: the nearest, and some at random that lead far away.
LINKS, FAR_LINKS = 16, 4
#: A walk starts from so many times the square root of the centroids, spread over all.
ENTRIES = 2
#: So many of the nearest centroids are gone on from, however far they are.
BEAM = 32
SHARD, QUERIES = 8192, 2048
#: Lists of neighbouring centroids that are searched together: a query visits a cell once, whichever lists it wants there.
CELL = 32
#: With so few vectors every list is searched.
WHOLE_BELOW = 1024


# ---- centroids and their graph ---------------------------------------------------------------------------------


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by a product of matrices; not exact."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0)


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """A cluster number for each row; a crowded cluster looks farther away than it is."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.ones(k)
    for _ in range(rounds):
        d = _squares(x, centres)
        of = (d + d.mean() * 0.1 * (load - 1)).argmin(1)
        n = np.bincount(of, minlength=k)
        load = 0.5 * load + 0.5 * n * k / len(x)
        for j in np.flatnonzero(n):
            centres[j] = x[of == j].mean(0)
    return of


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of about ``lists`` clusters, none with more than 1.5 times its share of ``x``."""
    rng = np.random.default_rng(seed)
    most = max(1, -(-len(x) // lists))
    done, open_ = [], [x]
    while open_:
        part = open_.pop()
        if len(part) <= 1.5 * most:
            done.append(part.mean(0))
            continue
        k = int(min(16, max(2, round(len(part) / most))))
        of = _split(part, k, rng)
        if (of == of[0]).all():  # nothing to tell them apart by
            of = np.arange(len(part)) % k
        open_ += [part[of == j] for j in np.unique(of)]
    return np.stack(done)


def neighbour_graph(centres: np.ndarray, links: int = LINKS, far: int = FAR_LINKS, block: int = 1024) -> np.ndarray:
    """The numbers of each centroid's nearest others and of some at random; one link makes a ring, so all are reached."""
    n = len(centres)
    k = min(links, n - 1)
    out = np.random.default_rng(11).integers(0, n, (n, k + 1 + far), np.int32)
    for at in range(0, n, block):
        d = _squares(centres[at : at + block], centres)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        if k:
            out[at : at + block, :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
    out[:, k] = (np.arange(n) + 1) % n
    return out


def walk(x: np.ndarray, centres: np.ndarray, graph: np.ndarray, ratio: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, distance) of the centroids within ``1 + ratio`` times each row's nearest one, by walking.

    All rows walk at once: each goes on from the centroids that it has just met, if they are within its ratio or among
    its ``beam`` nearest so far.  Neither bound ever rises, so a centroid is looked at once.
    """
    n = len(centres)
    far = np.full((len(x), n), np.inf)
    entries = np.unique(np.linspace(0, n - 1, min(n, math.ceil(ENTRIES * math.sqrt(n)))).astype(np.int64))
    row, node = np.repeat(np.arange(len(x)), len(entries)), np.tile(entries, len(x))
    while len(row):
        d = np.sqrt(((x[row] - centres[node]) ** 2).sum(1))
        far[row, node] = d
        bound = np.full(len(x), np.inf) if ratio == math.inf else np.maximum((1 + ratio) * far.min(1), np.partition(far, beam, axis=1)[:, beam] if n > beam else np.inf)
        on = d <= bound[row]
        steps = graph[node[on]]
        row, node = np.repeat(row[on], steps.shape[1]), steps.ravel().astype(np.int64)
        pairs = np.unique((row * n + node)[far[row, node] == np.inf])
        row, node = pairs // n, pairs % n
    row, node = np.nonzero(far < np.inf if ratio == math.inf else far <= (1 + ratio) * far.min(1)[:, None])
    d = far[row, node]
    order = np.lexsort((node, d, row))
    return row[order], node[order], d[order]


def _fit(lists: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column("v")) for b in batches if b.num_rows]
        if not parts:
            return
        x = np.concatenate(parts)
        x = x[np.lexsort(x.T)]  # the same centroids in whatever order the rows come
        centres = balanced_centroids(x, lists)
        graph = neighbour_graph(centres)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(list(centres), pa.list_(pa.float64())), pa.array(list(graph), pa.list_(pa.int32()))], names=["list", "centre", "links"])

    return run


# ---- the index -------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v, key`` of the rows that take part; ``key`` is the same for equal vectors only."""
    v = F.transform(quoted(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    all_rows = rows.select(quoted(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = all_rows.filter(finite & F.exists("v", lambda x: x != 0))
    size = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if size is None:
        return good.withColumn("key", F.lit(""))
    return good.filter(F.size("v") == size["size"]).withColumn("key", F.sha2(F.array_join("v", ","), 256))


@dataclass
class Index:
    """Centroids with their graph, and the cells' members ``cell, lists, key, ids, v``."""

    centres: Broadcast
    members: DataFrame
    cells: DataFrame
    k: int


def _assign(held: Broadcast, ratio: float, most: int | None, columns: tuple[str, ...]):
    """Rows with ``v`` become a row for each cell of lists within the ratio, at most ``most`` lists (None: all)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, graph = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, node, _ = walk(_matrix(part.column("v")), centres, graph, ratio)
                if most is not None:
                    first = np.searchsorted(row, np.arange(part.num_rows))
                    ok = np.arange(len(row)) - first[row] < most
                    row, node = row[ok], node[ok]
                order = np.lexsort((node, row))
                row, node = row[order], node[order]
                cell = node // CELL
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(node.astype(np.int32)))
                taken = pa.Table.from_batches([part]).take(pa.array(row[starts])).combine_chunks()
                arrays = [pa.array(cell[starts].astype(np.int32)), lists, *[taken.column(c).combine_chunks() for c in columns]]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "lists", *columns])

    return run


def build(vectors: DataFrame, k: int = 10, sample: int = SAMPLE, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS, near: float = NEAR, most_copies: int = MOST_COPIES) -> Index | None:
    """An index of ``vec_id, v, key`` rows for searches of ``k`` at most; None for no rows."""
    spark = vectors.sparkSession
    order = Window.partitionBy("key").orderBy("vec_id")
    few = vectors.withColumn("no", F.dense_rank().over(order)).filter(F.col("no") <= k + 1)
    members = materialize(few.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    n = members.count()
    if not n:
        return None
    lists = int(min(most_lists, max(1, round(n / list_rows)), sample))
    drawn = members if n <= sample else members.filter(F.pmod(F.xxhash64("key"), F.lit(n)) < sample)
    fitted = drawn.select("v").repartition(1).mapInArrow(_fit(lists), "list int, centre array<double>, links array<int>")
    table = materialize(fitted, "centroids").toArrow().sort_by("list")  # most_lists rows at most, but for the balance
    held = spark.sparkContext.broadcast((_matrix(table.column("centre")), np.array(table.column("links").to_pylist(), np.int32)))
    posted = materialize(members.mapInArrow(_assign(held, near, most_copies, ("key", "ids", "v")), "cell int, lists array<int>, key string, ids array<long>, v array<double>"), "postings")
    sizes = posted.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    return Index(held, posted, materialize(sizes, "cells"), k)


def _held(lists: pa.ChunkedArray, base: int) -> np.ndarray:
    """For each row, which of a cell's lists it names."""
    lists = lists.combine_chunks()
    out = np.zeros((len(lists), CELL), np.float32)
    out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy() - base] = 1
    return out


def _nearest(k: int):
    """The best ``k`` ids of a cell's shard for each query of a group, among members that share a list with it."""

    def run(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        names = {"query": pa.string(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}
        if not members.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        x, y, base = _matrix(members.column("v")), _matrix(queries.column("v")), key[0].as_py() * CELL
        own, asked = (_held(t.column("lists"), base) if "lists" in t.column_names else np.ones((t.num_rows, 1), np.float32) for t in (members, queries))
        member_ids, size = members.column("ids").to_pylist(), (x**2).sum(1).max()
        query, ids, scores = [], [], []
        names_ = queries.column("query").to_pylist()
        for at in range(0, len(y), 128):
            part = y[at : at + 128]
            d = np.where(asked[at : at + 128] @ own.T > 0, _squares(part, x), np.inf)
            kth = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            row, col = np.nonzero((d <= (kth + 1e-9 * (1 + (part**2).sum(1) + size))[:, None]) & np.isfinite(d))
            exact = np.sqrt(((part[row] - x[col]) ** 2).sum(1))
            starts = np.searchsorted(row, np.arange(len(part) + 1))
            for i in range(len(part)):
                found = sorted({(float(exact[j]), m) for j in range(starts[i], starts[i + 1]) for m in member_ids[col[j]]})[:k]
                if found:
                    query.append(names_[at + i])
                    ids.append([m for _, m in found])
                    scores.append([s for s, _ in found])
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(names.items(), (query, ids, scores), strict=True)})

    return run


_FOUND = "query string, ids array<long>, scores array<double>"


def _opened(found: DataFrame) -> DataFrame:
    """``query, vec_id, score``, each id once."""
    pairs = found.select("query", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    return pairs.groupBy("query", "vec_id").agg(F.min("score").alias("score"))


def search(index: Index, queries: DataFrame, wide: float = WIDE, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``index.k`` other ids of each row of ``queries`` (``vec_id, v, key``)."""
    k = index.k
    n_lists = len(index.centres.value[0])
    asked = materialize(queries.select(F.col("vec_id").alias("query_id"), "key", "v"), "queries")
    once = asked.groupBy(F.col("key").alias("query")).agg(F.first("v").alias("v"))
    ratio = math.inf if n_lists * LIST_ROWS <= whole_below else wide
    probes = materialize(once.mapInArrow(_assign(index.centres, ratio, None, ("query", "v")), "cell int, lists array<int>, query string, v array<double>"), "probes")
    # A row for each cell: a CELL-th of most_lists.
    groups = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")).join(index.cells, "cell")
    left = index.members.join(F.broadcast(groups), "cell")
    left = left.withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = probes.join(F.broadcast(groups), "cell")
    right = right.withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    key = ["cell", "shard", "group"]
    met = left.select(*key, "lists", "ids", "v").groupBy(*key).cogroup(right.select(*key, "lists", "query", "v").groupBy(*key))
    each = _opened(met.applyInArrow(_nearest(k + 1), _FOUND))
    best = each.withColumn("no", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("no") <= k + 1)
    near = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    met = asked.join(near, F.col("key") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = met.select("query_id", F.posexplode(others).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, wide: float = WIDE, **fit) -> DataFrame:
    """The ``k`` nearest other rows of each row that ``is_query`` (over ``vec_id``) names."""
    vectors = materialize(usable(rows, id_col, vector_col), "usable")
    index = build(vectors, k, **fit)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, vectors.filter(is_query), wide)


def brute_force(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """The exact answer, by comparing every query with every row in blocks; for measuring."""
    vectors = materialize(usable(rows, id_col, vector_col), "usable")
    n, asked = vectors.count(), vectors.filter(is_query)
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards, groups = -(-n // SHARD), max(1, -(-asked.count() // QUERIES))
    left = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.array("vec_id").alias("ids"), "v")
    right = asked.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("vec_id").cast("string").alias("query"), "v")
    key = ["shard", "group"]
    found = _opened(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(k + 1), _FOUND))
    rows_ = found.select(F.col("query").cast("long").alias("query_id"), "score", "vec_id").filter("query_id != vec_id")
    best = rows_.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found; a neighbour just as near counts as one."""
    far = exact.groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    hits = found.join(far, "query_id").filter(F.col("score") <= F.col("far") * (1 + 1e-12)).count()
    total = far.agg(F.sum("n")).first()[0]
    return min(1.0, hits / total) if total else 1.0


def op11_posting_lists(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
