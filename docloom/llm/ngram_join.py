"""Near-duplicate join on word n-grams: chosen-path search, then exact Jaccard similarity.

Two texts are linked if the Jaccard similarity of their sets of ``k``-word shingles is at least ``threshold``.

1. Every text becomes a set of 64-bit shingle hashes (of mixed word hashes, so two given shingles are taken for one with
   a chance of 2^-64).  Texts with equal sets, by a 128-bit hash, form one node; copies are never compared with each other.
2. **Chosen paths.**  In each run a set of n shingles picks about ``branching`` of them, by a hash of run and shingle
   under ``branching / n``; sets that pick the same shingle fall in one bucket.  Two sets at the threshold agree on a
   pick with probability ``1 - exp(-threshold * branching)`` or more, and ``target_recall`` sets the number of runs.
   Buckets of over ``bucket`` sets split again, each set picking about ``deeper`` further shingles of its sample along
   its path.  If a set's pick is picked by ``1 / deeper`` of its bucket or more, on the average over about ``PROBE`` of
   its sets, paths would multiply from level to level and part nothing: such a bucket is compared in full, block by block.
   A split can part a pair, so the sets of split buckets take part in further runs, as many as keep a pair
   with probability ``target_recall`` through the number of splits that was needed.
   What is still larger after ``max_depth`` levels is compared in full as well: an exact way for the rest.
3. Small buckets are compared by brute force, first on a bounded sample of each set (its least hashes; the estimate
   may be 4.5 standard deviations low), then exactly on the whole texts of those that remain.  A pair that meets in
   several buckets counts in the first one only.
4. A bucket gives each set's number of links and a spanning forest of the links, never all pairs, so its output
   grows with its sets.  Classes are the connected components of the forests.

Defined results: texts without words (null, empty, white space) link to nothing; a text of fewer than ``k`` words has
one shingle, all its words; rows that share an id each get the class of their own text; rows with a null id get a null
class and no links; ties give the least id; an empty table gives an empty table; other columns are ignored, whatever
their names.  A bucket holds at most ``bucket`` whole texts in memory, so very long texts call for a smaller one; an id that is no whole number is
refused with a TypeError before anything runs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._names import quoted, whole_numbers
from ._store import materialize, release
from ._text import mix, shingle_set, word_hashes

#: Shingles of a set that are kept for choosing paths and for estimates, about.
SAMPLE = 64
#: Sets of a large bucket, about, whose picks tell whether a split helps; both ways keep the pairs.
PROBE = 512
#: Keys of three numbers that are broadcast at most, some 100 MB.
MOST_BROADCAST = 1_000_000
_RUN = np.uint64(0xD6E8FEB86659FD93)
_PATH = np.uint64(0xA0761D6478BD642F)


def runs_for(target_recall: float, threshold: float, branching: float) -> int:
    """Runs after which a pair at the threshold is missed with probability ``1 - target_recall`` at most."""
    return max(1, math.ceil(math.log(1 - target_recall) / (-threshold * branching)))


def lost(runs: int, threshold: float, branching: float, deeper: float, splits: int) -> float:
    """The probability that a pair at the threshold, one set inside the other, meets in no run after so many splits.

    All splits draw from one sample, so the chance is a mean over the number of shared shingles in it.
    """
    mean, total = threshold * SAMPLE, 0.0
    for shared in range(math.ceil(mean + 12 * math.sqrt(mean)) + 1):
        kept = 1.0
        for _ in range(splits):
            kept = 1 - (1 - min(1.0, deeper / SAMPLE) * kept) ** shared
        total += math.exp(shared * math.log(mean) - mean - math.lgamma(shared + 1) - runs * threshold * branching * kept)
    return total


def runs_through(splits: int, target_recall: float, threshold: float, branching: float, deeper: float) -> int:
    """Runs for sets whose buckets split so often; what the first runs alone miss counts against the target."""
    first = runs_for(target_recall, threshold, branching)
    if not splits:
        return first
    rest = 1 - target_recall - math.exp(-first * threshold * branching)
    runs = first
    while lost(runs, threshold, branching, deeper, splits) > max(rest, (1 - target_recall) / 10):
        runs += 1
    return runs


def sample_limit(n: int) -> float:
    """The sample of a set of n shingles has the 32-bit hashes below this."""
    return 2.0**32 * min(1.0, SAMPLE / max(n, 1))


def _picks(tokens: np.ndarray, salt: np.uint64, rate: float) -> np.ndarray:
    """Bucket ids under ``salt`` for those tokens that a set picks with probability ``rate``."""
    with np.errstate(over="ignore"):
        h = mix((tokens.astype(np.uint64) + np.uint64(1)) * _PATH ^ salt)
    return h if rate >= 1 else mix(h[h < np.uint64(int(rate * (2**64 - 1)))])


def describe(text: bytes, k: int, runs: int, branching: float) -> tuple[int, int, int, bytes, list[np.ndarray]]:
    """Two halves of the set's 128-bit hash, its size, its sample and its first buckets in each run."""
    shingles = shingle_set(word_hashes(text), k)
    n = len(shingles)
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 2**64)
    if not n:
        return 0, 0, 0, b"", []
    tokens = (shingles >> np.uint64(32)).astype(np.uint32)
    tokens = np.unique(tokens[: np.searchsorted(tokens, sample_limit(n))])
    with np.errstate(over="ignore"):
        salts = [mix(np.array([run + 1], np.uint64) * _RUN)[0] for run in range(runs)]
    return high - 2**63, low - 2**63, n, tokens.tobytes(), [_picks(shingles, s, branching / n) for s in salts]


def _describe(k: int, runs: int, branching: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe((x.as_py() or "").encode(), k, runs, branching) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    batch.column("_h"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.binary()),
                    pa.array([[x.view(np.int64) for x in r[4]] for r in rows], pa.list_(pa.list_(pa.int64()))),
                ],
                names=["id", "h", "s1", "s2", "n", "sample", "buckets"],
            )

    return run


def _split(deeper: float):
    """The next buckets of each set along its path, with the bucket that they come from."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            came, out, sizes = [batch.column(c).to_numpy() for c in ("rep", "b")], [], []
            for b, n, sample in zip(batch.column("b").to_numpy(), batch.column("n").to_numpy(), batch.column("sample"), strict=True):
                tokens = np.frombuffer(sample.as_buffer(), np.uint32)
                out.append(_picks(tokens, mix(np.array([b]).view(np.uint64) ^ _RUN)[0], deeper / min(n, SAMPLE)))
                sizes.append(len(out[-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(pa.array(np.repeat(x, sizes)) for x in came)], names=["b", "rep", "parent"])

    return run


def common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists (without repeats) have in common, as a matrix.

    Values in a sixteenth of the lists or more go through a matrix product, others through their pairs.
    """
    m = len(lists)
    out = np.zeros((m, m), np.int32)
    if not m or not sum(map(len, lists)):
        return out
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    _, inverse, df = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    owner = owner[np.argsort(inverse, kind="stable")]  # by value, then list
    start = np.cumsum(df) - df
    wide = np.flatnonzero(df >= max(2, m / 16))
    for i in range(0, len(wide), 2048):
        part = wide[i : i + 2048]
        dense = np.zeros((m, len(part)), np.float32)
        for j, (s, n) in enumerate(zip(start[part], df[part], strict=True)):
            dense[owner[s : s + n], j] = 1
        out += (dense @ dense.T).astype(np.int32)
    for n in np.unique(df[(df >= 2) & (df < m / 16)]):
        rows = owner[start[df == n][:, None] + np.arange(n)]
        for x in range(n):
            np.add.at(out, (rows[:, x][:, None], rows), 1)
    return out


def _owned(leaves: list[np.ndarray], here: int) -> np.ndarray:
    """Which pairs share no bucket that comes before this one."""
    return common([x[x < here] for x in leaves]) == 0


def likely(n: np.ndarray, samples: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by their sizes and samples."""
    shared = common(samples)
    limit = np.array([sample_limit(x) for x in n])
    below = np.stack([np.searchsorted(s, limit) for s in samples]).astype(np.int32)  # [y, x]: of y's sample, those below x's limit
    own = np.diag(below)
    out = np.empty(shared.shape, bool)
    for i in range(0, len(n), 256):  # blocks of rows keep the intermediate arrays small
        b = slice(i, i + 256)
        small, large = np.minimum(n[b, None], n), np.maximum(n[b, None], n)
        size = np.where(n[b, None] >= n, own[b, None] + below[:, b].T, own + below[b])
        union = np.maximum(size - shared[b], 1)
        slack = np.where(large > SAMPLE, 4.5 * np.sqrt(threshold * (1 - threshold) / union), 0) + 1e-9
        out[b] = (small >= threshold * large - 1e-9) & (shared[b] / union >= threshold - slack)
    np.fill_diagonal(out, False)
    return out


def exact(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold."""
    n = np.array([len(s) for s in sets])
    shared = common(sets)
    return (shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9) & ~np.eye(len(n), dtype=bool) & (n > 0)[:, None]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` connects, fewer than there are rows."""
    seen, edges = np.zeros(len(linked), bool), []
    for root in range(len(linked)):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            edges += [(at, x) for x in new]
            stack += new.tolist()
    return edges


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, from rows that are sorted by bucket ``b``."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        b = table.column("b").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1]) if len(b) else np.zeros(1, int)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(x, y - x)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _longs(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in column.to_pylist()]


def _candidates(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_b: list[int] = []
        out_rep: list[int] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_rep, pa.int64())], names=["b", "rep"])
            out_b.clear()
            out_rep.clear()
            return batch

        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            rep, n, here = group.column("rep").to_numpy(), group.column("n").to_numpy(), group.column("b")[0].as_py()
            if n.min() < threshold * n.max() - 1e-9 and len(n) == 2:
                continue
            samples = [np.frombuffer(x, np.uint32) for x in group.column("sample").to_pylist()]
            found = likely(n, samples, threshold)
            some = np.flatnonzero(found.any(axis=1))
            if len(some):
                leaves = _longs(group.column("leaves").take(pa.array(some)))
                some = some[(found[np.ix_(some, some)] & _owned(leaves, here)).any(axis=1)]
                out_b += [here] * len(some)
                out_rep += rep[some].tolist()
            if len(out_b) > 10_000:
                yield flush()
        yield flush()

    return run


def _verify(k: int, threshold: float):
    """``u, v, links``: a forest's edges (links 0), and each set's links that this bucket owns (v null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rep = group.column("rep").to_numpy()
            if len(rep) < 2:
                continue
            sets = [shingle_set(word_hashes(x.as_py().encode()), k) for x in group.column("_text")]
            linked = exact(sets, threshold) & _owned(_longs(group.column("leaves")), group.column("b")[0].as_py())
            edges, links = forest(linked), linked.sum(axis=1)
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*rep[[x for x, _ in edges]].tolist(), *rep[has].tolist()] if edges else rep[has].tolist(), pa.int64()),
                    pa.array([*(int(rep[y]) for _, y in edges), *[None] * len(has)], pa.int64()),
                    pa.array([*[0] * len(edges), *links[has].tolist()], pa.int64()),
                ],
                names=["u", "v", "links"],
            )

    return run


def _by_bucket(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("b").sortWithinPartitions("b").mapInArrow(run, schema)


def _blocks(large: DataFrame, bucket: int) -> DataFrame:
    """``b, rep``: all pairs of blocks, of half a bucket each, of the buckets in ``large`` (b, rep, size)."""
    blocks = large.withColumn("blocks", F.ceil(F.col("size") * 2 / bucket).cast("long"))
    pairs = blocks.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return pairs.select(F.xxhash64("b", F.least("i", "j"), F.greatest("i", "j")).alias("b"), "rep")


def _picked(large: DataFrame, sets: DataFrame, deeper: float) -> DataFrame:
    """``b, rep, parent``: the further buckets of each set in ``large`` (b, rep)."""
    return large.select("b", "rep").join(sets.select("rep", "sample", "n"), "rep").mapInArrow(_split(deeper), "b long, rep long, parent long")


def _probe(large: DataFrame) -> DataFrame:
    """``b, rep``: about ``PROBE`` sets of each bucket of ``large`` (b, rep, size)."""
    part = F.pmod(F.xxhash64("rep", F.lit(PROBE)), F.lit(1 << 30))
    return large.filter(part.cast("double") * F.col("size") < float(PROBE << 30)).select("b", "rep")


def _alike(probe: DataFrame, sets: DataFrame, deeper: float) -> DataFrame:
    """``b``: the buckets that a split would not make smaller, from some of their sets."""
    n = probe.groupBy("b").agg(F.count("*").alias("n"))
    met = _picked(probe, sets, deeper).groupBy("parent", "b").agg(F.count("*").alias("c")).groupBy("parent")
    met = met.agg(F.sum("c").alias("picks"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs")).withColumnRenamed("parent", "b")
    return met.join(n, "b").filter(F.col("pairs") * deeper >= F.col("picks") * (F.col("n") - 1)).filter("n > 1").select("b")


def _levels(level: DataFrame, sets: DataFrame, bucket: int, deeper: float, max_depth: int) -> tuple[list[DataFrame], DataFrame, int, list[DataFrame]]:
    """The buckets to compare from the first ones in ``level``, the sets whose first buckets split, how often, and the
    tables written on the way."""
    done: list[DataFrame] = []
    between: list[DataFrame] = []
    split = sets.select("rep").limit(0)
    for depth in range(max_depth + 1):
        size = level.groupBy("b").agg(F.count("*").alias("size")).filter("size > 1")
        level = materialize(level.join(size, "b"), f"level{depth}")
        between.append(level)
        done.append(level.filter(F.col("size") <= bucket).select("b", "rep"))
        large = level.filter(F.col("size") > bucket)
        if large.isEmpty():
            break
        if depth == max_depth:
            done.append(_blocks(large, bucket))
            break
        probe = materialize(_probe(large), f"probe{depth}")
        alike = materialize(_alike(probe, sets, deeper), f"alike{depth}")
        done.append(_blocks(large.join(alike, "b", "left_semi"), bucket))
        large = large.join(alike, "b", "left_anti")
        if not depth:
            split = large.select("rep").distinct()
        level = materialize(_picked(large, sets, deeper).select("b", "rep"), f"picks{depth}")
        between += [probe, alike, level]
        if level.isEmpty():
            break
    return done, split, depth, between


def _leaves(sets: DataFrame, runs: Callable[[int], int], bucket: int, deeper: float, max_depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """``b, rep``: the buckets of two sets or more that are compared by brute force, and the tables that they come from.

    ``runs`` has the number of runs for a number of splits; runs beyond the first are for sets of split buckets.
    """
    chosen, before, upto, splits, done, between = sets, 0, runs(0), 0, [], []
    while before < upto:
        level = chosen.select(F.explode(F.flatten(F.slice("buckets", before + 1, upto - before))).alias("b"), "rep")
        more, split, depth, tables = _levels(level, sets, bucket, deeper, max_depth)
        done += more
        between += tables
        if not before and depth:  # without a split the runs are those that there were
            chosen = materialize(sets.join(split, "rep", "left_semi"), "split")
            between.append(chosen)
        splits = max(splits, depth)
        before, upto = upto, runs(splits)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, between


def _chosen_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``rep, _text``: the text of one row of each set in ``keys`` (rep, id, h).

    Up to ``MOST_BROADCAST`` keys, three numbers each, go to the texts; beyond that all texts are shuffled to them.
    """
    few = keys.count() <= MOST_BROADCAST
    keys = keys.select("rep", F.col("id").alias("_id"), F.col("h").alias("_h"))
    met = texts.join(F.broadcast(keys) if few else keys, ["_id", "_h"])
    return met.groupBy("rep").agg(F.first("_text").alias("_text"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.9999,
    branching: float = 4.0,
    deeper: float = 2.0,
    bucket: int = 2048,
    max_depth: int = 6,
    with_hash: bool = False,
) -> DataFrame:
    """A row for each row of ``docs``: its id, ``class_id``, ``n_links`` and ``n_copies``.

    ``class_id`` is the least id that is reached over links, ``n_links`` the number of different sets of shingles
    that the document's set is linked to, ``n_copies`` the number of other rows with the same set.  ``with_hash`` adds
    ``text_hash``, the row's xxhash64, and ``class_hash``, that of the row which stands for its class.
    """
    whole_numbers(docs, id_col)
    texts = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(text_col).cast("string").alias("_text"))
    texts = texts.withColumn("_h", F.xxhash64("_text"))  # tells rows that share an id apart
    runs = functools.cache(lambda splits: runs_through(splits, target_recall, threshold, branching, deeper))
    run = _describe(k, max(map(runs, range(max_depth + 1))), branching)
    described = materialize(texts.filter("_id is not null").mapInArrow(run, "id long, h long, s1 long, s2 long, n long, sample binary, buckets array<array<long>>"), "sets")
    sets = described.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "h")).alias("least"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sample").alias("sample"), F.first("buckets").alias("buckets"))
    # The number of a set is drawn once, as the table is written.
    sets = materialize(sets.select("s1", "s2", "least.id", "least.h", "rows", "n", "sample", "buckets", F.monotonically_increasing_id().alias("rep")), "representatives")
    wide, described = described, materialize(described.select("id", "h", "s1", "s2", "n"), "documents")
    release(wide)
    found, between = _leaves(sets, runs, bucket, deeper, max_depth)
    leaves = materialize(found, "leaves")
    release(*between)
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("b")).alias("leaves"))
    compared = leaves.distinct().join(sets.select("rep", "n", "sample").join(lists, "rep"), "rep")
    flagged = materialize(_by_bucket(compared, _candidates(threshold), "b long, rep long"), "candidates")
    keys = materialize(flagged.select("rep").distinct().join(sets.select("rep", "id", "h"), "rep"), "needed")
    with_text = flagged.join(lists, "rep").join(_chosen_texts(texts, keys), "rep")
    verified = materialize(_by_bucket(with_text, _verify(k, threshold), "u long, v long, links long"), "links")
    roots = components(verified.filter("v is not null"))
    links = verified.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("n_links"))
    members = roots.select(F.col("node").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    heads = members.join(sets.select("rep", "id", "h"), "rep").groupBy("root").agg(F.min(F.struct("id", "h")).alias("head"))
    classes = members.join(heads, "root").select("rep", "head")
    facts = sets.select("s1", "s2", "rep", "id", "h", "rows").join(classes, "rep", "left").join(links, "rep", "left")
    head = F.coalesce("head", F.struct("id", "h"))
    facts = facts.select("s1", "s2", head["id"].alias("class_id"), head["h"].alias("class_hash"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    columns = ["id", "class_id", "n_links", "n_copies", F.col("h").alias("text_hash"), "class_hash"]
    out = described.filter("n > 0").select("id", "h", "s1", "s2").join(facts, ["s1", "s2"]).select(*columns)
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    none = [zero.alias("n_links"), zero.alias("n_copies")]
    alone = described.filter("n = 0").select("id", F.col("id").alias("class_id"), *none, F.col("h").alias("text_hash"), F.col("h").alias("class_hash"))
    nameless = texts.filter("_id is null").select(F.col("_id").alias("id"), null.alias("class_id"), *none, F.col("_h").alias("text_hash"), F.col("_h").alias("class_hash"))
    every = out.unionByName(alone).unionByName(nameless)
    return every.select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies", *["text_hash", "class_hash"] * with_hash)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows from all pairs that share a shingle, for DuckDB.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT h, min(doc_id) AS rep, max(n) AS n, count(*) AS copies FROM k GROUP BY h),
t AS (SELECT s.doc_id AS rep, s.g, r.n FROM s JOIN r ON r.rep = s.doc_id),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c, max(a.n) AS na, max(b.n) AS nb FROM t a JOIN t b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE c >= 0.8 * (na + nb - c) - 1e-9),
reach(x, root) AS (SELECT rep, rep FROM r UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.x),
c AS (SELECT x AS rep, min(root) AS class_id FROM reach GROUP BY x),
d AS (SELECT x AS rep, count(*) AS links FROM e GROUP BY x)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, CAST(coalesce(d.links, 0) AS BIGINT) AS n_links, CAST(coalesce(r.copies - 1, 0) AS BIGINT) AS n_copies
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN r USING (h) LEFT JOIN c USING (rep) LEFT JOIN d USING (rep)
"""
