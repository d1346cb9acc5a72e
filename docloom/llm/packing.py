"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Longer documents than the largest length are cut into pieces of that length and a rest.  Pieces are dealt to shards of
about ``shard_rows`` pieces by the number of their row, so each task packs a bounded number however large the table is
and whatever the rows hold; a shard of thousands of pieces packs nearly as tightly as all of them.  Within a shard:

* pieces go by falling length (ties by id and piece) into the open bin with the least room that still fits them;
* if none fits, a bin opens in the length that the shard's plan has for pieces of this class (those between two
  permitted lengths);
* the lengths are optimised jointly: a plan is a choice of one length for each class, and the plan of the least total
  cost is taken, by a search over all plans that leaves out those whose lower bound is no better than the best so far;
* at the end each bin shrinks to the least permitted length that holds its contents, and this is what costs count.

The cost of a sequence of length c is ``c + c * c / quadratic + overhead``: linear work, attention, and a fixed part.

Defined results: documents without words (null, empty, white space) need no place and get null bins; repeated rows are
each placed, and pieces of one length by id (nulls last), then piece; a null id is placed like any other; an empty table
gives an empty table; a very long text becomes many pieces, and only numbers reach the tasks that pack; extra columns are
ignored or carried if named, and one that bears a result's name comes out with ``_in`` behind it; an id that is no whole number is
refused with a TypeError before anything runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import Carried, quoted, whole_numbers
from ._store import materialize

#: Permitted sequence lengths, in words.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: The number of plans is the factorial of the number of lengths.
MOST_LENGTHS = 6
SHARD_ROWS = 16384


def cost(length: int, quadratic: float = 16384.0, overhead: float = 64.0) -> float:
    return length + length * length / quadratic + overhead


class _Bins:
    """Open bins; ``room`` has a bit for each amount of room in one of them."""

    def __init__(self, other: _Bins | None = None):
        self.placed: list[tuple[int, int]] = list(other.placed) if other else []
        self.used: list[int] = list(other.used) if other else []
        self.room: int = other.room if other else 0
        self.open: dict[int, list[int]] = {k: list(v) for k, v in other.open.items()} if other else {}

    def fill(self, sizes: Sequence[int], opening: int) -> int:
        """Place pieces by best fit; the number of bins of length ``opening`` that it took."""
        opened, room, open_, used, placed = 0, self.room, self.open, self.used, self.placed
        for size in sizes:
            fits = room >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                bins = open_[left]
                at = bins.pop()
                if not bins:
                    room &= ~(1 << left)
            else:
                at, left = len(used), opening
                used.append(0)
                opened += 1
            placed.append((at, used[at]))
            used[at] += size
            if left > size:
                open_.setdefault(left - size, []).append(at)
                room |= 1 << (left - size)
        self.room = room
        return opened

    def free(self) -> int:
        return sum(left * len(bins) for left, bins in self.open.items())


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = cost) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) for each size; sizes must be in falling order and fit the largest length."""
    lengths = sorted(set(lengths))
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"at most {MOST_LENGTHS} lengths: all plans are searched")
    costs = [cost(c) for c in lengths]
    cheapest = min(x / c for x, c in zip(costs, lengths, strict=True))
    classes: list[list[int]] = [[] for _ in lengths]
    for size in sizes:
        classes[bisect_left(lengths, size)].append(size)
    behind = [sum(map(sum, classes[:i])) for i in range(len(lengths))]
    best: tuple[float, _Bins] = (float("inf"), _Bins())

    def total(bins: _Bins) -> float:
        return sum(costs[bisect_left(lengths, u)] for u in bins.used)

    def search(at: int, bins: _Bins) -> None:
        nonlocal best
        while at >= 0 and not classes[at]:
            at -= 1
        so_far = total(bins)  # never falls as more is placed
        if so_far + (max(0, behind[at] + sum(classes[at]) - bins.free()) * cheapest if at >= 0 else 0) >= best[0]:
            return
        if at < 0:
            best = so_far, bins
            return
        for i in sorted(range(at, len(lengths)), key=lambda i: (costs[i] / lengths[i], i)):
            more = _Bins(bins)
            opened = more.fill(classes[at], lengths[i])
            search(at - 1, more)
            if not opened:
                break  # the other lengths give the same

    search(len(lengths) - 1, _Bins())
    used = best[1].used
    return [(b, lengths[bisect_left(lengths, used[b])], offset) for b, offset in best[1].placed]


def pieces(docs: DataFrame, id_col: str, n_words: Column, longest: int, rest: Column, text_col: str | None = None) -> DataFrame:
    """``id, piece, start, size, rest, text``: one row for each piece; documents without words have one of size 0.

    ``text`` is the piece's own part of ``text_col``, or null without one.
    """
    whole_numbers(docs, id_col)
    text = quoted(text_col).cast("string") if text_col else F.lit(None).cast("string")
    rows = docs.select(quoted(id_col).cast("long").alias("id"), n_words.cast("long").alias("n"), rest.alias("rest"), text.alias("text"))
    last = F.greatest(F.ceil(F.col("n") / longest), F.lit(1)).cast("int") - 1
    if text_col:
        texts = F.when(last == 0, F.array("text")).otherwise(piece_texts(F.col("text"), last, longest))
        cut = rows.select("id", "n", "rest", F.posexplode(texts).alias("piece", "text"))
    else:
        cut = rows.select("id", "n", "rest", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "text")
    start = F.col("piece").cast("long") * longest
    return cut.select("id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).cast("int").alias("size"), "rest", "text")


def _pack_shard(lengths: Sequence[int]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending"), ("no", "ascending")])
        placed = pack(table.column("size").to_pylist(), lengths)
        shard = table.column("shard").to_pylist()
        return pa.table(
            {
                "no": table.column("no"),
                "bin": pa.array([(s << 32) + b for s, (b, _, _) in zip(shard, placed, strict=True)], pa.int64()),
                "capacity": pa.array([c for _, c, _ in placed], pa.int32()),
                "offset": pa.array([o for *_, o in placed], pa.int32()),
            }
        )

    return run


def place(
    docs: DataFrame, id_col: str = "doc_id", n_words: Column | None = None, lengths: Sequence[int] = LENGTHS, shard_rows: int = SHARD_ROWS, carry: Sequence[str] = (), text_col: str | None = None
) -> DataFrame:
    """Where each piece goes: ``id_col, piece, start_word, n_words, bin_id, capacity, offset``, then ``carry``.

    ``n_words`` is the length to pack by, else the words of ``text``.  With ``text_col`` each row also has the piece's
    part of that text as ``text``.
    """
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) if n_words is None else n_words
    carried = Carried(carry, (id_col, "piece", "start_word", "n_words", "bin_id", "capacity", "offset", *["text"] * bool(text_col)))
    cut = pieces(docs, id_col, n_words, max(lengths), carried.struct(), text_col)
    # Texts are read and counted once; a row's number is drawn once, as the table is written.
    cut = materialize(cut.withColumn("no", F.monotonically_increasing_id()), "pieces")
    filled = cut.filter("size > 0").select("no", "id", "piece", "size")
    shards = max(1, -(-filled.count() // shard_rows))
    dealt = filled.withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInArrow(_pack_shard(tuple(lengths)), "no long, bin long, capacity int, offset int")
    both = cut.join(placed, "no", "left")
    return both.select(F.col("id").alias(id_col), "piece", F.col("start").alias("start_word"), F.col("size").alias("n_words"), F.col("bin").alias("bin_id"), "capacity", "offset", *carried.columns("rest"), *["text"] * bool(text_col))


def piece_texts(text: Column, last: Column, longest: int) -> Column:
    """A text's parts of ``longest`` words with all white space, cut once: put together they give the text."""
    words = F.regexp_extract_all(text, F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * longest + 1, F.lit(longest)), "")))[0]


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))
