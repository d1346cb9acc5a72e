"""An inverted index as tables, which grows by segments and answers words, phrases and prefixes without the texts.

``write_index`` starts an index with one segment and ``append_index`` adds one.  A segment has

* ``docs``: ``id, window, length`` and the columns that were named to be kept for filters;
* ``terms``: ``term, df, cf`` in order of term, so that a prefix is a range of few files;
* ``postings``: a row for each term and window (several, if a window has very many words), with ``n``, the greatest ``tf`` and least ``length`` there, and the
  documents with their places.  Rows lie in folders by the term's hash, sorted by term.

A window is a set of about ``WINDOW`` documents, chosen by the id's hash; so a common word's documents are spread over
many rows and tasks, and no row grows with the table.  The number of folders follows the number of words.  Texts are
dealt by window and their words grouped there, so that a row for each word of a window is shuffled, not one for each of
a document.

A file ``_current`` names the segments, their totals and the index's options; it is replaced by a rename, so a reader
sees all of a segment or nothing of it.  A search takes the options from there: they cannot differ from the writing.

For the best ``k`` documents of a query of words, the narrow columns of the words' rows are read first.  They bound each
window's score from above; the most promising windows are scored, which gives a score that ``k`` documents reach; and
of the others only windows that could beat it are read (``blocks`` shows which).  The result is that of scoring all.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import text as T
from ..store import read_pointer, write_pointer
from .search import K1, B, query_terms_in_order

WINDOW = 4096
#: Words for each folder of postings, and folders at most; a folder's rows are dealt to so many tasks.
FOLDER_WORDS, MOST_FOLDERS, SLOTS = 4_000_000, 4096, 8
#: Windows that are scored first, beside one for each asked document, to learn which score the best documents reach.
FIRST_WINDOWS = 8
#: Words of a window beyond which a task groups what it has, and rows that it sends on at once.
TOKENS, SENT = 4_000_000, 20_000


def _segment(docs: DataFrame, path: str, stemmed: bool, id_col: str, text_col: str, keep: Sequence[str]) -> dict:
    """Write one segment; its entry in the list of segments."""
    spark, folder = docs.sparkSession, f"{path}/segments/{uuid.uuid4().hex}"
    words = (T.stemmed_tokens if stemmed else T.tokens)(F.col(text_col))
    docs.select(F.col(id_col).alias("id"), F.size(words).cast("long").alias("length"), *keep).write.parquet(f"{folder}/lengths")
    counted = spark.read.parquet(f"{folder}/lengths")
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    windows, folders = max(1, math.ceil(n / WINDOW)), min(MOST_FOLDERS, max(1, math.ceil(total / FOLDER_WORDS)))
    window = lambda c: F.pmod(F.xxhash64(c), F.lit(windows)).cast("int")

    # Texts are dealt by window, so a task has all of a window's documents; in their order, so that a task that runs
    # again gives the same rows.  What is shuffled behind it has a row for each word of a window.
    dealt = docs.select(F.col(id_col).alias("id"), window(F.col(id_col)).alias("window"), F.col(text_col).alias("text")).repartition("window")
    cut = dealt.sortWithinPartitions("window", "id").select("id", "window", (T.stemmed_tokens if stemmed else T.tokens)(F.col("text")).alias("words"))
    kind = cut.schema["id"].dataType
    rows = cut.mapInArrow(_inverted(to_arrow_type(kind)), _POSTINGS.format(id=kind.simpleString()))
    rows = rows.withColumns({"folder": F.pmod(F.xxhash64("term"), F.lit(folders)).cast("int"), "slot": F.pmod("window", F.lit(SLOTS))})
    blocks = rows.repartition("folder", "slot").select("folder", "term", "window", "n", "max_tf", "min_length", "cf", "postings")
    entry = {"folder": folder, "docs": n, "words": total, "folders": folders, "schemas": {}}

    def write(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{folder}/{name}")
        entry["schemas"][name] = df.schema.json()  # an empty table has no file to tell it
        return _read(spark, entry, name)

    written = write(blocks.sortWithinPartitions("folder", "term", "window"), "postings", "folder")
    write(counted.withColumn("window", window("id")), "docs")
    known = written.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("cf").alias("cf"))
    write(known.orderBy("term"), "terms")
    return entry


def _read(spark: SparkSession, segment: dict, name: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(segment["schemas"][name]))).parquet(f"{segment['folder']}/{name}")


_POSTINGS = "term string, window int, n int, max_tf int, min_length bigint, cf bigint, postings array<struct<id:{id},tf:int,length:bigint,places:array<int>>>"


def _inverted(kind: pa.DataType):
    """From ``id, window, words`` in order of window to rows of postings; a window of very many words has several rows for one."""

    def rows(window: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.chunked_array([p.column("words") for p in parts]).combine_chunks()
        ids = pa.chunked_array([p.column("id") for p in parts]).combine_chunks().cast(kind)
        length = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return
        # In order of word, then document, then place.
        key = np.sort((coded.indices.to_numpy().astype(np.int64) << 32) + np.arange(len(coded)))
        word, token = key >> 32, key & 0xFFFFFFFF
        doc = np.repeat(np.arange(len(length)), length)[token]
        places = (token - (np.cumsum(length) - length)[doc]).astype(np.int32)
        new_word = np.concatenate([[True], word[1:] != word[:-1]])
        heads = np.flatnonzero(new_word | np.concatenate([[True], doc[1:] != doc[:-1]]))
        tf, doc = np.diff(np.append(heads, len(key))), doc[heads]
        first = np.flatnonzero(new_word[heads])  # each word's first posting
        n = np.diff(np.append(first, len(heads)))
        offsets = lambda starts, end: pa.array(np.append(starts, end).astype(np.int32))
        fields = [ids.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(length[doc]), pa.ListArray.from_arrays(offsets(heads, len(key)), pa.array(places))]
        postings = pa.ListArray.from_arrays(offsets(first, len(heads)), pa.StructArray.from_arrays(fields, ["id", "tf", "length", "places"]))
        columns = {
            "term": coded.dictionary.take(pa.array(word[heads[first]])), "window": pa.array(np.full(len(first), window, np.int32)), "n": pa.array(n.astype(np.int32)),
            "max_tf": pa.array(np.maximum.reduceat(tf, first).astype(np.int32)), "min_length": pa.array(np.minimum.reduceat(length[doc], first)),
            "cf": pa.array(np.add.reduceat(tf, first)), "postings": postings,
        }
        found = pa.RecordBatch.from_pydict(columns)
        for at in range(0, len(first), SENT):
            yield found.slice(at, SENT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        window, size = None, 0
        for batch in batches:
            of = batch.column("window").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and (of[lo] != window or size > TOKENS):
                    yield from rows(window, held)
                    held, size = [], 0
                window = int(of[lo])
                held.append(batch.slice(lo, hi - lo))
                size += len(held[-1].column("words").flatten())
        if held:
            yield from rows(window, held)

    return run


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = True, keep: Sequence[str] = ()) -> None:
    """A new index under ``path``, in place of one that is there; ``keep`` names columns that searches may filter by."""
    segment = _segment(docs, path, stemmed, id_col, text_col, keep)
    write_pointer(docs.sparkSession, path, {"stemmed": stemmed, "id_col": id_col, "text_col": text_col, "keep": list(keep), "segments": [segment]})


def append_index(docs: DataFrame, path: str) -> int:
    """Add documents as a further segment; those whose id the index has stay as they are. How many were new."""
    spark = docs.sparkSession
    known = read_pointer(spark, path)
    ids = Index(spark, known).docs().select(F.col("id").alias(known["id_col"]))
    new = docs.join(ids, known["id_col"], "left_anti")
    segment = _segment(new, path, known["stemmed"], known["id_col"], known["text_col"], known["keep"])
    write_pointer(spark, path, known | {"segments": [*known["segments"], segment]})
    return segment["docs"]


@dataclass
class Query:
    """A user's text as parts that each have a number of occurrences in a document."""

    words: list[str]
    phrases: list[list[str]]
    prefixes: list[str]

    def __bool__(self) -> bool:
        return bool(self.words or self.phrases or self.prefixes)


def read_query(text: str, stemmed: bool) -> Query:
    """Words, ``"quoted phrases"`` and ``prefixes*``, folded; words and phrases are stemmed as the index is.

    A phrase of one word is that word; what has no letter or digit asks for nothing.
    """
    terms = lambda x: query_terms_in_order(x, stemmed)
    quoted, rest = re.findall(r'"([^"]*)"', text), re.sub(r'"[^"]*"', " ", text)
    begun = re.findall(r"(\S+)\*", rest)
    # Only the last part of ``e-mai*`` is a prefix, and it is compared with stems as it stands.
    prefixes = [query_terms_in_order(p)[-1:] for p in begun]
    words = terms(re.sub(r"\S+\*", " ", rest)) + [w for p in begun for w in terms(p)[:-1]]
    phrases = [terms(q) for q in quoted]
    words += [p[0] for p in phrases if len(p) == 1]
    return Query(list(dict.fromkeys(words)), [list(p) for p in dict.fromkeys(map(tuple, phrases)) if len(p) > 1], list(dict.fromkeys(p[0] for p in prefixes if p)))


class Index:
    """A written index, as it was when it was opened."""

    def __init__(self, spark: SparkSession, options: dict):
        self.spark, self.options = spark, options
        self.n, self.words = (sum(s[k] for s in options["segments"]) for k in ("docs", "words"))
        self.mean = self.words / self.n if self.n else 0.0

    def _each(self, table) -> DataFrame:
        parts = [table(i, s).withColumn("segment", F.lit(i)) for i, s in enumerate(self.options["segments"])]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def docs(self) -> DataFrame:
        return self._each(lambda i, s: _read(self.spark, s, "docs"))

    def terms(self) -> DataFrame:
        """``term, df, cf`` of the whole index."""
        return self._each(lambda i, s: _read(self.spark, s, "terms")).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def with_prefix(self, prefix: str) -> DataFrame:
        """``term``: the words that begin so, from a range of the sorted terms."""
        found = self._each(lambda i, s: _read(self.spark, s, "terms")).filter((F.col("term") >= prefix) & (F.col("term") < prefix + "\U0010ffff"))
        return found.select("term").distinct()

    def rows(self, terms: Sequence[str]) -> DataFrame:
        """The postings' rows of a query's words: only their folders are read."""

        def table(_, s: dict) -> DataFrame:
            wanted = self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(s["folders"])).alias("f"))
            folders = sorted({r["f"] for r in wanted.collect()})  # as many as the query has words
            return _read(self.spark, s, "postings").filter(F.col("folder").isin(*folders) & F.col("term").isin(*terms))

        return self._each(table)

    # ---- scores ------------------------------------------------------------------------------------------------

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(float(self.n)) - df + 0.5) / (df + 0.5))

    def weight(self, tf: Column, length: Column) -> Column:
        """Grows with ``tf`` and falls with ``length``."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def blocks(self, terms: Sequence[str], k: int) -> DataFrame:
        """``segment, window, term, bound, kept``: what the rows of a query's words may add, and whether they are read.

        A window is kept if the sum of its words' bounds reaches the score that ``k`` documents are known to have.
        """
        narrow = self.rows(terms).select("segment", "window", "term", "n", "max_tf", "min_length")
        df = narrow.groupBy("term").agg(F.sum("n").alias("df"))
        bound = narrow.join(F.broadcast(df), "term")  # a row for each word of the query
        bound = bound.withColumn("bound", self.idf(F.col("df")) * self.weight(F.col("max_tf"), F.col("min_length")))
        windows = bound.groupBy("segment", "window").agg(F.sum("bound").alias("most"))
        first = windows.orderBy(F.desc("most"), "segment", "window").limit(FIRST_WINDOWS + k)
        reached = self.scored(self.rows(terms).join(F.broadcast(first.select("segment", "window")), ["segment", "window"]), df)
        kth = reached.orderBy(F.desc("score")).limit(k).agg(F.when(F.count("*") >= k, F.min("score"))).first()[0] or 0.0
        # A hair below, so that rounding in sums of another order loses nothing.
        return bound.join(windows, ["segment", "window"]).select("segment", "window", "term", "bound", (F.col("most") >= kth * (1 - 1e-9)).alias("kept"))

    def scored(self, rows: DataFrame, df: DataFrame) -> DataFrame:
        """``id, length, score, parts`` of the documents in ``rows``; ``df`` has a row for each word."""
        each = rows.select("term", F.inline("postings")).join(F.broadcast(df), "term")
        return each.groupBy("id").agg(F.sum(self.idf(F.col("df")) * self.weight(F.col("tf"), F.col("length"))).alias("score"), F.count("*").alias("parts"))

    # ---- parts of a query --------------------------------------------------------------------------------------

    def phrase(self, words: Sequence[str]) -> DataFrame:
        """``id, length, tf``: where the words stand one behind the other, from their places."""
        distinct = list(dict.fromkeys(words))
        rows = self.rows(distinct)
        # Only windows that have all the words; of these the narrow columns are read first.
        windows = rows.groupBy("segment", "window").agg(F.count_distinct("term").alias("k")).filter(F.col("k") == len(distinct)).select("segment", "window")
        offsets = F.create_map(*[x for w in distinct for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])
        each = rows.join(windows, ["segment", "window"], "left_semi").select("term", F.inline("postings"))
        starts = each.select("id", "length", F.explode(F.element_at(offsets, F.col("term"))).alias("offset"), "places")
        starts = starts.select("id", "length", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
        # One array for each word of the phrase.
        met = starts.groupBy("id", "length").agg(F.collect_list("starts").alias("all")).filter(F.size("all") == len(words))
        common = F.aggregate(F.slice("all", 2, len(words)), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return met.select("id", "length", F.size(common).alias("tf")).filter("tf > 0")

    def prefix(self, prefix: str) -> DataFrame:
        """``id, length, tf``: occurrences of all words that begin so, from a range of each folder's sorted rows."""
        begun = (F.col("term") >= prefix) & (F.col("term") < prefix + "\U0010ffff")
        rows = self._each(lambda i, s: _read(self.spark, s, "postings").filter(begun))
        return rows.select(F.inline("postings")).groupBy("id", "length").agg(F.sum("tf").alias("tf"))

    def word(self, word: str) -> DataFrame:
        return self.rows([word]).select(F.inline("postings")).select("id", "length", "tf")

    def search(self, query: str, k: int = 10, match_all: bool = False, where: Column | None = None) -> DataFrame:
        """``id_col, score``: the ``k`` best documents (ties: least id); ``where`` filters by the kept columns.

        ``match_all`` asks for every part of the query.  A phrase or prefix weighs as a word that occurs as often.
        """
        asked, id_col = read_query(query, self.options["stemmed"]), self.options["id_col"]
        if not asked or not self.n:
            return self.docs().select(F.col("id").alias(id_col), F.lit(0.0).alias("score")).limit(0)
        parts = len(asked.words) + len(asked.phrases) + len(asked.prefixes)
        if asked.phrases or asked.prefixes:
            units = [self.word(w) for w in asked.words] + [self.phrase(p) for p in asked.phrases] + [self.prefix(p) for p in asked.prefixes]
            rows = units[0].select("id", "length", F.col("tf").cast("long").alias("tf"), F.lit(0).alias("unit"))
            for i, u in enumerate(units[1:], 1):
                rows = rows.union(u.select("id", "length", F.col("tf").cast("long"), F.lit(i)))
            df = rows.groupBy("unit").agg(F.count("*").alias("df"))
            each = rows.join(F.broadcast(df), "unit")  # a row for each part of the query
            found = each.groupBy("id").agg(F.sum(self.idf(F.col("df")) * self.weight(F.col("tf"), F.col("length"))).alias("score"), F.count("*").alias("parts"))
        else:
            rows = self.rows(asked.words)
            df = rows.groupBy("term").agg(F.sum("n").alias("df"))
            if where is None and not match_all:
                kept = self.blocks(asked.words, k).filter("kept").select("segment", "window").distinct()
                rows = rows.join(kept, ["segment", "window"], "left_semi")
            found = self.scored(rows, df)
        if match_all:
            found = found.filter(F.col("parts") == parts)
        if where is not None:
            found = found.join(self.docs().filter(where).select("id"), "id", "left_semi")
        return found.select(F.col("id").alias(id_col), "score").orderBy(F.desc(F.round("score", 6)), id_col).limit(k)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark, read_pointer(spark, path))


def search_index(spark: SparkSession, path: str, query: str, k: int = 10, **how) -> DataFrame:
    """The ``k`` best documents of a written index; the texts are not read."""
    return open_index(spark, path).search(query, k, **how)
