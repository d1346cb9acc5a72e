"""Ranked full-text search by scanning texts, for a single search; ``index`` has the written index for many.

Texts are cut and counted in their own rows; scores are BM25.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """``doc_id, pos, term`` of every token."""
    return docs.select(F.col(id_col), F.posexplode((T.stemmed_tokens if stemmed else T.tokens)(F.col(text_col))).alias("pos", "term"))


def counted(words: Column) -> Column:
    """(term, tf) of a row's words, counted in the row: sorted, then cut where the word changes."""

    def runs(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda x, j: F.struct(F.get(w, x - 1).alias("term"), (x - F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1))).cast("long").alias("tf"))))[0]

    some = F.transform(F.array(F.sort_array(words)), runs)[0]
    return F.when(F.size(words) > 0, some).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """``doc_id, term, tf``, counted within each text's own token list; nothing is shuffled."""
    return docs.select(id_col, F.inline(counted((T.stemmed_tokens if stemmed else T.tokens)(F.col(text_col)))))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, cf, df``: how often each term stands in all texts, and in how many of them."""
    rows = docs.select(F.inline(counted(T.tokens(F.col(text_col)))))
    return rows.groupBy("term").agg(F.sum("tf").cast("long").alias("cf"), F.count("*").alias("df"))


#: Keys that are sent to the rows at most, before those that remain are joined.
MOST_KEYS = 100_000


def rows_with(rows: DataFrame, values: str, key: str, facts: DataFrame) -> DataFrame:
    """``rows`` exploded by the array ``values`` as ``key``, joined with ``facts``.

    If the facts have few keys, which a count shows, rows drop all other values before anything is shuffled.
    """
    keys = facts.select(key).distinct()
    opened = rows.withColumn(key, F.explode(values)).drop(values)
    return (opened.join(F.broadcast(keys), key, "left_semi") if keys.count() <= MOST_KEYS else opened).join(facts, key)


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.size(T.tokens(F.col(text_col))).cast("long").alias("length"))


def query_terms(text: str, stemmed: bool = False) -> list[str]:
    """The words of a user's text as a search has them, each once."""
    return list(dict.fromkeys(query_terms_in_order(text, stemmed)))


def bm25(found: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` from the postings of a query's terms; ``lengths`` covers all documents."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    # A query's terms and one row of totals: neither grows with the data.
    scored = found.join(F.broadcast(df), "term").join(lengths, id_col).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy(id_col).agg(F.sum(idf * weight).alias("score"))


def scores(docs: DataFrame, query: str, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """``id_col, score, parts`` of the documents with any word of the query; ``parts`` is how many of its words.

    One pass counts documents, lengths and each term's documents; a second one scores every text in its own row, so
    no postings are shuffled.
    """
    terms = query_terms(query, stemmed)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("parts")).limit(0)
    words = (T.stemmed_tokens if stemmed else T.tokens)(F.col(text_col))
    held = F.filter("_w", lambda w: w.isin(*terms))
    cut = docs.select("*", words.alias("_w")).withColumns({"_length": F.size("_w"), "_held": held})
    tf = [_count_of(F.col("_held"), t) for t in terms]
    stats = cut.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(x > 0).alias(f"_df{i}") for i, x in enumerate(tf)])
    scored = (cut if where is None else cut.filter(where)).filter(F.size("_held") > 0)
    scored = scored.crossJoin(F.broadcast(stats))  # one row of totals
    norm = K1 * (1 - B + B * F.col("_length") / F.col("_mean"))
    score, parts = F.lit(0.0), F.lit(0)
    for i, x in enumerate(tf):
        score = score + F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) * x * (K1 + 1) / (x + norm)
        parts = parts + (x > 0).cast("int")
    return scored.select(id_col, score.alias("score"), parts.alias("parts"))


def search(docs: DataFrame, query: str, k: int = 10, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", match_all: bool = False, stemmed: bool = False) -> DataFrame:
    """The ``k`` best documents for a query (ties: least id); ``match_all`` asks for every term.

    For many searches over the same texts write an index (``index.write_index``).
    """
    found = scores(docs, query, where, id_col, text_col, stemmed)
    if match_all:
        found = found.filter(F.col("parts") == len(query_terms(query, stemmed)))
    return found.select(id_col, "score").orderBy(F.desc(F.round("score", 6)), id_col).limit(k)


def _count_of(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def phrase(docs: DataFrame, words: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold the words one behind the other, with the number of times; no shuffle."""
    line = F.concat(F.lit(" "), F.array_join(T.tokens(F.col(text_col)), "  "), F.lit(" "))
    asked = query_terms_in_order(words)
    if not asked:
        return docs.select(id_col, F.lit(0).cast("long").alias("n")).limit(0)
    needle = " " + "  ".join(asked) + " "
    times = (F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))) / len(needle)
    return docs.filter(line.contains(needle)).select(id_col, times.cast("long").alias("n"))


def query_terms_in_order(text: str, stemmed: bool = False) -> list[str]:
    """The words of a user's text: folded, or folded stems."""
    found, word = [], ""
    for c in unicodedata.normalize("NFC", text) + " ":
        if unicodedata.category(c)[0] in "LNM":
            word += c
        elif word:
            found.append(T.stemmed_token(word) if stemmed else T.folded(word))
            word = ""
    return [w for w in found if w]
