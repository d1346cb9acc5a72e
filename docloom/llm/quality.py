"""Quality rules by document and by host, in DataFrame functions only.

A document fails the base rules if it has fewer than ``min_words`` words, or if more than ``max_repeat_percent`` of its
words lie in 8-word windows that its text holds twice or more.  Failures are summed by host; the hosts' failure
rates are shrunk with a beta prior whose mean and strength are fitted to all hosts by moments, so a host with few
documents stays near the common rate.  Documents of a host whose shrunk rate is over ``max_host_rate`` are rejected
with those that fail themselves.

The host table is grouped with partial sums before its shuffle.  Rates are broadcast if a count shows that they are
small; otherwise only those of hosts with over a thousandth of all documents are (``_join.attach``).  Texts are read once.

Defined results: a null text has no words and fails; a text of white space alike; a null host has no verdict, its
documents are judged by the base rules only; a host whose rate equals ``max_host_rate`` stays; repeated rows each count
and are each returned; an empty table gives an empty table; a very long text takes memory in its row, about 60 bytes for
each word; extra columns are ignored, or carried if named, and one that bears a result's name comes out with ``_in``
behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._join import attach
from ._names import Carried, quoted
from ._store import materialize

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def word_list(text: Column) -> Column:
    """The words of a text, none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of runs twice ``step`` long from those of runs of ``step``."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of 8 words."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return _let(one, lambda h1: _let(_joined(h1, 1), lambda h2: _let(_joined(h2, 2), lambda h4: _joined(h4, 4))))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: sorts (hash, place), then adds up the union of the places."""

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def length(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.sort_array(pairs), lambda s: _let(places(s), length))


def text_metrics(docs: DataFrame, text: Column, keep: Sequence[Column]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x, F.lit(_SPACES))) > 0)
    cut = docs.select(F.struct(*keep).alias("_keep"), body.alias("_text"), word_list(body).alias("_words"), lines.alias("_lines"))
    hashed = cut.select(
        "_keep",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("_words")).alias("_windows"),
    )
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(F.lit(0))
    return hashed.select("_keep.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"))


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_rates(judged: DataFrame, max_host_rate: float) -> DataFrame:
    """``host, n_docs, n_failed, rate, host_failed``: failure rates shrunk towards all hosts' mean.

    The prior's strength comes from the variance of the rates between hosts beyond what sampling explains.  Where
    there is no such variance the prior is as strong as all documents together; with one host, or with rates of 0 or
    1 only, it counts as two documents at least.
    """
    hosts = judged.filter("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts").withColumn("raw", F.col("n_failed") / F.col("n_docs"))
    sums = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.count("*").alias("h"),
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.sum(F.col("n_docs") * F.col("raw") * F.col("raw")).alias("square"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"),
    )
    n, h, mean = F.col("n").cast("double"), F.col("h"), F.col("mean")
    # Method of moments for weighted proportions: between = (S - (h-1) m(1-m)) / ((n - nn/n) m(1-m)), strength = 1/between - 1.
    noise = mean * (1 - mean)
    spread = F.col("square") - n * mean * mean
    between = F.try_divide(spread - (h - 1) * noise, (n - F.col("nn") / n - (h - 1)) * noise)
    strength = F.greatest(F.lit(2.0), F.when(between > 0, F.least(1 / between - 1, n)).otherwise(n))
    prior = sums.select(mean.alias("mean"), F.coalesce(strength, F.lit(2.0)).alias("strength")).first()  # two numbers
    m, k = F.lit(prior["mean"]).cast("double"), F.lit(prior["strength"])
    rated = hosts.withColumn("rate", (F.col("n_failed") + m * k) / (F.col("n_docs") + k))
    return rated.select("host", "n_docs", "n_failed", "rate", (F.col("rate") > max_host_rate).alias("host_failed"))


def judge(docs: DataFrame, host: Column, text_col: str = "text", keep: Sequence[str] = ("doc_id",), min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.5) -> DataFrame:
    """A row for each document: ``keep``, the metrics, ``base_failed``, ``host_rate`` and ``kept``."""
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept")
    carried = Carried(keep, results)
    measured = text_metrics(docs, quoted(text_col).cast("string"), [carried.struct().alias("_rest"), host.cast("string").alias("host")])
    judged = materialize(measured.withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "quality")
    rates = host_rates(judged, max_host_rate).select("host", "n_docs", F.col("rate").alias("host_rate"), "host_failed")
    out = attach(judged, rates, "host", "n_docs")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return out.select(*carried.columns("_rest"), *results[:-1], kept.alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, F.col("source")).drop("host_rate")


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 7)) AS s, words FROM w WHERE len(words) >= 8),
key AS (SELECT doc_id, s, array_to_string(words[s:s + 7], ' ') AS k FROM win),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c FROM key) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + 7)) AS i FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS h, sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) AS square, CAST(sum(n * n) AS DOUBLE) AS nn FROM h),
t AS (SELECT *, (square - n * mean * mean - (h - 1) * mean * (1 - mean)) / nullif((n - nn / n - (h - 1)) * mean * (1 - mean), 0) AS between_ FROM s),
p AS (SELECT mean, coalesce(greatest(2.0, CASE WHEN between_ > 0 THEN least(1 / between_ - 1, n) ELSE n END), 2.0) AS k FROM t),
v AS (SELECT host, (f + mean * k) / (n + k) > 0.5 AS failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(failed, false) AS kept
FROM b LEFT JOIN v USING (host)
"""
