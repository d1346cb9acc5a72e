"""Spelling variants of words by anagram hashing.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case.  A word's anagram key is the
sum of the fifth powers of its letters' code points, so words with the same letters share it, and taking a letter away
takes its power off.  Two words are near if one inserted, deleted or replaced letter makes one the other.  Then the longer
one's key without some letter is the shorter one's key (addition and removal), or both keys without some letter are equal
(exchange).  So each word meets others by its key and by its key without each of its different letters.

Words with the same letters in many orders would meet by these keys alone, though they are not near.  As a single change
leaves all letters before or all letters behind it in their order, the join also asks for an equal first or second half;
the number of meetings is then close to that of near words.  The order of all letters is verified last.  All of this is
JVM work on distinct words; only cutting and counting run in Arrow batches, with sums of bounded size.

The near word with the largest count is a word's form if that is at least ``ratio`` times the word's own.  Roots follow
forms by pointer jumping on written tables; a chain has fewer than 28 forms, as counts grow by the ratio.

Defined results: a null text has no words; repeated rows count each time; equal counts go to the word that is less in
code-point order; a word without near words has n_near 0, null form and form_n, and is its own root; an empty table
gives an empty table; a text of any length is cut in one pass at the cost of its words; a run of any length is a word,
whose rows take its bytes once for each different letter and half; ids are any type that has a text form, a null id
counts as the text 'null'; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import quoted
from ._store import materialize, release

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A task's counts are sent on when there are so many of them.
HELD = 400_000
#: One letter is taken out of a run whose checksum this number divides.
DIVISOR = 199

#: Bytes of Latin-1 text: A-Z to lower case, the letters stay, all else to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of letters in Latin-1, a byte for each letter; characters beyond Latin-1 cut runs like any other sign."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def altered(run: bytes, prefix: int, divisor: int = DIVISOR) -> bytes:
    """The run, without one letter if its checksum behind ``prefix``'s says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % divisor:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least: int, divisor: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def emptied() -> pa.RecordBatch:
            words, n = [w.decode("latin-1") for w in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc}:".encode())
                for found, n in Counter(runs(text)).items():
                    if len(found) >= least:
                        word = altered(found, prefix, divisor)
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD:
                    yield emptied()
        if held:
            yield emptied()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, divisor: int = DIVISOR) -> DataFrame:
    """``word, n`` of words with enough letters and occurrences."""
    rows = docs.filter(quoted(text_col).isNotNull()).select(F.coalesce(quoted(id_col).cast("string"), F.lit("null")).alias("id"), quoted(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(_count(least_length, divisor), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _power(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + _power(c))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for each word and each word near it, both ways; ``words`` has ``word, n``, each once."""
    w, size = F.col("word"), F.length("word")
    keyed = words.withColumn("letters", F.split(w, "")).withColumn("anagram", anagram_key(F.col("letters")))
    # The halves stand apart from the middle letter of a run whose letter is taken away, or meet in a whole word.
    half = F.floor((size - 1) / 2).cast("int")
    taken = keyed.select(
        "word", "n", half.alias("half"), F.lit(1).alias("skip"),
        F.explode(F.transform(F.array_distinct("letters"), lambda c: F.col("anagram") - _power(c))).alias("key"),
    )
    whole = keyed.select("word", "n", F.floor(size / 2).cast("int").alias("half"), F.lit(0).alias("skip"), F.col("anagram").alias("key"))

    def met(rows: DataFrame) -> DataFrame:
        first, second = F.substring("word", F.lit(1), F.col("half")), F.substring("word", F.col("half") + F.col("skip") + 1, F.length("word"))
        halves = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64("key", F.lit(0), first).alias("at")), F.struct(F.lit(1).alias("side"), F.xxhash64("key", F.lit(1), second).alias("at")))
        return rows.select("word", "n", "skip", "half", F.inline(halves))

    left = met(taken).select("at", "side", "half", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = met(taken.unionByName(whole)).select("at", "skip", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # A pair whose first halves are equal is met there; the second halves count for the others only.
    other = (F.col("side") == 0) | (F.substring("a", F.lit(1), F.col("half")) != F.substring("b", F.lit(1), F.col("half")))
    # Sizes are guessed from the words' small files, before each row is taken apart; no join here may be broadcast by them.
    pairs = left.join(right.hint("merge"), "at").filter((F.col("a") != F.col("b")) & other & (F.levenshtein("a", "b", 1) == 1))
    one = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    back = F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    # Exchanges are met from both sides; an addition or removal only from the longer word.
    return pairs.select(F.inline(F.when(F.col("skip") == 1, F.array(one)).otherwise(F.array(one, back)))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each word with a form, from ``word, form``: rounds of jumps of 1, 2, 4, ... forms."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = at.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, at = at, materialize(jumped, "roots")
        release(before)
        if at.filter("moved").isEmpty():
            return at.drop("moved"), at
        rest, at = at, materialize(at.drop("moved"), "roots")
        release(rest)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, divisor: int = DIVISOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = materialize(word_counts(docs, id_col, text_col, least_length, least_count, divisor), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near.hint("merge"), "word", "left")
    formed = (-F.col("best.less")) >= F.col("n") * ratio
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    roots, table = _roots(rows.filter("form is not null"))
    out = rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(out, "variants")
    release(words, rows, table)
    return out


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
codes AS (SELECT list(c ORDER BY i) AS code FROM bits WHERE step = 8),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
once AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY 1, 2),
spelt AS (SELECT run, n, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', run))) AS x FROM once),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(concat('0x', substr(x, 2 * i + 1, 2)) AS BIGINT))),
  lambda s, b: xor(s >> 8, code[CAST(xor(s & 255, b) + 1 AS BIGINT)])), 4294967295) AS h FROM spelt, codes),
words AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) + 2 AS BIGINT))) ELSE run END AS w, n FROM summed)
  WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, struct_pack(m := -near_n, near := near)) AS near FROM near GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM chain c JOIN forms f ON f.form = c.word)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN chain c USING (word)"""
