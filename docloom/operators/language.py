"""The language of a text, and of its paragraphs, by ranks of character n-grams (Cavnar and Trenkle, 1994).

A profile is a language's ``most`` commonest n-grams of 1 to 3 characters in order.  A text is as far from it as its own
n-grams' ranks are from theirs; one that the profile lacks counts as ``most`` away.  Profiles are counted from labelled
rows: tasks count words and cut each different one once, then sum before the shuffle; profiles are the only thing that is
broadcast: ``most`` rows for each language.  Texts are then ranked in their own rows, so classifying shuffles nothing;
the words of many texts are cut at once, and n-grams are numbers.  Memory grows with the different words of a text.

Defined results: words are folded to lower case with their marks, each with a blank before and behind; equal counts are
ranked by n-gram; equal distances go to the lesser language; a text without letters has no language, nor has any without
profiles; a text of fewer than ``least`` letters is judged like any other, but is ``short``.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 300, 40
#: Different tokens whose counts a task holds before it cuts them, and characters of texts that are judged together.
HELD, CHARS = 200_000, 250_000
_WORD = re.compile(r"[^\W\d_]+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def ngrams(text: str) -> Counter[str]:
    """The n-grams of a text's words; each different word is cut once."""
    found: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        w = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(w) - size + 1):
                found[w[i : i + size]] += n
    del found[" "]
    return found


def ranked(counts: Counter[str], most: int = MOST) -> list[str]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def _cut(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words as numbers in the order of their text, and the word of each."""
    framed = [f" {w} " for w in words]
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, framed), np.int64, len(framed))
    word, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(code))
    grams, of = [], []
    for n in (1, 2, 3):
        at = np.flatnonzero(code != 32 if n == 1 else left >= n)
        # 21 bits for a character; none is less than any.
        grams.append(sum(code[at + i] << 42 - 21 * i for i in range(n)))
        of.append(word[at])
    return np.concatenate(grams), np.concatenate(of)


def _gram(number: int) -> str:
    return "".join(chr(c) for i in (42, 21, 0) if (c := number >> i & 0x1FFFFF))


def _number(gram: str) -> int:
    return sum(ord(c) << 42 - 21 * i for i, c in enumerate(gram))


def _words(tokens: dict[str, int]) -> dict[str, int]:
    """The words of a text that was cut at blanks; no word has one, and most tokens are words."""
    found = {token: n for token, n in tokens.items() if token.isalpha()}
    for token in tokens.keys() - found.keys():
        for word in _WORD.findall(token):
            found[word] = found.get(word, 0) + tokens[token]
    return found


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter[str]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, tokens in held.items():
            counts = _words(tokens)
            if not counts:
                continue
            grams, of = _cut(list(counts))
            found, place = np.unique(grams, return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, place, np.fromiter(counts.values(), np.int64, len(counts))[of])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(map(_gram, found.tolist()), pa.string()), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > HELD:
                yield from emptied()
    yield from emptied()


def profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> DataFrame:
    """``lang, gram, rank`` (from 0) of labelled texts."""
    from .documents import top_per_group

    texts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = texts.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return top_per_group(counts, ["lang"], [F.desc("n"), F.col("gram")], most).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def judged(pieces: Sequence[dict[str, int]], known: dict[str, dict[str, int]], most: int = MOST) -> list[tuple[str | None, int | None, int]]:
    """(language, distance, letters) of each piece, given by its words; each different word of all is cut once."""
    words = list(dict.fromkeys(itertools.chain.from_iterable(pieces)))
    if not words or not known:
        return [(None, None, sum(n * len(w) for w, n in p.items())) for p in pieces]
    index = dict(zip(words, range(len(words)), strict=True))
    grams, of = _cut(words)
    grams, place = np.unique(grams, return_inverse=True)
    place, n_grams = place[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))
    starts, letters = np.cumsum(n_grams) - n_grams, np.fromiter(map(len, words), np.int64, len(words))
    # Rows are languages in order; a profile's n-grams that no word has are left out.
    names = sorted(known)
    rank = np.full((len(names), len(grams)), -1, np.int64)
    for i, lang in enumerate(names):
        own = {_number(g): r for g, r in known[lang].items() if 0 < len(g) <= 3}
        numbers = np.fromiter(own, np.int64, len(own))
        at = np.minimum(np.searchsorted(grams, numbers), len(grams) - 1)
        met = grams[at] == numbers
        rank[i, at[met]] = np.fromiter(own.values(), np.int64, len(own))[met]
    out: list[tuple[str | None, int | None, int]] = []
    for p in pieces:
        if not p:
            out.append((None, None, 0))
            continue
        word = np.fromiter(map(index.__getitem__, p), np.int64, len(p))
        n, size = np.fromiter(p.values(), np.int64, len(p)), n_grams[word]
        found = place[np.arange(size.sum()) + np.repeat(starts[word] - np.cumsum(size) + size, size)]
        times = np.repeat(n.astype(float), size)
        if 4 * len(found) > len(grams):
            counts = np.bincount(found, times)
            gram = np.flatnonzero(counts)
            counts = counts[gram]
        else:
            gram, back = np.unique(found, return_inverse=True)
            counts = np.bincount(back, times)
        # The commonest first, equal ones in the order of their text: both in one number.
        best = np.sort(counts.astype(np.int64) * len(grams) + (len(grams) - 1 - gram))[::-1][:most]
        theirs = rank[:, len(grams) - 1 - best % len(grams)]
        far = np.where(theirs < 0, most, np.abs(np.arange(len(best)) - theirs)).sum(axis=1)
        at = int(far.argmin())
        out.append((names[at], int(far[at]), int(n @ letters[word])))
    return out


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("letters", pa.int64())]))


def _judge(sent: Broadcast, most: int, kinds: list[pa.DataType]):
    def rows(texts: list[str]) -> Iterator[tuple]:
        known = sent.value
        parts = [_PARAGRAPH.split(t) for t in texts]
        pieces = [_words(Counter(t.lower().split())) for t in texts]
        pieces += [_words(Counter(p.lower().split())) for ps in parts if len(ps) > 1 for p in ps]
        found = judged(pieces, known, most)
        inner = iter(found[len(texts) :])
        for (lang, d, letters), ps in zip(found, parts, strict=False):
            mix: Counter[str] = Counter()
            for one, _, n in itertools.islice(inner, len(ps)) if len(ps) > 1 else [(lang, d, letters)]:
                if one:
                    mix[one] += n
            yield lang, d, letters, [{"lang": k, "letters": n} for k, n in sorted(mix.items(), key=lambda x: (-x[1], x[0]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, chars = [], [], 0
            for text in batch.column("text").to_pylist():
                held.append(text or "")
                chars += len(held[-1])
                if chars > CHARS:
                    out += rows(held)
                    held, chars = [], 0
            out += rows(held)
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), _MIX))]
            carried = [batch.column(f"_{i}").cast(t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*carried, *arrays], names=[*(f"_{i}" for i in range(len(kinds))), "language", "distance", "letters", "mix"])

    return run


def languages(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, least: int = LEAST, keep: Sequence[str] = ()) -> DataFrame:
    """``id_col, language, distance, letters, short, mix`` and the columns of ``keep``; ``mix`` has each paragraph's
    language, summed by letters."""
    from pyspark.sql.pandas.types import to_arrow_type

    held: dict[str, dict[str, int]] = {}
    for r in known.collect():  # ``most`` rows for each language
        held.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    names = [id_col, *keep]
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema[f"_{i}"].dataType for i in range(len(names))]
    schema = ", ".join([*(f"_{i} {k.simpleString()}" for i, k in enumerate(kinds)), "language string, distance long, letters long, mix array<struct<lang:string,letters:bigint>>"])
    found = rows.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(held), most, [to_arrow_type(k) for k in kinds]), schema)
    carried = [F.col(f"_{i}").alias(c) for i, c in enumerate(names)]
    return found.select(carried[0], "language", "distance", "letters", (F.col("letters") < least).alias("short"), "mix", *carried[1:])


def metadata_only(found: DataFrame, own: str) -> DataFrame:
    """``found`` with ``metadata_only``: whether less than half of a text's letters are of the language ``own``."""
    mine = F.aggregate("mix", F.lit(0).cast("long"), lambda s, m: s + F.when(m["lang"] == own, m["letters"]).otherwise(F.lit(0)))
    return found.withColumn("metadata_only", F.coalesce(mine * 2 < F.col("letters"), F.lit(True)) | (F.col("letters") == 0))
