"""A light stemmer for Czech, after Dolamic and Savoy (2009): endings of cases, possessives, then palatalisation.

It works on lower-case words with their diacritics, as column expressions in the JVM.  ``text.fold`` goes on top where
words are compared without marks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of cases, by length; a stem keeps three letters.
CASES = (
    "atech",
    "ětem", "etem", "atům",
    "ech", "ich", "ích", "ého", "ěmi", "emi", "ému", "ěte", "ete", "ěti", "eti", "ího", "iho", "ími", "ímu", "imu", "ách", "ata", "aty", "ých", "ama", "ami", "ové", "ovi", "ými",
    "em", "es", "ém", "ím", "ům", "at", "ám", "os", "us", "ým", "mi", "ou",
    "a", "e", "i", "o", "u", "ů", "y", "á", "é", "í", "ý", "ě",
)
#: Endings of possessives; a stem keeps four letters.
POSSESSIVES = ("ov", "in", "ův")
#: In this order, the first that fits: (pattern, what comes in its place).
PALATAL = ((r"čt$", "ck"), (r"št$", "sk"), (r"[cč]$", "k"), (r"[zž]$", "h"), (r"e(.)$", r"\1"), (r"(.)ů(.)$", r"\1o\2"))

_CASE = f"^(.{{3,}}?)(?:{'|'.join(CASES)})$"
_POSSESSIVE = f"^(.{{4,}}?)(?:{'|'.join(POSSESSIVES)})$"


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    bare = F.regexp_replace(F.regexp_replace(word, _CASE, "$1"), _POSSESSIVE, "$1")

    def palatal(w: Column) -> Column:
        out = w
        for pattern, instead in reversed(PALATAL):
            out = F.when(w.rlike(pattern), F.regexp_replace(w, pattern, instead.replace("\\", "$"))).otherwise(out)
        return out

    return F.transform(F.array(bare), palatal)[0]  # computed once


def stemmed(word: str) -> str:
    """``stem`` of a user's own word."""
    bare = re.sub(_POSSESSIVE, r"\1", re.sub(_CASE, r"\1", word))
    for pattern, instead in PALATAL:
        if re.search(pattern, bare):
            return re.sub(pattern, instead, bare)
    return bare


def stem_sql(x: str) -> str:
    """``stem`` for DuckDB."""
    cases = "".join(f" WHEN regexp_matches(b, '{p}') THEN regexp_replace(b, '{p}', '{i}')" for p, i in PALATAL)
    bare = rf"regexp_replace(regexp_replace({x}, '{_CASE}', '\1'), '{_POSSESSIVE}', '\1')"
    return f"list_transform([{bare}], lambda b: CASE{cases} ELSE b END)[1]"
