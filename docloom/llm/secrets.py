"""Secret scan through a trigram index, in DataFrame functions only.

1. From each rule's regular expression a Boolean query over trigrams is derived (``trigram_query``): a text can only
   match if it holds all trigrams of one of the query's conjunctions.  A rule without mandatory trigrams scans
   every text.
2. The index has a posting (trigram, text hash, number of copies) for each trigram of the rules that a text holds in
   either case.  Copies of a text have one posting.
3. Postings are intersected: a text is a candidate for a rule if it has all postings of one conjunction.
4. Candidates are verified on their whole texts with the regular expressions themselves.  Their hashes go to the texts
   by broadcast if a count shows that they are few, else the texts are shuffled to them (``_join.attach``).

Spans are counted in code points, end exclusive, and cover the whole match.  Matches of a rule are leftmost and do
not overlap; matches of different rules may.

Defined results: null and empty texts have no spans; repeated rows are each returned; spans of one start are in the
rules' order; an empty table gives an empty table; a very long text is scanned whole, in time linear in it but for the
square root of its number of matches; extra columns are ignored, or carried if named, and one that is named ``found``
comes out as ``found_in``.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._join import attach
from ._names import Carried, quoted
from ._store import materialize
from .quality import _let

_MOST_STRINGS = 64
_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Whole matches of ``pattern`` whose ``group`` has at least ``least`` characters; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules in their order, then the rules that this operator adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # a shorter run holds no longer one, so runs under 16 need no match
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
)


# ---- trigram queries -------------------------------------------------------------------------------------------

Query = frozenset[frozenset[str]]  # an OR of ANDs; an empty AND holds for every text
_ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    both = {x | y for x, y in itertools.product(a, b)}
    return frozenset(x for x in both if not any(y < x for y in both))


def _or(parts: Sequence[Query]) -> Query:
    every = frozenset().union(*parts)
    return _ANY if frozenset() in every else every


def _of_strings(strings: frozenset[str]) -> Query:
    return _or([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= _MOST_STRINGS else None


def _analyse(nodes) -> tuple[frozenset[str] | None, Query]:
    """The exact strings that a sequence matches, or None, and what every match must hold."""
    query, run, exact = _ANY, frozenset([""]), True
    for op, arg in nodes:
        strings, needs = _node(op, arg)
        joined = _cross(run, strings) if strings is not None else None
        if joined is None:
            query, exact = _and(query, _and(_of_strings(run), needs)), False
            run = strings if strings is not None else frozenset([""])
        else:
            run = joined
    query = _and(query, _of_strings(run))
    return (run if exact else None), query


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([chr(arg).lower()]), _ANY
    if op is sre.AT:
        return frozenset([""]), _ANY
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            return frozenset(chr(a).lower() for _, a in arg), _ANY
        return None, _ANY
    if op is sre.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            together = frozenset().union(*(s for s, _ in parts))
            if len(together) <= _MOST_STRINGS:
                return together, _ANY
        return None, _or([q for _, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, needs = _analyse(body)
        if strings is not None and most != sre.MAXREPEAT and most <= 8:
            out: frozenset[str] | None = frozenset()
            for n in range(least, most + 1):
                power: frozenset[str] | None = frozenset([""])
                for _ in range(n):
                    power = _cross(power, strings) if power is not None else None
                out = None if power is None or out is None or len(out | power) > _MOST_STRINGS else out | power
            if out is not None:
                return out, _ANY
        if not least:
            return None, _ANY
        return None, _of_strings(strings) if strings is not None else needs
    return None, _ANY


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of lower-case trigrams that any text with a match holds, in lower case."""
    return _analyse(sre_parse.parse(pattern))[1]


# ---- index -----------------------------------------------------------------------------------------------------


def trigram_index(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """``trigram, h, n``: postings of the given trigrams over the distinct hashes ``h`` of ``_text``, of ``n`` rows each."""
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    return texts.select("h", F.lower("_text").alias("_low")).select("h", F.explode(held).alias("trigram")).groupBy("h", "trigram").agg(F.count("*").alias("n"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``h, n, kinds``: the rules that a text may match, from the intersection of postings."""
    rows = [(kind, i, t, len(c)) for kind, q in queries.items() for i, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    if not rows:
        return postings.select("h", "n", F.array().cast("array<string>").alias("kinds")).limit(0)
    each = [F.struct(F.lit(k).alias("kind"), F.lit(p).alias("part"), F.lit(t).alias("trigram"), F.lit(n).alias("needed")) for k, p, t, n in rows]
    terms = postings.sparkSession.range(1).select(F.inline(F.array(*each)))
    # The terms come from the rules alone, so their size does not depend on the data.
    met = postings.join(F.broadcast(terms), "trigram").groupBy("h", "kind", "part").agg(F.count("*").alias("held"), F.first("needed").alias("needed"), F.max("n").alias("n"))
    return met.filter("held = needed").groupBy("h").agg(F.max("n").alias("n"), F.collect_set("kind").alias("kinds"))


# ---- spans -----------------------------------------------------------------------------------------------------


def _starts(steps: Column) -> Column:
    """Exclusive prefix sums, through the sums of blocks so that long lists stay near linear."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), (F.size(steps) / _BLOCK).cast("int")), lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return _let(before, lambda p: F.transform(steps, lambda _, i: F.get(p, (i / _BLOCK).cast("int")) + total(F.slice(steps, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """An array of (start, rank, end, kind) for the rule's matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)

    def spans(m: Column, g: Column) -> Column:
        steps = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda a, b: F.length(a) + F.length(b))
        return _let(_starts(steps), lambda s: F.transform(m, lambda x, i: F.struct((F.get(s, i) + F.length(F.get(g, i))).alias("start"), F.lit(order).alias("rank"), (F.get(s, i) + F.length(F.get(g, i)) + F.length(x)).alias("end"), F.lit(rule.kind).alias("kind"))))

    every = _let(found, lambda m: _let(gaps, lambda g: spans(m, g)))
    return F.filter(every, lambda x, i: F.length(F.get(held, i)) >= rule.least) if rule.group else F.filter(every, lambda x: x["end"] - x["start"] >= rule.least)


_NONE = "array<struct<start:int,rank:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep`` and ``found``, the rules' spans in order of start and rule, for each row."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    carried = Carried(keep, ("found",))
    rows = docs.select(carried.struct().alias("_rest"), text.alias("_text")).withColumn("h", F.xxhash64("_text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if frozenset() not in q}
    trigrams = sorted({t for q in indexed.values() for part in q for t in part})
    if trigrams:
        rows = attach(rows, materialize(candidates(trigram_index(rows, trigrams), indexed), "candidates"), "h", "n")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast(_NONE)
    parts = []
    for order, r in enumerate(rules):
        may = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r.kind in indexed else F.col("_text").rlike(r.pattern)
        parts.append(F.when(may, rule_spans(F.col("_text"), r, order)).otherwise(none))
    return rows.select(*carried.columns("_rest"), F.sort_array(F.concat(*parts)).alias("found"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["rank"] < sum(r.base for r in RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def _sql() -> str:
    """Every rule's spans by a full scan, for DuckDB."""

    def rule(order: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        size = f"length(regexp_extract_all(t, '{p}', {r.group})[i])"
        return f"""
  SELECT doc_id, {order} AS rank, '{r.kind}' AS kind, s, s + length(m[i]) AS e FROM (
    SELECT doc_id, i, m, t, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, t, m, g, unnest(generate_series(1, len(m))) AS i
          FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d) WHERE len(m) > 0))
  WHERE {size} >= {r.least}"""

    n_base = sum(r.base for r in RULES)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(rule(i, r) for i, r in enumerate(RULES))}),
x AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) AS w FROM s),
g AS (SELECT doc_id, {counts}, string_agg(w, ',' ORDER BY s, rank) FILTER (WHERE rank < {n_base}) AS b, string_agg(w, ',' ORDER BY s, rank) AS a FROM x GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP7_SQL = _sql()
