"""Quotation linking: reply-ordered conversations without their quotes.

1. Each message is parsed into lines with a quote level (the number of leading ``>`` marks).  Quote lines of one level
   in a row form a passage; if the last line with words of the own lines right before a quote says who wrote it, such
   as "On Monday Ann wrote:", it belongs to the quote.
2. Passages are normalised (lower case, letters and digits only) and hashed, whole and by paragraph, line and sentence,
   and so are a message's own words.
3. A quoted hash is joined to the first message of its conversation that says it in its own words; of the messages
   that a passage's hashes point to the one with the most quoted words is linked (ties: the latest turn).  The
   passage of the lowest level that is linked names the message replied to.
4. A message and the replies to it, in the order of their turns, each with the replies to itself, make a thread.  Its
   order comes from list ranking: the walk that enters and leaves each message once is a list, and rounds that double
   every event's reach along it count the messages entered and left.  A thread of n messages makes 2n small rows in
   each of about ``log2(2n)`` rounds, whatever its shape.

Keys are (conversation, hash), with one original for each, so a sentence that a conversation repeats endlessly makes
no pairs.

Defined results: a null text is empty; messages with a null conversation or turn quote nothing and are not linked;
repeated rows are each returned, and are one message to those who quote them; a quote of a later or of the same turn
is no link; a quote without an original is removed from the text all the same; an empty table gives an empty table;
texts of any length are parsed whole; extra columns are ignored or carried if named, and one that bears a result's name
comes out with ``_in`` behind it; a conversation or turn that is no whole number is
refused with a TypeError before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ._names import Carried, quoted, whole_numbers
from ._store import materialize, release

#: How a line before a quote begins, and its verbs.
OPENERS = ("on", "am", "le", "el")
VERBS = ("wrote", "schrieb", "écrit", "escribió")
#: Replies to one message whose order is found together.
BLOCK = 1 << 16
_MARKS = re.compile(r"[ \t]?((?:>[ \t]?)+)(.*)", re.S)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def normal(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _key(words: Sequence[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63


def names_author(line: str) -> bool:
    """Whether a line introduces a quote: a verb of ``VERBS`` last, or anywhere behind one of ``OPENERS``; then a colon."""
    line = line.strip()
    if not line.endswith(":"):
        return False
    words = normal(line)
    return len(words) > 1 and (words[-1] in VERBS or (words[0] in OPENERS and any(w in VERBS for w in words)))


def _before_quote(lines: list[str]) -> list[str]:
    """Own lines without blank ones at the end, and without a last one that names the quote's author."""
    end = len(lines)
    while end and not lines[end - 1].strip():
        end -= 1
    return lines[: end - 1] if end and names_author(lines[end - 1]) else lines[:end]


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text without marks)."""
    own: list[str] = []
    run: list[str] = []  # own lines behind the last quote
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        marks = _MARKS.fullmatch(line) if ">" in line[:2] else None
        level = marks[1].count(">") if marks else 0
        if level:
            if not before:
                own += _before_quote(run)
                run = []
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(marks[2])
        else:
            run.append(line)
        before = level
    if not passages:
        return text, []
    return "\n".join(own + run).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def _parts(text: str, splits: Sequence) -> dict[int, int]:
    """Hash and number of words of the whole text and of its parts, of any length."""
    whole = normal(text)
    keys = {_key(whole): len(whole)} if whole else {}
    for split in splits:
        for part in split(text):
            words = normal(part)
            if words:
                keys.setdefault(_key(words), len(words))
    return keys


def _lines(text: str) -> list[str]:
    return text.split("\n")


_SPLITS = (_PARAGRAPH.split, _lines, _SENTENCE.split)


_PARSED = pa.struct(
    [
        ("clean", pa.string()),
        ("own", pa.list_(pa.int64())),
        ("quoted", pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("key", pa.int64()), ("words", pa.int32())]))),
        ("passages", pa.int32()),
    ]
)


def _facts(text: str) -> dict:
    clean, found = parse(text)
    own = _parts(clean, _SPLITS)
    keys = [{"passage": i, "level": level, "key": k, "words": n} for i, (level, t) in enumerate(found) for k, n in _parts(t, _SPLITS).items()]
    return {"clean": clean, "own": list(own), "quoted": keys, "passages": len(found)}


@F.arrow_udf(from_arrow_type(_PARSED))
def parse_message(texts: pa.Array) -> pa.Array:
    return pa.array((_facts(t.as_py() or "") for t in texts), _PARSED)


def _next_events(links: DataFrame) -> DataFrame:
    """``conv, turn, leaves, n_turn, n_leaves``: what follows each message's entry and exit on the walk of its thread.

    The exit of a thread's first message has none.  ``links`` has conv, turn and parent, once for each reply.
    """
    kids = links.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inner = F.lead("turn").over(Window.partitionBy("conv", "parent", "block").orderBy("turn"))
    blocks = kids.groupBy("conv", "parent", "block").agg(F.min("turn").alias("first"))
    blocks = blocks.withColumn("later", F.lead("first").over(Window.partitionBy("conv", "parent").orderBy("block")))
    kids = kids.withColumn("sibling", inner).join(blocks, ["conv", "parent", "block"]).select("conv", "turn", "parent", F.coalesce("sibling", "later").alias("sibling"))
    children = links.groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = kids.join(children, ["conv", "turn"], "full")  # replies, and first messages (with no parent)
    enter = F.struct(F.lit(False).alias("leaves"), F.coalesce("child", "turn").alias("n_turn"), F.col("child").isNull().alias("n_leaves"))
    leave = F.struct(F.lit(True).alias("leaves"), F.coalesce("sibling", "parent").alias("n_turn"), (F.col("sibling").isNull() & F.col("parent").isNotNull()).alias("n_leaves"))
    return nodes.select("conv", "turn", F.inline(F.array(enter, leave)))


def thread_order(links: DataFrame) -> DataFrame:
    """``conv, turn, root_turn, depth, position`` of every message that replies or is replied to."""
    walk = _next_events(links)
    end = F.col("n_turn").isNull()
    # ``entered`` and ``open`` count from an event to the one before the next that it knows; at last that is the end.
    walk = walk.select("conv", "turn", "leaves", F.coalesce("n_turn", "turn").alias("n_turn"), F.coalesce("n_leaves", "leaves").alias("n_leaves"), end.alias("done"), F.when(F.col("leaves"), 0).otherwise(1).cast("long").alias("entered"), F.when(end, 0).when(F.col("leaves"), -1).otherwise(1).cast("long").alias("open"))
    walk = materialize(walk, "walk")
    while not (going := walk.filter("not done")).isEmpty():
        reach = walk.select("conv", F.col("turn").alias("n_turn"), F.col("leaves").alias("n_leaves"), F.col("n_turn").alias("m_turn"), F.col("n_leaves").alias("m_leaves"), F.col("done").alias("m_done"), F.col("entered").alias("m_entered"), F.col("open").alias("m_open"))
        # An event whose next one is at the end, or knows it, is done.
        further = going.join(reach, ["conv", "n_turn", "n_leaves"]).select("conv", "turn", "leaves", F.col("m_turn").alias("n_turn"), F.col("m_leaves").alias("n_leaves"), F.col("m_done").alias("done"), (F.col("entered") + F.col("m_entered")).alias("entered"), (F.col("open") + F.col("m_open")).alias("open"))
        before, walk = walk, materialize(walk.filter("done").unionByName(further), "walk")
        release(before)
    entries = walk.filter("not leaves").select("conv", "turn", F.col("n_turn").alias("root_turn"), "entered", "open")
    whole = entries.filter("turn = root_turn").select("conv", "root_turn", F.col("entered").alias("n"), F.col("open").alias("all_open"))
    return entries.join(whole, ["conv", "root_turn"]).select("conv", "turn", "root_turn", (F.col("all_open") - F.col("open")).alias("depth"), (F.col("n") - F.col("entered")).alias("position"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", carry: Sequence[str] = ("role",)) -> DataFrame:
    """Each message with ``clean`` text, ``n_passages``, ``parent_turn``, ``root_turn``, ``depth`` and ``position``.

    ``root_turn`` is the thread's first message, ``depth`` how many replies lead to the message, and ``position`` how
    many messages of the thread come before it in reply order.
    """
    results = ("clean", "n_passages", "parent_turn", "root_turn", "depth", "position")
    whole_numbers(messages, conv_col, turn_col)
    carried = Carried(carry, (conv_col, turn_col, *results))
    parsed = messages.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).cast("long").alias("turn"), carried.struct().alias("rest"), parse_message(quoted(text_col).cast("string")).alias("p"))
    parsed = materialize(parsed, "messages")
    known = parsed.filter("conv is not null and turn is not null")
    cited = known.filter("p.passages > 0").select("conv", "turn", F.explode("p.quoted").alias("q")).select("conv", "turn", "q.*")
    needed = cited.select("conv", "key").distinct()
    said = known.select("conv", "turn", F.explode("p.own").alias("key")).join(needed, ["conv", "key"], "left_semi")
    first = said.groupBy("conv", "key").agg(F.min("turn").alias("source"))
    # Repeated rows cite alike, and count once.
    votes = cited.distinct().join(first, ["conv", "key"]).filter("source < turn").groupBy("conv", "turn", "passage", "level", "source").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv", "turn", "passage", "level").agg(F.max(F.struct("words", "source")).alias("b"))
    links = best.groupBy("conv", "turn").agg(F.min(F.struct("level", "passage", F.col("b.source").alias("source"))).alias("l"))
    links = materialize(links.select("conv", "turn", F.col("l.source").alias("parent")), "replies")
    out = parsed
    if links.isEmpty():
        alone = {"parent": F.lit(None).cast("long"), "root_turn": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "position": F.lit(0).cast("long")}
        out = out.withColumns(alone)
    else:
        # Rows without a key pass by, or they would all meet in one task.
        placed = known.join(thread_order(links).join(links, ["conv", "turn"], "left"), ["conv", "turn"], "left")
        out = placed.unionByName(parsed.filter("conv is null or turn is null"), allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("p.clean").alias("clean"),
        F.col("p.passages").cast("long").alias("n_passages"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", zero).alias("depth"),
        F.coalesce("position", zero).alias("position"),
        *carried.columns("rest"),
    )


def conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The messages in reply order, without quotes: conversation by conversation, thread by thread.

    Rows are dealt by ranges of the whole order, so a conversation of any length spreads over partitions.
    """
    order = [conv_col, "root_turn", "position", turn_col]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)


def op9_quote_links(spark, sf_dir: str) -> DataFrame:
    linked = conversations(link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return linked.select("conv_id", "turn", "role", "n_passages", "parent_turn", "root_turn", "depth", "position", F.sha2("clean", 256).alias("clean_sha256"))


#: The same rows from every line and every path of replies, for DuckDB.
OP9_SQL = r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, conv_id AS conv, turn, role, coalesce(text, '') AS text FROM conversations),
line AS (
  SELECT r, conv, turn, i, l, length(regexp_replace(regexp_extract(l, '^[ \t]?((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level
  FROM (SELECT r, conv, turn, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM raw)),
run AS (
  SELECT *, sum(CASE WHEN level IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY i) AS before FROM line)),
-- own lines: of a run before a quote, none behind the last one with words, nor that one if it names an author
last AS (SELECT r, g, max(i) FILTER (WHERE regexp_matches(l, '\S')) AS i, max(i) AS stop FROM run WHERE level = 0 GROUP BY r, g),
author AS (
  SELECT last.r, last.g, len(w) > 1 AND (w[-1] IN ('wrote', 'schrieb', 'écrit', 'escribió') OR
         w[1] IN ('on', 'am', 'le', 'el') AND list_has_any(w, ['wrote', 'schrieb', 'écrit', 'escribió'])) AS names
  FROM last JOIN (SELECT r, i, regexp_extract_all(lower(l), '[\p{L}\p{N}]+') AS w, l FROM run) x ON x.r = last.r AND x.i = last.i WHERE regexp_matches(l, ':\s*$')),
size AS (SELECT r, max(i) AS n, max(level) AS deepest, count(DISTINCT g) FILTER (WHERE level > 0) AS passages FROM run GROUP BY r),
own AS (
  SELECT run.r, run.i, l FROM run JOIN last USING (r, g) JOIN size USING (r) LEFT JOIN author a USING (r, g)
  WHERE level = 0 AND (last.stop = size.n OR run.i < last.i OR run.i = last.i AND NOT coalesce(names, false))),
clean AS (
  SELECT raw.r, raw.conv, raw.turn, raw.role, passages, CASE WHEN deepest = 0 THEN raw.text ELSE trim(coalesce(t, ''), chr(10)) END AS t
  FROM raw JOIN size USING (r) LEFT JOIN (SELECT r, string_agg(l, chr(10) ORDER BY i) AS t FROM own GROUP BY r) USING (r)),
passage AS (
  SELECT r, conv, turn, dense_rank() OVER (PARTITION BY r ORDER BY g) - 1 AS passage, level, t
  FROM (SELECT r, conv, turn, g, level, string_agg(regexp_replace(l, '^[ \t]?(?:>[ \t]?)+', ''), chr(10) ORDER BY i) AS t FROM run WHERE level > 0 GROUP BY ALL)),
part AS (
  SELECT conv, turn, CAST(NULL AS BIGINT) AS passage, CAST(NULL AS BIGINT) AS level, unnest(PARTS) AS part FROM clean UNION ALL
  SELECT conv, turn, passage, level, unnest(PARTS) FROM passage),
key AS (
  SELECT conv, turn, passage, level, array_to_string(w, ' ') AS k, len(w) AS words
  FROM (SELECT *, regexp_extract_all(lower(part), '[\p{L}\p{N}]+') AS w FROM part) WHERE len(w) > 0 AND conv IS NOT NULL AND turn IS NOT NULL),
first AS (SELECT conv, k, min(turn) AS source FROM key WHERE passage IS NULL GROUP BY conv, k),
cited AS (SELECT DISTINCT conv, turn, passage, level, k, words FROM key WHERE passage IS NOT NULL),
votes AS (SELECT conv, turn, passage, level, source, sum(words) AS words FROM cited JOIN first USING (conv, k) WHERE source < turn GROUP BY ALL),
best AS (SELECT conv, turn, passage, level, source FROM (SELECT *, row_number() OVER (PARTITION BY conv, turn, passage, level ORDER BY words DESC, source DESC) AS n FROM votes) WHERE n = 1),
links AS (SELECT conv, turn, source AS parent FROM (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY level, passage, source) AS n FROM best) WHERE n = 1),
path(conv, turn, p) AS (
  SELECT DISTINCT raw.conv, raw.turn, [raw.turn] FROM raw LEFT JOIN links l ON l.conv = raw.conv AND l.turn = raw.turn WHERE l.turn IS NULL UNION ALL
  SELECT l.conv, l.turn, list_append(path.p, l.turn) FROM path JOIN links l ON l.conv = path.conv AND l.parent = path.turn),
place AS (SELECT conv, turn, p[1] AS root_turn, len(p) - 1 AS depth, row_number() OVER (PARTITION BY conv, p[1] ORDER BY p) - 1 AS position FROM path WHERE conv IS NOT NULL AND turn IS NOT NULL)
SELECT c.conv AS conv_id, c.turn, c.role, CAST(c.passages AS BIGINT) AS n_passages, l.parent AS parent_turn, coalesce(root_turn, c.turn) AS root_turn,
       CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(coalesce(position, 0) AS BIGINT) AS position, sha256(c.t) AS clean_sha256
FROM clean c LEFT JOIN links l ON l.conv = c.conv AND l.turn = c.turn LEFT JOIN place p ON p.conv = c.conv AND p.turn = c.turn
""".replace(
    "PARTS",
    r"list_distinct([t] || string_split_regex(t, '\n[ \t\r]*\n') || string_split(t, chr(10)) || string_split_regex(regexp_replace(t, '([.!?])\s+', '\1<cut>', 'g'), '<cut>'))",
)
