import random
import re

import pytest

from docloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    out = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))
    return {(r["conv_id"], r["turn"]): r for r in out.collect()}


def test_nested_levels_are_parsed_and_removed():
    clean, quoted = quotes.parse("Yes.\n\nOn Monday Ann wrote:\n> Shall we go?\n>> I like the sea.\n> Really.\nFine")
    assert clean == "Yes.\n\nFine"
    assert quoted == [(1, "Shall we go?"), (2, "I like the sea."), (1, "Really.")]


def test_replies_follow_what_they_quote(spark):
    rows = [
        (1, 0, "user", "The first plan is to walk all day."),
        (1, 1, "user", "A second plan would be the boat trip."),
        (1, 2, "assistant", "> the FIRST plan is to walk\n> all day.\nToo far for me."),
        (1, 3, "user", ">> The first plan is to walk all day.\n> Too far for me.\nThen the bus it is."),
        (1, 4, "user", "> Nobody ever said these words here.\nHm."),
        (2, 1, "user", "> The first plan is to walk all day.\nother conversation"),
    ]
    got = linked(spark, rows)
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, None, 0, 2, None]
    assert (got[1, 3]["depth"], got[1, 3]["root_turn"], got[1, 3]["position"]) == (2, 0, 2)
    assert got[1, 3]["clean"] == "Then the bus it is." and got[1, 4]["clean"] == "Hm."
    assert got[2, 1]["parent_turn"] is None
    order = quotes.conversations(quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))).filter("conv_id = 1").coalesce(1).collect()
    assert [m["turn"] for m in order] == [0, 2, 3, 1, 4]


def test_edges(spark):
    rows = [(None, 0, "user", "> x y z w v"), (1, None, "user", None), (1, 0, None, ""), (1, 0, None, ""), (1, 1, "user", "> future words that come later on\nno"), (1, 2, "user", "future words that come later on")]
    out = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6 and all(r["parent_turn"] is None for r in out)
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_order(parent):
    """turn -> (root, depth, position) by a plain walk; ``parent`` is None for first messages."""
    out = {}
    for root in sorted(t for t, p in parent.items() if p is None):
        stack, n = [(root, 0)], 0
        while stack:
            t, depth = stack.pop()
            out[t] = (root, depth, n)
            n += 1
            stack += [(k, depth + 1) for k in sorted((k for k, p in parent.items() if p == t), reverse=True)]
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_order_of_threads_against_a_plain_walk(spark, shape, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    r = random.Random(len(shape))
    base = 10**12 - 30  # turns of more digits than the others
    turns = [*range(-5, 20), *range(base, base + 60)]
    parent = {turns[0]: None}
    for i, t in enumerate(turns[1:], 1):
        parent[t] = {"chain": turns[i - 1], "star": turns[0], "random": r.choice([None, *turns[:i]])}[shape]
    links = spark.createDataFrame([(7, t, p) for t, p in parent.items() if p is not None], "conv long, turn long, parent long")
    got = {x["turn"]: (x["root_turn"], x["depth"], x["position"]) for x in quotes.thread_order(links).collect()}
    linked_turns = {t for t, p in parent.items() if p is not None} | {p for p in parent.values() if p is not None}
    assert got == {t: x for t, x in brute_order(parent).items() if t in linked_turns}


def planted(n, seed):
    """Conversations whose messages quote earlier ones, whole or in part, nested and with introductions."""
    r = random.Random(seed)
    word = lambda: r.choice("río École Über sonne sea walk plan bus day 42 tea no yes".split()) + (r.choice("xyz") if r.random() < 0.5 else "")
    rows = []
    for conv in range(n):
        said = []
        for turn in range(r.randrange(1, 12)):
            own = "\n".join(" ".join(word() for _ in range(r.randrange(1, 6))) + r.choice([".", "!", "", ". Yes.", "?"]) for _ in range(r.randrange(1, 4)))
            text = own
            if said and r.random() < 0.8:
                earlier = r.choice(said)
                part = r.choice([earlier, earlier.split("\n")[-1], r.choice(re.split(r"(?<=[.!?])\s+", earlier))])
                quote = "\n".join(r.choice(["> ", ">", " > "]) + x for x in part.upper().split("\n"))
                intro = r.choice(["", "On Monday Ann wrote:\n", "Ann schrieb: \n\n", "Plain line:\n"])
                text = r.choice(["", "Ok.\n"]) + intro + quote + r.choice(["\n", "\n\n"]) + own
                if r.random() < 0.3:
                    text += "\n> " + r.choice(said).replace("\n", "\n>> ")
            said.append(text)
            rows.append((conv, turn * 3, r.choice(["user", None]), text))
    rows += [(None, 1, "user", "> a"), (0, None, "user", "On Monday he wrote:\n> b\nc"), (1, 0, rows[1][2], None), rows[2], (99, 5, "user", "")]
    return rows


def test_query_against_sql_on_planted_quotes(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "conversations.parquet")
    rows = planted(120, 4)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    got = quotes.op9_quote_links(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = c.sql(quotes.OP9_SQL)
    assert got.columns == want.columns
    key = lambda x: [str(v) for v in x]
    rows_got, rows_want = sorted(map(tuple, got.collect()), key=key), sorted(want.fetchall(), key=key)
    assert rows_got == rows_want
    assert sum(x[4] is not None for x in rows_got) > 150 and max(x[6] for x in rows_got) > 3


def test_clashing_columns_and_long_texts(spark):
    long = "\n".join(f"> line {i} of it" for i in range(30_000))
    rows = [(1, 0, "p", "line 7 of it", 1), (1, 1, "q", f"{'x ' * 500}wrote:\n{long}\nend", 2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, position string, text string, Clean int")
    got = sorted(quotes.link_quotes(table, carry=("position", "Clean")).collect(), key=lambda x: x["turn"])
    assert [(x["parent_turn"], x["position"], x["position_in"], x["Clean_in"]) for x in got] == [(None, 0, "p", 1), (0, 1, "q", 2)]
    assert got[1]["clean"] == "end"


def test_short_parts_of_longer_messages_are_found(spark):
    rows = [
        (1, 0, "user", "Sounds good.\nSee you on Monday at the station."),
        (1, 1, "user", "The train leaves at nine. No. It does not."),
        (1, 2, "assistant", "> Sounds good.\nYes."),
        (1, 3, "assistant", "> No.\nWhy?"),
        (1, 4, "user", ">> Sounds good.\n> Yes.\nFine."),
        (1, 5, "user", "No.\nSounds good, all of this together now."),
        (1, 6, "assistant", "> Sounds good.\n> See you on Monday at the station.\nAgreed."),
    ]
    got = linked(spark, rows)
    assert [got[1, t]["parent_turn"] for t in range(7)] == [None, None, 0, 1, 2, None, 0]
    assert (got[1, 4]["root_turn"], got[1, 4]["depth"]) == (0, 2)
