"""Ids that are no whole numbers, and the order of very long words' parts."""

import numpy as np
import pytest

from docloom.llm import ngram_join, packing, quotes, spm_sampling, substring


@pytest.mark.parametrize("operator", [ngram_join.near_duplicates, substring.remove_repeats, packing.place])
def test_text_ids_are_refused_before_anything_runs(spark, operator):
    with pytest.raises(TypeError, match="doc_id must hold whole numbers, not string"):
        operator(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))
    small = spark.createDataFrame([(1, "x y")], "doc_id short, text string")
    assert operator(small).count() == 1


def test_text_turns_are_refused(spark):
    with pytest.raises(TypeError, match="turn must hold whole numbers"):
        quotes.link_quotes(spark.createDataFrame([(1, "a", "x", "user")], "conv_id long, turn string, text string, role string"))


def test_rows_without_a_key_pass_by_linked_ones(spark):
    rows = [(1, 0, "See you at noon.", "user"), (1, 1, "> See you at noon.\nYes", "user"), (None, 0, "a", "user"), (None, 0, "a", "user"), (1, None, "> See you at noon.", "user")]
    got = sorted(map(str, quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")).select("conv_id", "turn", "parent_turn", "root_turn", "depth", "position").collect()))
    want = [(1, 0, None, 0, 0, 0), (1, 1, 0, 0, 1, 1), (1, None, None, None, 0, 0), (None, 0, None, 0, 0, 0), (None, 0, None, 0, 0, 0)]
    assert got == sorted(f"Row(conv_id={a}, turn={b}, parent_turn={c}, root_turn={d}, depth={e}, position={f})" for a, b, c, d, e, f in want)


def test_order_within_words_of_any_length():
    token, offset = np.array([1, 0, 1, 0, 2]), np.array([0, 1 << 30, 5, 3, 0])
    assert spm_sampling._by_token(token, offset).tolist() == [3, 1, 0, 2, 4]
    assert spm_sampling._by_token(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
