import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import _text as t

TEXT = st.text(alphabet="ab \t\n\x0b\x0c\r\x1cč€", max_size=60)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_split(text):
    data = text.encode()
    starts, ends = t.word_bounds(data)
    assert [data[s:e] for s, e in zip(starts, ends, strict=True)] == data.split()
    hashes = t.word_hashes(data)
    assert len({(w, h) for w, h in zip(data.split(), hashes.tolist(), strict=True)}) == len(set(data.split()))


def test_hashes_do_not_depend_on_place_or_block():
    parts = [b"a", b"x" * 70000, b"bb", b"y" * 65536, b"z" * 65535, b"c"] * 2 + [b"w%d" % i for i in range(30000)]
    whole = t.word_hashes(b" ".join(parts))
    assert (whole == np.array([t.word_hashes(p)[0] for p in parts])).all()
    grams = t.gram_hashes(whole, 7)
    for i in (0, 3, 11, len(grams) - 1):
        assert grams[i] == t.gram_hashes(whole[i : i + 7], 7)[0]
    assert not len(t.gram_hashes(whole[:6], 7))
    for k in (1, 2, 5, 8, 50):
        runs = {tuple(whole[i : i + k].tolist()) for i in range(300 - k)}
        assert len(set(t.gram_hashes(whole[:299], k).tolist())) == len(runs)
    one, two = t.word_digests(parts)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(set(parts)) and not set(one.tolist()) & set(two.tolist())


@given(st.lists(st.integers(0, 9), max_size=80), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_sliding_argmin_takes_the_first(values, width):
    v = np.array(values, np.uint64)
    expected = [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]
    assert t.sliding_argmin(v, width).tolist() == expected
