import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pii

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    return [(k, *m.span()) for k, (p, ok) in RULES.items() for m in re.finditer(p, text) if ok(m[0])]


@given(st.text(alphabet="0123456789.@+-ab %()\n", max_size=70))
@settings(max_examples=400, deadline=None)
def test_base_spans_are_those_of_the_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_on_planted_values():
    text = "a@b.co 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (555) 555-2485. x@y @z.q 0.0.0.256"
    assert pii.base_spans(text) == brute(text) and len(pii.base_spans(text)) == 4


def test_held_out_accuracy():
    model, limits = pii.trained()
    rows = pii.invented(2000, seed=1234)
    x = np.array([pii.features(t, k, s, e) for t, k, s, e, _ in rows])
    y = np.array([r[4] for r in rows])
    chosen = model.probability(x) >= np.array(limits)[x[:, 0].astype(int)]
    assert (chosen == y).mean() > 0.97 and y[chosen].mean() > 0.97
    p = model.probability(x)
    assert abs(p[(p > 0.8)].mean() - y[p > 0.8].mean()) < 0.05


def test_added_spans_do_not_touch_base_spans(frame):
    rows = [(0, None), (1, ""), (2, "mail ann@site.org, SSN 123-45-6789, call (415) 555-0199 or 10.1.2.3"), (2, "x"), (3, "order 12-34 of 2024-05-06, pages 10-20"), (4, "9" * 100_000 + "a" * 100_000)]
    got = pii.find_pii(frame(rows), carry=("doc_id", "lang"), with_text=True).collect()
    assert len(got) == 6
    two = next(r for r in got if r["doc_id"] == 2 and len(r["redacted"]) > 1)
    assert [s["kind"] for s in two["found"]] == ["email", "ip", "ssn", "tel"]
    assert two["redacted"] == "mail [EMAIL], SSN [SSN], call [TEL] or [IP]"
    assert not next(r for r in got if r["doc_id"] == 3)["found"]
    assert pii.find_pii(frame([])).count() == 0


def test_redaction_of_overlaps():
    assert pii.redact("abcdefgh", [("card", 1, 5), ("phone", 3, 7)]) == "a[CARD]h"
    assert pii.redact("abc", []) == "abc"
