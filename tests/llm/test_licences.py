import random
import textwrap

from docloom.llm import licences as L


def brute(text):
    """Every unit against every template, without bounds."""
    sets = [(name, L.bigrams(L._WORD.findall(t.lower()))) for name, t in L.TEMPLATES]
    units = [("text", text)]
    paragraphs = L._PARAGRAPH.split(text)
    for p in paragraphs:
        units += [("paragraph", p)] * (len(paragraphs) > 1)
        lines = p.split("\n")
        for line in lines:
            units += [("line", line)] * (len(lines) > 1)
            parts = L._SENTENCE.split(line)
            units += [("sentence", s) for s in parts if len(parts) > 1]
    out = []
    for unit, t in units:
        own = L.bigrams(L._WORD.findall(t.lower()))
        best = max(((L.dice(own, s), -i, name) for i, (name, s) in enumerate(sets) if own), default=(0,))
        if best[0] >= L.THRESHOLD - 1e-9:
            out.append((best[2], unit, best[0]))
    return out


def test_bounds_drop_nothing():
    mit = next(t for n, t in L.TEMPLATES if len(t) > 600 and n == "MIT")
    words = mit.split()
    texts = ["", "no licence here", "All rights reserved.", "all RIGHTS -- reserved", "Intro line\nReleased under the MIT License.\nend of the text", mit, mit.replace("Software", "Program"), "A title\n\n" + mit + "\n\nThe end.", " ".join(words[: len(words) // 2]), " ".join(words[:-30]), "Text. Licensed under the Apache License, Version 2.0. More text follows here.", "of the " * 50]
    matcher = L.Matcher()
    for t in texts:
        assert matcher.scan(t) == brute(t), t
    assert matcher.scan(mit)[0][0] == "MIT" and not matcher.scan(texts[8])


def test_table(frame):
    rows = [(1, None), (2, ""), (3, "Some words.\nLicensed under CC BY-NC 4.0."), (3, "x"), (4, "word " * 50_000)]
    got = L.scan_licences(frame(rows), carry=("doc_id", "source")).collect()
    assert len(got) == 5
    assert [(x["licence"], x["unit"]) for r in got if r["doc_id"] == 3 for x in r["found"]] == [("CC-BY-NC-4.0", "text"), ("CC-BY-NC-4.0", "line")]
    assert L.scan_licences(frame([])).count() == 0


def laid_out(text, parts, width=70):
    """A notice in paragraphs of wrapped lines."""
    words = text.split()
    step = -(-len(words) // parts)
    return "\n\n".join(textwrap.fill(" ".join(words[i : i + step]), width) for i in range(0, len(words), step))


def test_notices_inside_long_texts():
    matcher = L.Matcher()
    before, after = ("\n\n".join(" ".join(f"{w}{i + j}" for j in range(60)) for i in range(0, 600, 60)) for w in "xy")
    for name in ("MIT", "Apache-2.0", "GPL-3.0"):
        notice = max((t for n, t in L.TEMPLATES if n == name), key=len)
        found = [f for f in matcher.scan(f"{before}\n\n{laid_out(notice, 3)}\n\n{after}") if f[1] == "run"]
        assert found == [(name, "run", 1.0)]
    cc = "This work is licensed under a Creative Commons\nAttribution 4.0 International License."
    assert matcher.scan(f"Some words before it.\n{cc}\nAnd some more that follow\n{before}") == [("CC-BY-4.0", "run", 1.0)]


def test_runs_against_all_windows():
    r = random.Random(3)
    templates = [("A", "a b c d e f"), ("B", "b c d x")]
    matcher = L.Matcher(templates)
    sets = [L.bigrams(t.split()) for _, t in templates]
    for _ in range(300):
        words = [r.choice("abcdefxyz") if r.random() < 0.4 else "abcdef"[i % 6] for i in range(r.randrange(30))]
        best = max((L.dice(L.bigrams(words[i:j]), s) for s in sets for i in range(len(words)) for j in range(i + 2, len(words) + 1)), default=0)
        got = matcher.runs(words)
        assert bool(got) == (best >= L.THRESHOLD - 1e-9) and (not got or max(g[0] for g in got) == best)


def test_time_grows_with_the_text_when_every_line_is_a_notice():
    """Matches are compared with their neighbours only: 260 kB of one-line notices, each found."""
    import time

    line = "Licensed under the MIT License.\n"
    matcher = L.Matcher(L.TEMPLATES, L.THRESHOLD)
    assert matcher.scan(line)
    began = time.process_time()
    one = len(matcher.scan(line * 1000))
    first = time.process_time() - began
    assert one >= 1000 and len(matcher.scan(line * 8000)) >= 8000
    assert time.process_time() - began - first < 12 * max(first, 0.05)
