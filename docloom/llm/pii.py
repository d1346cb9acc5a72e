"""Personal data: exact base rules, and further candidates judged by boosted trees.

Generators with high recall propose spans of further kinds, which may overlap.  Each candidate gets features of its
format and of the characters and words around it; gradient-boosted trees give a score, Platt scaling a probability,
and a threshold for each kind, chosen on rows that were not trained on, selects spans.  Of selected spans that
overlap the likelier stays; a base span always stays, and no other span overlaps it.

No table has labels for personal data, so the trees are trained on invented candidates: ``TRAINING_ROWS`` sentences
from the formats and contexts below with a fixed seed, a bounded sample that does not depend on the corpus.

Every scan is linear in the text, also in very long runs without spaces.  Spans are in code points, end exclusive.

Features look at ``BEFORE`` characters in front of a candidate and ``AFTER`` behind it, as the trees do when they are
trained; the spans themselves have no limit of length but that of their formats (an IBAN, a telephone number).

Defined results: null and empty texts have no spans; repeated rows are each returned; of equally likely candidates that
overlap the one that starts first stays, then the shorter one, then the kind that is first by name; an empty table gives
an empty table; extra columns are carried only if named in ``carry``, and one that is named ``found`` or ``redacted``
comes out with ``_in`` behind it.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._boosting import BoostedTrees
from ._names import Carried, quoted

BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban", "tel", "mail")
KINDS = BASE + ADDED
#: Invented sentences that the trees are trained and calibrated on.
TRAINING_ROWS = 6000
TARGET_PRECISION = 0.98
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[@+0-9]|[\[(] ?[aA][tT]")
_DIGITS = re.compile(r"[0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), []
        for part in run[0].split("."):
            parts = [*parts, (at, at + len(part))] if part else []
            at += len(part) + 1
            if len(parts) == 4:
                if all(y - x <= 3 or not text[x : y - 3].strip("0") for x, y in parts) and all(int(text[max(x, y - 3) : y]) <= 255 for x, y in parts):
                    yield parts[0][0], parts[3][1]
                parts = []


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by kind and start."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        found += [("ip", s, e) for s, e in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return found


# ---- candidates ------------------------------------------------------------------------------------------------

_GENERATORS = {
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "tel": re.compile(r"(?<![0-9A-Za-z.+#=-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+#=-])[0-9]{9,11}(?![0-9A-Za-z.])"),
}
_AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]{2,})+")
#: Characters in front of a candidate and behind it that features look at.
BEFORE, AFTER = 40, 24
#: Words near a candidate, by what they speak for; fixed values.
_CONTEXT = {
    "call": ("tel", "phone", "call", "mobile", "cell", "fax", "telefon", "handy", "anruf", "teléfono", "móvil", "téléphone", "portable", "contact", "whatsapp"),
    "person": ("ssn", "social security", "taxpayer", "insurance number", "national id", "passport"),
    "bank": ("iban", "account", "konto", "cuenta", "compte", "bank", "transfer", "überweis", "virement"),
    "write": ("mail", "write", "contact", "schreib", "correo", "courriel", "reach"),
    "thing": ("order", "invoice", "version", "isbn", "page", "part", "serial", "model", "ticket", "no.", "nr", "price", "$", "€", "usd", "eur", "date", "year", "born", "score", "ref"),
}


def candidate_spans(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    found: list[Span] = []
    for kind, pattern in _GENERATORS.items():
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found + [("mail", s, e) for s, e in _spelled_mails(text)]


def _spelled_mails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled-out at sign: local characters to its left, a domain to its right."""
    end = 0
    for at in _AT.finditer(text) if "(" in text or "[" in text else ():
        start = at.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED.match(text, at.end()) if start < at.start() else None
        if domain:
            end = domain.end()
            yield start, end


def _mod97(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, its neighbours, and words of the context."""
    span = text[start:end]
    digits, groups = _only_digits(span), _DIGITS.findall(span) or [""]
    before, after = text[max(0, start - BEFORE) : start].lower(), text[end : end + AFTER].lower()
    near = before[-1:] or " ", after[:1] or " "
    sizes = [len(g) for g in groups]
    first = int(groups[0][:4] or 0)
    return [
        ADDED.index(kind),
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        len(groups),
        max(sizes),
        min(sizes),
        sizes[0],
        sizes[-1],
        *(span.count(c) for c in " -./("),
        len(set(digits)),
        float(digits[:1] == "0"),
        float(1900 <= first <= 2099 and sizes[0] == 4),
        float(sizes[-1] == 4 and 1900 <= int(groups[-1] or 0) <= 2099),
        float(len(groups) == 3 and all(1 <= n <= 2 for n in sizes[:2]) and int(groups[0] or 0) <= 31),
        float(sizes[0] == 3 and (digits[:3] in ("000", "666") or digits[:1] == "9")),
        float(kind == "iban" and _mod97(span)),
        float(len(digits) > 1 and luhn(digits)),
        *(float(c.isspace()) for c in near),
        *(float(c in "([{\"'<") for c in near),
        *(float(c in ".,;:)]") for c in near),
        *(float(any(w in before for w in words)) for words in _CONTEXT.values()),
        float(any(w in after for w in _CONTEXT["thing"])),
    ]


# ---- training --------------------------------------------------------------------------------------------------


def _iban(r: random.Random) -> str:
    body = "".join(r.choice("0123456789") for _ in range(r.choice((14, 18, 20))))
    country = r.choice(("DE", "FR", "ES", "NL", "GB"))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def invented(rows: int, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of invented candidates."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = "the of and report then when with some les des und der para este mit dans near open page line value part item".split()
    words = lambda k: " ".join(r.choice(filler) for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def spaced(x: str) -> str:
        return " ".join(x[i : i + 4] for i in range(0, len(x), 4)) if r.random() < 0.6 else x

    good = {
        "ssn": lambda: (r.choice(("SSN ", "social security number ", "SSN: ", "taxpayer id ", "")), f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{n(4)}"),
        "iban": lambda: (r.choice(("IBAN ", "IBAN: ", "account ", "Konto ", "cuenta ", "")), spaced(_iban(r))),
        "tel": lambda: r.choice(
            (
                (r.choice(("", "call ", "phone ", "tel. ", "mobile: ")), f"({r.randint(201, 989)}) {r.randint(200, 999)}-{n(4)}"),
                (r.choice(("call ", "phone: ", "tel ", "Tel.: ", "mobile ", "fax ", "Telefon ", "móvil ", "portable ")), f"{r.randint(201, 989)}-{r.randint(200, 999)}-{n(4)}"),
                (r.choice(("tel ", "Telefon: ", "téléphone ", "teléfono ", "phone ", "Handy ", "whatsapp ")), f"0{n(2)} {n(4)} {n(4)}"),
                (r.choice(("téléphone ", "tel: ", "portable ", "call ")), f"0{n(1)}.{n(2)}.{n(2)}.{n(2)}.{n(2)}".replace(".", r.choice((".", " ", "-")))[1:] if r.random() < 0 else f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}"),
                (r.choice(("mobile ", "cell: ", "phone ", "whatsapp ")), f"0{n(9)}"),
            )
        ),
        "mail": lambda: (r.choice(("mail ", "write to ", "contact ", "", "reach me: ")), f"{name()}{r.choice((' (at) ', ' [at] ', '(at)', '[AT]'))}{name()}{r.choice((' (dot) ', ' [dot] ', '.'))}{r.choice(('com', 'org', 'net', 'de'))}"),
    }
    bad = {
        "ssn": lambda: (r.choice(("order ", "part ", "serial ", "ref ", "ticket ")), f"{r.choice(('000', '666', '9' + n(2), n(3)))}-{n(2)}-{n(4)}"),
        "iban": lambda: (r.choice(("model ", "serial ", "part ", "", "ref ")), spaced("".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + n(2) + "".join(r.choice("ABCDEF0123456789") for _ in range(r.choice((12, 16, 20)))))),
        "tel": lambda: r.choice(
            (
                (r.choice(("", "on ", "date ", "born ", "since ")), f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
                (r.choice(("", "on ", "date ", "am ")), f"{r.randint(1, 28):02d}{(s := r.choice('./-'))}{r.randint(1, 12):02d}{s}{r.randint(1900, 2030)}"),
                (r.choice(("", "price ", "about ", "total ")), f"{r.randint(10, 99)} {n(3)} {n(3)}"),
                (r.choice(("pages ", "", "years ", "score ")), f"{r.randint(10, 999)}-{r.randint(10, 999)}"),
                (r.choice(("order ", "invoice ", "isbn ", "serial ", "ref ", "", "nr ")), n(r.randint(9, 11))),
                (r.choice(("isbn ", "part ", "order ", "", "version ")), f"{n(3)}-{n(2)}-{n(4)}-{n(2)}"),
                (r.choice(("", "id ", "ref ", "ticket ")), f"{n(4)} {n(4)} {n(4)} {n(4)}"),
                (r.choice(("", "value ", "sizes ")), f"{n(3)} {n(4)}"),
                (r.choice(("", "values ", "rows ")), f"{n(2)} {n(2)} {n(3)}"),
            )
        ),
        "mail": lambda: (r.choice(("", "look ", "sale ")), f"{name()} (at) {name()}.{r.choice(('next', 'once', 'that', 'line'))}"),
    }
    out = []
    for i in range(rows):
        kind, label = ADDED[i % 4], int(r.random() < 0.5)
        before, span = (good if label else bad)[kind]()
        text = f"{words(r.randint(0, 6))} {before}{span}{r.choice((' ', '.', ', ', ''))}{'' if r.random() < 0.2 else ' ' + words(r.randint(1, 5))}"
        start = text.index(span)
        met = [c for c in candidate_spans(text) if c[0] == kind and c[1] < start + len(span) and c[2] > start]
        out += [(text, kind, s, e, int(label and (s, e) == (start, start + len(span)))) for _, s, e in met]
    return out


@functools.lru_cache(maxsize=4)
def trained(rows: int = TRAINING_ROWS, precision: float = TARGET_PRECISION, seed: int = 7) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees, and each added kind's least probability."""
    data = invented(rows, seed)
    x = np.array([features(t, k, s, e) for t, k, s, e, _ in data])
    y = np.array([d[4] for d in data], float)
    hold = np.arange(len(y)) % 3 == 0
    model = BoostedTrees().fit(x[~hold], y[~hold]).calibrate(x[hold], y[hold])
    p = model.probability(x[hold])
    limits = []
    for kind in range(len(ADDED)):
        own = x[hold][:, 0] == kind
        order = np.argsort(-p[own])
        right = np.cumsum(y[hold][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        limits.append(max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1)
    return model, tuple(limits)


def find_spans(text: str, model: BoostedTrees, limits: Sequence[float]) -> list[Span]:
    """Base spans, then selected ones; each by kind and start."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    proposed = candidate_spans(text)
    if not proposed:
        return base
    p = model.probability(np.array([features(text, *c) for c in proposed]))
    chosen = sorted((-q, s, e, k) for (k, s, e), q in zip(proposed, p, strict=True) if q >= limits[ADDED.index(k)])
    taken = _Taken((s, e) for _, s, e in base)
    added = [(k, s, e) for _, s, e, k in chosen if taken.add(s, e)]
    return base + sorted(added, key=lambda x: (ADDED.index(x[0]), x[1]))


class _Taken:
    """Ranges that are in use, in blocks so that each look-up is short."""

    def __init__(self, ranges: Iterable[tuple[int, int]]):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for s, e in ranges:
            self._put(s, e)

    def _put(self, s: int, e: int) -> None:
        for b in range(s >> 7, (e >> 7) + 1):
            self.blocks.setdefault(b, []).append((s, e))

    def add(self, s: int, e: int) -> bool:
        if any(x < e and s < y for b in range(s >> 7, (e >> 7) + 1) for x, y in self.blocks.get(b, ())):
            return False
        self._put(s, e)
        return True


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at, end, name = [], 0, -1, ""
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            end = max(end, e)
            continue
        if name:
            out.append(f"[{name}]")
            at = end
        out.append(text[at:s])
        at, end, name = s, e, kind.upper()
    if name:
        out.append(f"[{name}]")
        at = end
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(model: BoostedTrees, limits: Sequence[float], with_text: bool):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("_text")]
            found = [find_spans(t, model, limits) for t in texts]
            arrays = [batch.column("_rest"), pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in f] for f in found], kind)]
            if with_text:
                arrays.append(pa.array([redact(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["_rest", "found", "redacted"][: len(arrays)])

    return run


def find_pii(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``carry`` and ``found`` (spans by kind and start) for each row; ``with_text`` adds the ``redacted`` text."""
    carried = Carried(carry, ("found", *["redacted"] * with_text))
    rows = docs.select(carried.struct().alias("_rest"), quoted(text_col).cast("string").alias("_text"))
    schema = f"_rest {rows.schema['_rest'].dataType.simpleString()}, found {_SPANS}" + ", redacted string" * with_text
    return rows.mapInArrow(_scan(*trained(), with_text), schema).select(*carried.columns("_rest"), "found", *["redacted"] * with_text)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
