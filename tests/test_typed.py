"""Typed documents of invented sources, in the forms in which real ones are written."""

from datetime import date, datetime

from docloom.sources import typed as S
from docloom.sources.front_matter import parse_documents

HEAD = "---\nzdroj: https://x.example/1\nnazev: 'N'\ntyp: {typ}\nviditelnost: verejne\nstazeno: '2026-10-06'\n"

MEDIA = (
    HEAD.format(typ="clanek-media")
    + """datum: '2014-01-26'
pocet_clanku: 3
zdroj_monitoringu: Google News, RSS
---

# Články, leden 2014

Úvod.

### 26. 1. 2014

- **Děti měsíce** (Týdeník (č. 5)) [odkaz](https://a.example/1) · zmíněni: Jan Nový, Eva Malá
- **Děti úplňku** (Respekt) [odkaz](https://a.example/2) · zmíněni: Jan Nový

### 21. 1. 2014

- **Knihy: proč jsou *levné*** (Lupa) [odkaz](https://a.example/3)
- poznámka bez článku
"""
)
SOCIAL = (
    HEAD.format(typ="prispevek-socialni-site")
    + """datum: '2025-06-18T12:33:08Z'
osoba: 'Eva Malá '
platforma: x
ucet: EvaMala
pocet_prispevku: 2
---

# Příspěvky

Autor.

### 2025-06-18 12:33 UTC (odpověď)

@nekdo Ne.
Druhý řádek

Odkaz: <https://x.com/EvaMala/status/1> · 18 lajků, 0 repostů, 1 odpovědí

### 2025-06-17 08:00 UTC

Text bez odkazu
"""
)
SENATE = (
    HEAD.format(typ="hlasovani")
    + """datum: '2020-02-19'
---

# Hlasování

## 16. schůze Senátu (12. funkční období), 2020-02-19
- č. 1 (2020-02-19): Volba předsedy (určení; druhé kolo); výsledek Prijato; Jan Nový: pro; Eva Malá: zdržel se; Jan Nový: proti
- č. 2 (2020-02-19): Pořad; výsledek neprijato
- jiný řádek
"""
)
UNIT = (
    HEAD.format(typ="organizacni-jednotka")
    + """druh: tym
zkratka: null
nadrazeny: neuvedeno
podrazene: []
kontakty: a@x.example
role:
- jmeno: Jan Nový
  role: zastupitel
  sekce: zastupitelé
pocet_clenu: 0
pocet_priznivcu: mnoho
---

# ZK
"""
)
CITY = HEAD.format(typ="usneseni") + "organ: ZHMP\ncislo: '10/1'\nhlasovani:\n- '9007199254740993'\n- x\nprogramove: ano\nucinnost: '2019-02-30'\n---\n\n# U\n"
CHAMBER = HEAD.format(typ="usneseni") + "hlasovani:\n  pro: '7'\n  proti: '1'\n---\n\n# U\n"


def docs(spark, *texts):
    return parse_documents(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, value string"))


def test_media_and_social_months(spark):
    d = docs(spark, MEDIA, SOCIAL, MEDIA.replace("pocet_clanku: 3", "pocet_clanku: 9"), "no front matter")
    rows = S.typed_rows(d, "clanek-media")
    assert {(r["path"], r["pocet_clanku"], r["datum"]) for r in rows.collect()} == {("d0", 3, date(2014, 1, 26)), ("d2", 9, date(2014, 1, 26))}
    items = [tuple(r)[1:] for r in S.media_items(rows.filter("path = 'd0'")).orderBy("poradi").collect()]
    assert [(i[0], i[1], i[4]) for i in items][1:] == [(2, date(2014, 1, 26), "https://a.example/2"), (3, date(2014, 1, 21), "https://a.example/3")]
    assert items[1][2:4] == ("Děti úplňku", "Respekt") and items[1][5] == ["Jan Nový"] and items[2][2] == "Knihy: proč jsou *levné*" and items[2][5] == []
    assert [tuple(r) for r in S.media_days(S.media_items(rows.filter("path = 'd0'"))).collect()] == [(date(2014, 1, 26), 2), (date(2014, 1, 21), 1)]
    assert [tuple(r) for r in S.disagreements(d, "clanek-media").collect()] == [("d2", "pocet_clanku", 9, 3)]
    social = S.typed_rows(d, "prispevek-socialni-site")
    one = social.first()
    assert (one["osoba"], one["ucet"], one["ts"], one["datum"]) == ("Eva Malá", "EvaMala", datetime(2025, 6, 18, 12, 33, 8), date(2025, 6, 18))
    posts = [tuple(r)[1:] for r in S.social_posts(social).orderBy("poradi").collect()]
    assert posts == [(1, datetime(2025, 6, 18, 12, 33), "odpověď", "@nekdo Ne.\nDruhý řádek", "https://x.com/EvaMala/status/1", 18, 0, 1), (2, datetime(2025, 6, 17, 8, 0), "post", "Text bez odkazu", None, None, None, None)]
    assert S.disagreements(d, "prispevek-socialni-site").count() == 0


def test_votes_units_and_resolutions(spark):
    d = docs(spark, SENATE, UNIT, CITY, CHAMBER)
    votes = [tuple(r)[1:] for r in S.senate_votes(S.typed_rows(d, "hlasovani")).orderBy("poradi").collect()]
    assert votes == [(1, 16, 1, date(2020, 2, 19), "Volba předsedy (určení; druhé kolo)", "prijato", {"Jan Nový": "pro", "Eva Malá": "zdržel se"}), (2, 16, 2, date(2020, 2, 19), "Pořad", "neprijato", {})]
    unit = S.typed_rows(d, "organizacni-jednotka").first()
    assert (unit["zkratka"], unit["nadrazeny"], unit["podrazene"], unit["kontakty"], unit["pocet_clenu"], unit["pocet_priznivcu"]) == (None, None, [], ["a@x.example"], 0, None)
    assert [r.asDict() for r in unit["role"]] == [{"jmeno": "Jan Nový", "role": "zastupitel", "sekce": "zastupitelé"}]
    city, chamber = S.typed_rows(d, "usneseni").orderBy("path").collect()
    assert (city["cislo"], city["hlasovani"], city["tally"], city["programove"], city["ucinnost"]) == ("10/1", [9007199254740993, None], None, True, None)
    assert (chamber["hlasovani"], chamber["tally"].asDict()) == (None, {"pro": 7, "proti": 1, "zdrzel": None})


def test_every_type_reads_documents_of_any_other(spark):
    d = docs(spark, MEDIA, SOCIAL, SENATE, UNIT, CITY, CHAMBER, "", "---\n---\n")
    for typ in S.COLUMNS:
        assert S.typed_rows(d, typ).count() == {"clanek-media": 1, "prispevek-socialni-site": 1, "hlasovani": 1, "organizacni-jednotka": 1, "usneseni": 2}.get(typ, 0)


def test_feeds(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>https://a</link><pubDate>Wed, 19 Feb 2020 10:30:00 +0100</pubDate></item><item><title>C</title><pubDate>kdysi</pubDate></item></channel></rss>")
    got = [tuple(r) for r in S.read_feed(spark, str(tmp_path / "feed.xml")).orderBy("title").collect()]
    assert got == [("A & B", "https://a", datetime(2020, 2, 19, 9, 30), None), ("C", None, None, None)]
