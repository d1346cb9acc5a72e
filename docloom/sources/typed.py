"""Documents of each type as rows with typed columns, and what their bodies list as rows of their own.

``typed_rows`` takes documents (``attrs, lists, records, body``) of one type to the columns of ``COLUMNS``.  A value that does
not fit its type is null, never an error; a key that is sometimes a list and sometimes a single text is a list; the
texts that say that there is nothing (``neuvedeno``) are null.  ``items`` opens what a body lists, in the body's order.
``disagreements`` compares the numbers that documents state with what they list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions import dates
from ..functions import text as T

#: The columns of each type of document, beside the core ones.
COLUMNS = {
    "schuzka": "autor_url string, ucastnici_nasi array<string>, ucastnici_ostatni array<string>, publikovano timestamp, upraveno timestamp, odkaz_forum string",
    "usneseni": "organ string, organ_nazev string, cislo string, tisk string, rok int, druh string, vysledek string, ucinnost date, zmocneni string, programove boolean, forum_url string, zapis_url string, usneseni_url string, predkladatel string, predkladatel_pirati array<string>, hlasovani array<bigint>, tally struct<pro:int,proti:int,zdrzel:int>, jednani string, poradi int, cislo_jednaci string, ministr string, veklep string, odok_jednani string, tagy array<string>, vysledky array<string>",
    "tiskova-zprava": "ministr string, resort string, tagy array<string>, vysledky array<string>",
    "predpis": "zkratka string, vydal string, vydal_nazev string, druh string, platnost string, platnost_od date, ucinnost_od date, verze date, verze_historie array<struct<datum:date,zdroj:string>>",
    "organizacni-jednotka": "druh string, zkratka string, nadrazeny string, podrazene array<string>, kontakty array<string>, role array<struct<jmeno:string,role:string,sekce:string>>, pocet_clenu int, pocet_priznivcu int",
    "profil": "tituly array<string>, funkce string, telefon string, email array<string>, web array<string>, socialni_site array<string>",
    "stranka-webu": "web array<string>, web_url string, druh_webu string, region string, sdruzeni string, misto string, tagy array<string>, funkce string",
    "prispevek-socialni-site": "osoba string, platforma string, ucet string, pocet_prispevku int",
    "clanek-media": "pocet_clanku int, zdroj_monitoringu string",
    "prepis-videa": "kanal_url string, delka_s int, titulky string, osoba string, prenos boolean, jazyk_videa string",
    "interpelace": "druh string, osoba_psp string, obdobi int, pocet int, pocet_prednesenych int, interpelovani array<string>, tagy array<string>",
    "hlasovani": "organ string, obdobi int",
    "importovany-soubor": "stav string, kategorie string, format string, velikost bigint, hash string, generator string, dalsi_umisteni array<string>, poznamka string",
}
#: Columns whose key in the document has another name.
KEYS = {"tally": "hlasovani"}


def _texts(kind: StructType) -> StructType:
    """The fields as texts, as records keep them."""
    return StructType([StructField(f.name, StringType()) for f in kind.fields])


def _fields(x: Column, kind: StructType) -> Column:
    return F.when(x.isNotNull(), F.struct(*[x[f.name].try_cast(f.dataType).alias(f.name) for f in kind.fields]))


def _column(name: str, kind) -> Column:
    key = F.lit(KEYS.get(name, name))
    plain, listed, record = (F.try_element_at(F.col(c), key) for c in ("attrs", "lists", "records"))
    cleaned = T.sentinel_to_null(plain) if not name.startswith("pocet") else plain
    if isinstance(kind, StructType):
        return _fields(F.from_json(record, _texts(kind)), kind)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(F.from_json(record, ArrayType(_texts(kind.elementType))), lambda x: _fields(x, kind.elementType))
    if isinstance(kind, ArrayType):
        several = F.coalesce(listed, F.when(cleaned.isNotNull(), F.array(cleaned)))
        if isinstance(kind.elementType, StringType):
            return several
        return F.transform(several, lambda x: x.try_cast(kind.elementType))
    if isinstance(kind, BooleanType):
        return F.when(F.lower(cleaned).isin("true", "ano", "yes"), True).when(F.lower(cleaned).isin("false", "ne", "no"), False)
    return cleaned if isinstance(kind, StringType) else cleaned.try_cast(kind)


def typed_rows(docs: DataFrame, typ: str) -> DataFrame:
    """The documents of a type with core columns, those of ``COLUMNS`` and the body."""
    core = "zdroj string, nazev string, typ string, viditelnost string, stazeno date, autorita string, datum date, autor string"
    fields = [f for ddl in (core, COLUMNS[typ]) for f in StructType.fromDDL(ddl).fields]
    seen: set[str] = set()
    fields = [f for f in fields if not (f.name in seen or seen.add(f.name))]
    stamp = F.try_element_at("attrs", F.lit("datum"))
    ts = F.when(stamp.rlike(r"T\d\d:\d\d"), dates.to_utc(stamp)).alias("ts")
    mine = docs.filter(F.try_element_at("attrs", F.lit("typ")) == typ)
    cut = [F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(stamp, 1, 10)).try_cast("date").alias("datum") if f.name == "datum" else F.trim(_column(f.name, f.dataType)).alias(f.name) if isinstance(f.dataType, StringType) else _column(f.name, f.dataType).alias(f.name) for f in fields]
    return mine.select("path", *cut, ts, "body")


# ---- what bodies list ------------------------------------------------------------------------------------------


def _opened(rows: DataFrame, mark: str) -> DataFrame:
    """``path, part, heading, text`` of each part of a body, in order; what stands before the first heading is left out."""
    return rows.select("path", F.posexplode(T.sections(F.col("body"), mark)).alias("part", "s")).filter("part > 0").select("path", "part", "s.heading", "s.text")


def _lines(parts: DataFrame) -> DataFrame:
    """``path, part, heading, line_no, line``: the bullets of each part."""
    bullets = F.filter(F.split("text", "\n"), lambda x: x.startswith("- "))
    return parts.select("path", "part", "heading", F.posexplode(bullets).alias("line_no", "line"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``poradi`` from 1 within each document."""
    from pyspark.sql import Window

    return rows.withColumn("poradi", F.row_number().over(Window.partitionBy("path").orderBy(*order)))


def _got(pattern: str, i: int, of: str = "line") -> Column:
    return F.nullif(F.trim(F.regexp_extract(of, pattern, i)), F.lit(""))


_ARTICLE = r"^- \*\*(.*?)\*\*(?: \((.*?)\))?(?: \[[^\]]*\]\(([^)\s]*)\))?(?: · zmíněni: (.*))?$"


def media_items(rows: DataFrame) -> DataFrame:
    """``path, poradi, day, title, medium, url, mentions`` of monthly media lists."""
    line = _lines(_opened(rows, "###")).filter(F.col("line").rlike(_ARTICLE))
    mentions = F.coalesce(F.split(_got(_ARTICLE, 4), r",\s*"), F.array().cast("array<string>"))
    return _numbered(line, "part", "line_no").select("path", "poradi", dates.from_czech_date(F.col("heading")).alias("day"), _got(_ARTICLE, 1).alias("title"), _got(_ARTICLE, 2).alias("medium"), _got(_ARTICLE, 3).alias("url"), mentions.alias("mentions"))


_POST = r"^(\d{4}-\d\d-\d\d \d\d:\d\d) UTC(?: \(([^()]*)\))?"


def social_posts(rows: DataFrame) -> DataFrame:
    """``path, poradi, ts, kind, text, url, likes, reposts, replies`` of monthly posts; a plain post has kind ``post``."""
    parts = _opened(rows, "###").filter(F.col("heading").rlike(_POST))
    link = r"(?m)^Odkaz: <([^>\s]+)>.*$"
    e = T.engagement(F.regexp_extract("text", r"(?m)^(Odkaz: <.*)$", 1))
    return _numbered(parts, "part").select("path", "poradi", F.try_to_timestamp(_got(_POST, 1, "heading"), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), F.coalesce(_got(_POST, 2, "heading"), F.lit("post")).alias("kind"), F.trim(F.regexp_replace("text", link, ""), F.lit(" \n")).alias("text"), _got(link, 1, "text").alias("url"), e["likes"].alias("likes"), e["reposts"].alias("reposts"), e["replies"].alias("replies"))


_VOTE = r"^- č\. (\d+) \((\d{4}-\d\d-\d\d)\): (.*); výsledek ([^;]*)(?:; (.*))?$"


def senate_votes(rows: DataFrame) -> DataFrame:
    """``path, poradi, session, number, day, subject, result, votes`` (a map from person to vote) of monthly overviews."""
    line = _lines(_opened(rows, "##")).filter(F.col("line").rlike(_VOTE))
    pairs = F.filter(F.split(F.coalesce(_got(_VOTE, 5), F.lit("")), r";\s*"), lambda p: p.contains(": "))
    person = lambda p: F.trim(F.substring_index(p, ": ", 1))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, person), person(p)) == i + 1)
    votes = F.map_from_entries(F.transform(first, lambda p: F.struct(person(p), F.trim(F.substring_index(p, ": ", -1)))))
    return _numbered(line, "part", "line_no").select("path", "poradi", F.regexp_extract("heading", r"^(\d+)\. schůze", 1).try_cast("int").alias("session"), _got(_VOTE, 1).try_cast("int").alias("number"), _got(_VOTE, 2).try_cast("date").alias("day"), _got(_VOTE, 3).alias("subject"), T.status(_got(_VOTE, 4)).alias("result"), votes.alias("votes"))


def media_days(items: DataFrame) -> DataFrame:
    """``day, n`` of media items, newest day first."""
    return items.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day"))


#: Types whose documents state how many things they list: (column, what opens them).
COUNTED = {"clanek-media": ("pocet_clanku", media_items), "prispevek-socialni-site": ("pocet_prispevku", social_posts)}


def disagreements(docs: DataFrame, typ: str) -> DataFrame:
    """``path, rule, stated, listed`` of documents whose number is not that of the things they list."""
    column, opens = COUNTED[typ]
    rows = typed_rows(docs, typ)
    n = opens(rows).groupBy("path").agg(F.count("*").cast("int").alias("listed"))
    both = rows.select("path", F.col(column).alias("stated")).join(n, "path", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    return both.filter(~F.coalesce(F.col("stated") == F.col("listed"), F.lit(False))).select("path", F.lit(column).alias("rule"), "stated", "listed")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``title, link, published, description`` of the items of RSS files; a bad date is null."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
    iso = F.when(F.col("pubDate").rlike(r"^\d{4}-"), F.try_to_timestamp("pubDate"))
    mail = F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return rows.select("title", "link", F.coalesce(iso, mail).alias("published"), "description")
