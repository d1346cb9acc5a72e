"""Weekly digests: sections by week, rendered as Markdown and as RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import fold
from .documents import top_per_group, with_evidence


def week_items(items: DataFrame, per_section: int = 20) -> DataFrame:
    """``week, section, rank`` of each week's items: newest first, only those with a source and an authority.

    ``items`` has section, title, zdroj, autorita and ts.
    """
    dated = with_evidence(items).withColumn("week", dates.iso_week(F.to_date("ts")))
    return top_per_group(dated, ["week", "section"], [F.desc("ts"), F.col("zdroj"), F.col("title")], per_section)


def markdown(ranked: DataFrame) -> DataFrame:
    """``week, name, text``: one Markdown document for each week, its sections in order of name."""
    line = F.concat(F.lit("- "), F.date_format("ts", "d. M. yyyy"), F.lit(": ["), F.col("title"), F.lit("]("), F.col("zdroj"), F.lit(") ("), F.col("autorita"), F.lit(")"))
    lines = ranked.withColumn("line", line).groupBy("week", "section").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
    part = F.concat(F.lit("## "), F.col("section"), F.lit(" ("), F.size("l").cast("string"), F.lit(")\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    weeks = lines.withColumn("part", part).groupBy("week").agg(F.sort_array(F.collect_list(F.struct("section", "part"))).alias("p"))
    text = F.concat(F.lit("# "), F.col("week"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n\n"), F.lit("\n"))
    return weeks.select("week", F.concat("week", F.lit(".md")).alias("name"), text.alias("text"))


def week_index(digests: DataFrame) -> DataFrame:
    """Links to the digests, the newest week first."""
    return digests.select("week", F.concat(F.lit("- ["), "week", F.lit("]("), "name", F.lit(")")).alias("line")).orderBy(F.desc("week"))


def _escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def rss_items(ranked: DataFrame) -> DataFrame:
    """``ts, item``: an RSS item for each row."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>"), _escaped(F.col("zdroj")), F.lit("</link><category>"), _escaped(F.col("section")), F.lit("</category><pubDate>"), when, F.lit("</pubDate></item>"))
    return ranked.select("ts", item.alias("item"))


def write_feed(ranked: DataFrame, path: str, title: str, most: int = 100) -> None:
    """The newest ``most`` items (the feed's own limit) as one RSS text under ``path``."""
    newest = rss_items(ranked).orderBy(F.desc("ts"), "item").limit(most)
    body = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("o"), "item"))), lambda x: x["item"]), "").alias("items"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title>'
    body.select(F.concat(F.lit(head), "items", F.lit("</channel></rss>")).alias("value")).write.mode("overwrite").text(path)


#: Fixed values, folded: words of a promise or a plan, and of support alone.
PROMISES = ("slibuj", "planuj", "chceme", "budeme", "prosadime", "navrhneme")
SUPPORT = ("podporili jsme", "podporujeme", "podporil", "vitame")


def result_rule(text: Column, verbs: tuple[str, ...], owner: Column | None = None, parties: tuple[str, ...] = ()) -> Column:
    """Why a text is no result of one's own: ``promise``, ``support`` or ``other party``; null for a result, ``none`` without a verb of success.

    Sentences are judged one by one: a verb of success counts in a sentence without promises.  ``owner`` is whose result
    it is, where that is known, and ``parties`` whose results count.
    """
    any_of = lambda words: r"\b(" + "|".join(words) + ")"
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), fold)
    done = F.exists(sentences, lambda x: x.rlike(any_of(verbs)) & ~x.rlike(any_of(PROMISES)))
    other = F.lit(False) if owner is None else F.coalesce(~owner.isin(*parties), F.lit(False))
    vowed, backed = F.exists(sentences, lambda x: x.rlike(any_of(PROMISES))), F.exists(sentences, lambda x: x.rlike(any_of(SUPPORT)))
    return F.when(done & other, "other party").when(done, None).when(vowed, "promise").when(backed, "support").otherwise("none")


def result_proposals(releases: DataFrame, votes: DataFrame, verbs: tuple[str, ...], parties: tuple[str, ...] = ()) -> DataFrame:
    """Drafts for results: press releases with a verb of success, and adopted votes that the party mostly backed.

    ``releases`` has zdroj, nazev, body and may have ``strana`` (whose result it is; with ``parties``, others' are left
    out); ``votes`` has zdroj, nazev, vysledek, ano, total.  Promises, plans and mere support are no results
    (``result_rule``).  Drafts await a curator.
    """
    owner = F.col("strana") if parties and "strana" in releases.columns else None
    rule = result_rule(F.concat_ws("\n", "nazev", "body"), verbs, owner, parties)
    found = releases.filter(rule.isNull()).select("zdroj", "nazev", F.lit("release").alias("origin"))
    backed = votes.filter((F.lower("vysledek") == "prijato") & (F.col("ano") * 2 > F.col("total"))).select("zdroj", "nazev", F.lit("vote").alias("origin"))
    return found.unionByName(backed).withColumn("stav", F.lit("navrh"))
