"""Queries on texts, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import czech
from ..functions import text as T
from ..operators import documents as D
from ..operators import index, language, mentions, month_pages, search
from ..store import fresh_path
from ._base import Registry, fold_sql, stem_sql, table, tokens_sql

q = Registry()

def bm25_sql(terms: str, k: int, where: str = "", having: str = "") -> str:
    return f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
l AS (SELECT doc_id, len(w) AS length FROM t),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
s AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
r AS (SELECT f.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score
      FROM f JOIN df USING (term) JOIN l USING (doc_id), s {where} GROUP BY f.doc_id {having})
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, doc_id LIMIT {k}
"""


def _ranked(docs, query, k, **more):
    return search.search(docs, query, k, **more).select("doc_id", F.round("score", 6).alias("score"))


@q(bm25_sql("'that', 'blereat', 'elle'", 10))
def search_bm25_topk(spark, d):
    return _ranked(table(spark, d, "documents"), "That blereat ÉLLE", 10)


@q(bm25_sql("'that', 'blereat', 'elle'", 10))
def search_written_index(spark, d):
    path = fresh_path(spark, "index")
    index.write_index(table(spark, d, "documents"), path, stemmed=False)
    return index.search_index(spark, path, "That blereat ÉLLE", 10).select("doc_id", F.round("score", 6).alias("score"))


@q(bm25_sql("'that', 'blereat', 'elle'", 10))
def search_grown_index(spark, d):
    """The same from an index that was written in three parts, some documents twice."""
    path, docs = fresh_path(spark, "index"), table(spark, d, "documents")
    third = F.pmod("doc_id", F.lit(3))
    index.write_index(docs.filter(third == 0), path, stemmed=False)
    index.append_index(docs.filter(third == 1), path)
    index.append_index(docs.filter(third > 0), path)
    return index.search_index(spark, path, "That blereat ÉLLE", 10).select("doc_id", F.round("score", 6).alias("score"))


_UNITS = f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
u AS (SELECT doc_id, len(w) AS length, {{tf}} AS tf FROM t),
f AS (SELECT *, count(*) OVER () AS df FROM u WHERE tf > 0)
SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)), 6) AS score FROM f, s ORDER BY score DESC, doc_id LIMIT 20"""


@q(_UNITS.replace("{tf}", "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"))
def search_index_phrase(spark, d):
    path = fresh_path(spark, "index")
    index.write_index(table(spark, d, "documents"), path, stemmed=False)
    return index.search_index(spark, path, '"Of THE"', 20).select("doc_id", F.round("score", 6).alias("score"))


@q(_UNITS.replace("{tf}", "len(list_filter(w, lambda x: x[1:4] = 'schu'))"))
def search_index_prefix(spark, d):
    path = fresh_path(spark, "index")
    index.write_index(table(spark, d, "documents"), path, stemmed=False)
    return index.search_index(spark, path, "Schu*", 20).select("doc_id", F.round("score", 6).alias("score"))


@q(bm25_sql("'the', 'that', 'with'", 20, having="HAVING count(*) = 3"))
def search_boolean_and(spark, d):
    return _ranked(table(spark, d, "documents"), "the that with", 20, match_all=True)


@q(bm25_sql("'schung', 'keit'", 15, where="JOIN documents o ON o.doc_id = f.doc_id AND o.lang = 'de'"))
def search_filtered(spark, d):
    return _ranked(table(spark, d, "documents"), "schung keit", 15, where=F.col("lang") == "de")


@q(
    f"""
WITH t AS (SELECT doc_id, concat(' ', array_to_string({tokens_sql('text')}, '  '), ' ') AS line FROM documents)
SELECT doc_id, CAST((length(line) - length(replace(line, ' of  the ', ''))) // 9 AS BIGINT) AS n FROM t WHERE contains(line, ' of  the ')"""
)
def search_phrase(spark, d):
    return search.phrase(table(spark, d, "documents"), "of the")


@q(
    f"""
SELECT term, CAST(count(*) AS BIGINT) AS cf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df
FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term"""
)
def term_frequencies(spark, d):
    return search.term_counts(table(spark, d, "documents"))


@q(
    f"""
SELECT stem, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS forms FROM (
  SELECT term, {stem_sql('term')} AS stem, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term) GROUP BY stem"""
)
def stem_tokens(spark, d):
    words = search.term_counts(table(spark, d, "documents"))
    return words.withColumn("stem", T.stem(F.col("term"))).groupBy("stem").agg(F.sum("cf").cast("long").alias("n"), F.count("*").alias("forms"))


@q(
    rf"""
SELECT stem, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS forms FROM (SELECT word, {czech.stem_sql('word')} AS stem, n FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '{T.MARKED_GAP}')) AS word FROM documents) WHERE word <> '' GROUP BY 1)) GROUP BY 1"""
)
def czech_stems(spark, d):
    """Each word once, however often it stands in the texts."""
    words = table(spark, d, "documents").select(F.inline(search.counted(T.words(F.col("text"))))).groupBy("term").agg(F.sum("tf").alias("n"))
    return words.withColumn("stem", czech.stem(F.col("term"))).groupBy("stem").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("forms"))


@q(f"SELECT {fold_sql('c_name')} AS name, {fold_sql('n_name')} AS land, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def fold_group_names(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return people.groupBy(T.fold(F.col("c_name")).alias("name"), T.fold(F.col("n_name")).alias("land")).agg(F.count("*").alias("n"))


@q(f"SELECT doc_id, md5({fold_sql('text')}) AS folded FROM documents")
def fold_equals(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@q("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON lower(replace(c.c_name, 'Customer', 'Zákazník')) = lower(replace(s.s_name, 'Supplier', 'ZÁKAZNÍK'))")
def author_participant(spark, d):
    author = T.fold(F.replace("c_name", F.lit("Customer"), F.lit("Zákazník"))).alias("folded")
    other = T.fold(F.replace("s_name", F.lit("Supplier"), F.lit("ZAKAZNIK"))).alias("folded")
    return table(spark, d, "customer").select("c_custkey", author).join(table(spark, d, "supplier").select("s_suppkey", other), "folded").select("c_custkey", "s_suppkey")


def _slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({fold_sql(x)}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@q(f"SELECT doc_id, regexp_replace(substr({_slug_sql('text')}, 1, 60), '-+$', '') AS slug FROM documents")
def slug_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@q(
    f"""
SELECT doc_id, CASE WHEN length(s) > 100 THEN concat(substr(s, 1, 92), '-', substr(sha1(s), 1, 7)) ELSE s END AS slug
FROM (SELECT doc_id, {_slug_sql('text')} AS s FROM documents)"""
)
def slug_web_segments(spark, d):
    return table(spark, d, "documents").select("doc_id", T.web_slug(T.slug(F.col("text"), None)).alias("slug"))


@q(
    r"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page,
       regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS segment FROM pages"""
)
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.url_host(u).alias("host"), T.url_path(u).alias("path"), T.url_param(u, "page").alias("page"), T.url_segment(u).alias("segment"))


def canonical_sql(url: str) -> str:
    site = rf"regexp_replace(regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^(www|m|mobile)\.', ''), '^twitter\.com$', 'x.com')"
    path = rf"regexp_replace(regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/+$', '')"
    named = rf"list_sort(list_distinct(list_filter(string_split(regexp_extract({url}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{T.TRACKING}'))))"
    return f"CASE WHEN {site} <> '' THEN concat('https://', {site}, {path}, CASE WHEN len({named}) > 0 THEN '?' ELSE '' END, array_to_string({named}, '&')) END"


_CANONICAL = canonical_sql("url")


@q(f"SELECT {_CANONICAL} AS canonical, CAST(count(*) AS BIGINT) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_canonical(spark, d):
    return table(spark, d, "pages").groupBy(T.canonical_url(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@q(r"""SELECT page_id, link, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def html_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@q(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS size FROM pages")
def html_title(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.length(title).cast("long").alias("size"))


def _text_sql(html: str) -> str:
    """``clean_html`` for DuckDB; quotes are doubled for SQL."""
    tag = T.TAG.replace("++", "+").replace("*+", "*").replace("{0,400}+", "*").replace("'", "''")
    unseen = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->"
    names = ", ".join(f"'{k}': chr({v})" for k, v in sorted(T.name2codepoint.items())) + ", 'apos': chr(39)"
    part = "regexp_extract(p, '^(#[0-9]{1,10}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});', 1)"
    number = f"CASE WHEN starts_with({part}, '#x') THEN CAST(concat('0x', substr({part}, 3)) AS INTEGER) WHEN starts_with({part}, '#') THEN CAST(substr({part}, 2) AS INTEGER) END"
    char = f"CASE WHEN starts_with({part}, '#') THEN chr({number}) ELSE m[{part}] END"
    decoded = f"array_to_string(list_transform(string_split(t, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE coalesce({char} || substr(p, length({part}) + 2), '&' || p) END), '')"
    return rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace({html}, '{unseen}', ' ', 'g'), '{tag}', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, t, MAP {{{names}}} AS m FROM a)
SELECT page_id, trim(regexp_replace(replace({decoded}, chr(160), ' '), '[ \t\r\n]+', ' ', 'g')) AS text FROM b"""


@q(_text_sql("html"))
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


@q(
    r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_&/])#([0-9A-Za-z_]+)', 1)) AS BIGINT) AS n_tags,
       CAST(len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_.@])@([A-Za-z0-9_][A-Za-z0-9_.-]*)', 1)) AS BIGINT) AS n_mentions,
       CAST(len(regexp_extract_all(text, '<(https?://[^>\s]+)>', 1)) AS BIGINT) AS n_links FROM documents"""
)
def hashtags_mentions(spark, d):
    t = F.col("text")
    n = lambda x, name: F.size(x).cast("long").alias(name)
    return table(spark, d, "documents").select("doc_id", n(T.hashtags(t), "n_tags"), n(T.mentions(t), "n_mentions"), n(T.autolinks(t), "n_links"))


_LINE = "concat(CAST(o_orderkey AS VARCHAR), ' lajků, ', CAST(o_custkey AS VARCHAR), ' repostů, ', CAST(o_orderkey % 7 AS VARCHAR), ' odpovědí')"


@q(
    f"""
SELECT o_orderkey, CAST(regexp_extract(x, '(\\d+) lajk\\S*, (\\d+) repost\\S*, (\\d+) odpověd', 1) AS BIGINT) AS likes,
       CAST(regexp_extract(x, '(\\d+) lajk\\S*, (\\d+) repost\\S*, (\\d+) odpověd', 2) AS BIGINT) AS reposts,
       CAST(regexp_extract(x, '(\\d+) lajk\\S*, (\\d+) repost\\S*, (\\d+) odpověd', 3) AS BIGINT) AS replies FROM (SELECT o_orderkey, {_LINE} AS x FROM orders)"""
)
def engagement_metrics(spark, d):
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(" lajků, "), F.col("o_custkey").cast("string"), F.lit(" repostů, "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" odpovědí"))
    return table(spark, d, "orders").select("o_orderkey", T.engagement(line).alias("e")).select("o_orderkey", "e.*")


@q(
    r"""
WITH x AS (SELECT o_orderkey, concat('(pro ', CAST(o_orderkey % 60 AS VARCHAR), ', proti ', CAST(o_custkey % 9 AS VARCHAR), ', zdrželo se ', CAST(o_orderkey % 5 AS VARCHAR), ', nehlasovalo 2, přítomno 65)') AS s FROM orders)
SELECT o_orderkey, CAST(regexp_extract(s, '(?:^|[\s(])pro (\d+)', 1) AS BIGINT) AS pro, CAST(regexp_extract(s, '(?:^|[\s(])proti (\d+)', 1) AS BIGINT) AS proti,
       CAST(regexp_extract(s, '(?:^|[\s(])zdrželo se (\d+)', 1) AS BIGINT) AS zdrzel, CAST(regexp_extract(s, '(?:^|[\s(])nehlasovalo (\d+)', 1) AS BIGINT) AS nehlasoval,
       CAST(regexp_extract(s, '(?:^|[\s(])přítomno (\d+)', 1) AS BIGINT) AS pritomno FROM x"""
)
def tally_sentences(spark, d):
    part = lambda x: x.cast("string")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.concat(F.lit("(pro "), part(k % 60), F.lit(", proti "), part(c % 9), F.lit(", zdrželo se "), part(k % 5), F.lit(", nehlasovalo 2, přítomno 65)"))
    return table(spark, d, "orders").select("o_orderkey", T.tally(s).alias("t")).select("o_orderkey", "t.*")


@q(
    r"""
WITH b AS (SELECT doc_id, replace(text, chr(10), concat(chr(10), '## ')) AS body FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, string_split(concat(chr(10), body), concat(chr(10), '## ')) AS parts FROM b),
e AS (SELECT doc_id, unnest(parts) AS part, unnest(generate_series(0, len(parts) - 1)) AS i FROM p)
SELECT doc_id, CAST(i AS BIGINT) AS section, CASE WHEN i = 0 THEN '' ELSE trim(string_split(part, chr(10))[1]) END AS heading,
       trim(CASE WHEN i = 0 THEN part ELSE substr(part, length(string_split(part, chr(10))[1]) + 1) END, concat(' ', chr(10))) AS text FROM e"""
)
def section_split(spark, d):
    body = F.replace("text", F.lit("\n"), F.lit("\n## "))  # every line but the first is a heading
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sections(body)).alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "s.heading", "s.text")


@q("SELECT conv_id, turn, 'Role' AS key, role AS value FROM conversations UNION ALL SELECT conv_id, turn, 'Size', CAST(length(text) AS VARCHAR) FROM conversations")
def kv_parse(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat(F.lit("- Role: "), F.col("role"), F.lit("\n- Size: "), F.length("text").cast("string"), F.lit("\nno pair"))
    return c.select("conv_id", "turn", F.explode(T.key_values(body)).alias("p")).select("conv_id", "turn", "p.key", "p.value")


@q("SELECT conv_id, turn, text AS quote FROM conversations")
def block_quotes(spark, d):
    c = table(spark, d, "conversations")
    body = F.concat(F.lit("Said:\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\nend"))
    return c.select("conv_id", "turn", T.block_quote(body).alias("quote"))


@q(
    r"""
SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS DOUBLE) AS price, concat(CAST(o_orderkey AS VARCHAR), '/', CAST(year(o_orderdate) AS VARCHAR)) AS law FROM orders"""
)
def money_and_statutes(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    written = F.concat(F.regexp_replace((cents / 100).cast("long").cast("string"), r"(\d)(?=(\d{3})+$)", "$1 "), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" Kč"))
    law = F.concat(F.lit("podle zákona č. "), F.col("o_orderkey").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(" Sb., o věci"))
    return table(spark, d, "orders").select("o_orderkey", T.money(written).cast("double").alias("price"), F.get(T.statutes(law), F.lit(0)).alias("law"))


@q(
    """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'ano' WHEN 'N' THEN 'ne' ELSE NULL END AS value,
       CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS status FROM lineitem"""
)
def vote_codes_and_sentinels(spark, d):
    status = T.sentinel_to_null(F.when(F.col("l_linestatus") == "F", F.lit(" neuvedeno ")).otherwise(F.col("l_linestatus")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.vote_value(F.col("l_returnflag")).alias("value"), status.alias("status"))


@q(
    """
SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '…') ELSE text END AS short,
       CASE WHEN n_chars > 1000 THEN concat(lang, ', ', source) ELSE 'neuvedeno' END AS labels FROM documents"""
)
def shortened_and_listed(spark, d):
    items = F.when(F.col("n_chars") > 1000, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 40).alias("short"), T.listed(items).alias("labels"))


@q(
    f"""
WITH t AS (SELECT doc_id, lang, {tokens_sql('text')} AS w FROM documents),
r AS (SELECT doc_id, lang, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'that'))) / len(w) END AS en,
             CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'das', 'mit', 'den'))) / len(w) END AS de FROM t)
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE en > de) AS BIGINT) AS looks_english, round(avg(en), 6) AS share FROM r GROUP BY lang"""
)
def language_flags(spark, d):
    docs = table(spark, d, "documents")
    en = T.language_ratio(F.col("text"), ("the", "of", "and", "to", "in", "that"))
    de = T.language_ratio(F.col("text"), ("der", "die", "und", "das", "mit", "den"))
    return docs.select("lang", en.alias("en"), de.alias("de")).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("en") > F.col("de")).alias("looks_english"), F.round(F.avg("en"), 6).alias("share"))


_GRAMS = r"""
WITH w AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2, 3),
g AS (SELECT doc_id, lang, n, substr(concat(' ', word, ' '), i, size) AS gram FROM (SELECT *, unnest(range(1, length(word) + 4 - size)) AS i FROM w, (VALUES (1), (2), (3)) t(size)) WHERE substr(concat(' ', word, ' '), i, size) <> ' '),
p AS (SELECT lang, gram, rank FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank FROM g WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE rank < 300),
o AS (SELECT doc_id, gram, rank FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, gram) - 1 AS rank FROM g GROUP BY 1, 2) WHERE rank < 300),
d AS (SELECT o.doc_id, l.lang, sum(coalesce(abs(o.rank - p.rank), 300)) AS far FROM o, (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = o.gram GROUP BY 1, 2),
b AS (SELECT doc_id, arg_min(lang, struct_pack(far := far, lang := lang)) AS language, min(far) AS far FROM d GROUP BY 1)
"""


@q(_GRAMS + "SELECT c.doc_id, b.language, CAST(b.far AS BIGINT) AS distance FROM documents c LEFT JOIN b USING (doc_id)")
def text_languages(spark, d):
    docs = table(spark, d, "documents")
    return language.languages(docs, language.profiles(docs)).select("doc_id", "language", "distance")


@q(_GRAMS + "SELECT c.lang, b.language, CAST(count(*) AS BIGINT) AS n FROM documents c LEFT JOIN b USING (doc_id) GROUP BY 1, 2")
def language_agreement(spark, d):
    docs = table(spark, d, "documents")
    found = language.languages(docs, language.profiles(docs), keep=["lang"])
    return found.groupBy("lang", "language").agg(F.count("*").alias("n"))


@q(
    """
WITH h AS (SELECT sha256(text) AS hash, doc_id FROM documents WHERE text IS NOT NULL)
SELECT hash, min(doc_id) AS doc_id, CAST(count(*) - 1 AS BIGINT) AS n_others, CAST(sum(doc_id) - min(doc_id) AS BIGINT) AS others FROM h GROUP BY hash HAVING count(*) > 1"""
)
def dedup_by_hash(spark, d):
    one = D.one_per_content(table(spark, d, "documents"), F.col("text"), "doc_id", total=True).filter("n > 1")
    return one.select("hash", "doc_id", (F.col("n") - 1).alias("n_others"), (F.col("total") - F.col("doc_id")).cast("long").alias("others"))


@q(
    f"""
WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents) WHERE len(w) >= 8),
b AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark) WHERE len(w) >= 8)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n FROM g JOIN b USING (g) GROUP BY ALL"""
)
def benchmark_overlap(spark, d):
    def grams(df, *keys):
        return df.select(*keys, F.array_distinct(T.gram_hashes(T.tokens(F.col("text")))).alias("gs"))

    items = grams(table(spark, d, "benchmark"), "item_id").select("item_id", F.explode("gs").alias("g"))
    return search.rows_with(grams(table(spark, d, "documents"), "doc_id"), "gs", "g", items).groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


_MENTIONS = f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
b AS (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark),
n AS (SELECT n_name AS entity, {tokens_sql('n_name')} AS w FROM nation UNION ALL SELECT 'article', ['the'] UNION ALL SELECT 'Elle', ['elle']
  UNION ALL SELECT concat('item ', CAST(item_id AS VARCHAR)), w[1:2 + item_id % 11] FROM b WHERE len(w) >= 2 + item_id % 11),
d AS (SELECT DISTINCT entity, len(w) AS size, w[1] AS word, array_to_string(w, ' ') AS gram FROM n WHERE len(w) > 0),
p AS (SELECT doc_id, i, entity, size, gram FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) JOIN d USING (word)),
m AS (SELECT doc_id, entity, count(*) AS n, min(i) AS first FROM p JOIN t USING (doc_id) WHERE array_to_string(w[i:i + size - 1], ' ') = gram GROUP BY ALL)"""


def _names(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.col("n_name").alias("name"))
    more = spark.range(1).select(F.inline(F.array(F.struct(F.lit("article").alias("entity"), F.lit("THE").alias("name")), F.struct(F.lit("Elle").alias("entity"), F.lit("Élle").alias("name")))))
    # Names of 2 to 12 words: how each benchmark item begins.
    size, words = (2 + F.col("item_id") % 11).cast("int"), T.tokens(F.col("text"))
    items = table(spark, d, "benchmark").filter(F.size(words) >= size).select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("entity"), F.array_join(F.slice(words, F.lit(1), size), " ").alias("name"))
    return names.unionByName(more).unionByName(items)


@q(f"{_MENTIONS} SELECT doc_id, entity, CAST(n AS BIGINT) AS n FROM m")
def mention_join(spark, d):
    return mentions.mention_join(table(spark, d, "documents"), _names(spark, d))


_PEOPLE = f"{_MENTIONS}, l AS (SELECT doc_id, list(entity ORDER BY first, entity) AS people FROM m GROUP BY 1)"


def _people(spark, d):
    return mentions.in_order(mentions.mention_join(table(spark, d, "documents"), _names(spark, d), places=True))


@q(f"{_PEOPLE} SELECT doc_id, array_to_string(people, ', ') AS people, CAST(len(people) AS BIGINT) AS n FROM l")
def people_in_order(spark, d):
    return _people(spark, d).select("doc_id", F.array_join("people", ", ").alias("people"), F.size("people").cast("long").alias("n"))


def _media_items(spark, d):
    """An event is an article on the document of its number, or on no known one; its kind says whose words they are."""
    whose = F.when(F.col("event_type") == "view", "vyjadreni-politika").when(F.col("event_type") == "click", "web").otherwise("externi-media")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("medium"), F.concat(F.lit("https://media.example/"), F.col("event_id").cast("string")).alias("url"), whose.alias("authority"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"))
    return e.join(docs, "id", "left").join(_people(spark, d).withColumnRenamed("doc_id", "id"), "id", "left")


_ITEMS = f"""{_PEOPLE},
i AS (SELECT e.event_id AS id, e.ts, date_trunc('month', e.ts)::DATE AS month, e.ts::DATE AS day, CASE event_type WHEN 'view' THEN 'vyjadreni-politika' WHEN 'click' THEN 'web' ELSE 'externi-media' END AS authority,
  '- **' || coalesce(string_split(d.text, chr(10))[1], '') || '** (' || event_type || ') [odkaz](https://media.example/' || event_id || ')' || coalesce(' · zmíněni: ' || array_to_string(l.people, ', '), '') AS text
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id LEFT JOIN l ON l.doc_id = e.event_id)"""


@q(
    f"""{_ITEMS},
r AS (SELECT month, authority, day, ts, id, text FROM i UNION ALL SELECT DISTINCT month, authority, day, NULL, NULL, '### ' || day(day) || '. ' || month(day) || '. ' || year(day) FROM i)
SELECT month, authority, row_number() OVER (PARTITION BY month, authority ORDER BY day DESC, ts NULLS FIRST, id) AS line, text FROM r"""
)
def month_page_lines(spark, d):
    return month_pages.lines(_media_items(spark, d))


@q(
    f"""{_ITEMS} SELECT month, authority, count(*) AS n, max(day) AS latest, count(DISTINCT day) AS days,
CASE authority WHEN 'externi-media' THEN '{month_pages.NOTES["externi-media"]}' WHEN 'vyjadreni-politika' THEN '{month_pages.NOTES["vyjadreni-politika"]}' END AS note FROM i GROUP BY 1, 2"""
)
def month_page_heads(spark, d):
    return month_pages.heads(_media_items(spark, d))


@q("SELECT lang, 'vysledek:' || lang AS tag, CAST(count(*) AS BIGINT) AS n FROM documents WHERE n_chars > 500 AND doc_id % 2 = 0 GROUP BY lang")
def tag_membership(spark, d):
    # A document's results are its language, or its source if its id is odd; its tags name its language and source.
    results = F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array("source"))
    tags = F.array(F.concat(F.lit("vysledek:"), F.col("lang")), F.concat(F.lit("tema:"), F.col("source")))
    docs = table(spark, d, "documents").filter("n_chars > 500").withColumn("results", results).withColumn("tags", tags)
    tagged = docs.select("lang", F.explode(F.filter("tags", lambda t: t.startswith("vysledek:"))).alias("tag"), "results")
    return tagged.filter(F.expr("array_contains(results, substring(tag, 10))")).groupBy("lang", "tag").agg(F.count("*").alias("n"))


@q(
    """
SELECT d.doc_id, d.lang, CASE WHEN l.quality = 1 THEN 'usneseni' ELSE 'web' END AS autorita FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE coalesce(l.toxic, 0) = 0"""
)
def visibility_policy(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    seen = F.when(F.coalesce("toxic", F.lit(0)) == 0, "verejne").otherwise("clenske")
    labelled = docs.withColumn("viditelnost", seen).withColumn("autorita", F.when(F.col("quality") == 1, "usneseni").otherwise("web"))
    return D.public_only(labelled).select("doc_id", "lang", "autorita")


@q("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_gap(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@q("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source")
def semi_scope(spark, d):
    good = table(spark, d, "labels").filter("quality = 1")
    return table(spark, d, "documents").join(good, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@q("SELECT page_id, url, length(html) AS size, concat('larger than ', 1500) AS reason FROM pages WHERE length(html) > 1500")
def size_rejects(spark, d):
    _, rejected = D.split_by_size(table(spark, d, "pages").withColumn("size", F.length("html").cast("long")), "size", 1500)
    return rejected.select("page_id", "url", "size", "reason")


@q(
    """
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(lang) AS BIGINT) AS with_lang FROM (
  SELECT 'doc' AS kind, lang FROM documents UNION ALL SELECT 'page', NULL FROM pages UNION ALL SELECT 'benchmark', NULL FROM benchmark) GROUP BY kind"""
)
def union_all_sources(spark, d):
    kind = lambda t, k, *c: table(spark, d, t).select(F.lit(k).alias("kind"), *c)
    every = D.unite(kind("documents", "doc", "lang"), kind("pages", "page"), kind("benchmark", "benchmark"))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@q("SELECT * FROM (SELECT doc_id, 'typ' AS rule FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'tema' FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'datum' FROM documents WHERE lang = 'es')")
def schema_violations(spark, d):
    has = lambda k, v: (F.lit(k), F.lit(v))
    core = [*has("zdroj", "u"), *has("nazev", "n"), *has("viditelnost", "verejne"), *has("stazeno", "2026-01-01")]
    typ = F.when(F.col("lang") == "de", None).when(F.col("lang") == "es", "stanovisko").otherwise("material")
    docs = table(spark, d, "documents").select("doc_id", F.create_map(*core, F.lit("typ"), typ, F.lit("autorita"), F.lit("web")).alias("attrs"))
    return D.violations(docs, key="doc_id")


QUERIES, SQL = q.queries, q.sql
