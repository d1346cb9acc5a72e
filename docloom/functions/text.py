"""Scalar text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import czech


def _latin_letters() -> dict[str, str]:
    """Lower-case Latin letters with marks, by the letter that their decomposition begins with."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter, parts = chr(code), unicodedata.normalize("NFD", chr(code))
        if letter == letter.lower() and len(parts) > 1 and "a" <= parts[0] <= "z":
            found[letter] = parts[0]
    return found


#: Letters that no decomposition reaches, and what they fold to.
STROKED = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n", "ĸ": "k", "ſ": "s"}
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}

_LETTERS = _latin_letters() | STROKED
#: Letters with marks and the letters they fold to.
MARKED, PLAIN = "".join(_LETTERS), "".join(_LETTERS.values())
#: Marks that stand behind their letter in decomposed texts.
MARKS, _MARKS = "[\u0300-\u036f]", "".join(map(chr, range(0x300, 0x370)))
#: What cuts words: all but letters and digits of any script.
GAP, MARKED_GAP = r"[^\p{L}\p{N}]+", r"[^\p{L}\p{N}\p{M}]+"

#: Endings of Czech nouns and adjectives after folding, longest first.
ENDINGS = ("ovani", "ejsi", "atech", "ovych", "ymi", "emi", "ami", "ech", "ich", "ych", "ove", "ovi", "ova", "eho", "emu", "ymu", "ach", "em", "im", "ym", "um", "am", "ou", "at", "es", "os", "us", "y", "u", "i", "e", "a", "o")
#: A stem keeps at least so many letters.
LEAST_STEM = 3

SENTINELS = ("neuvedeno", "0", "ne")


def fold(x: Column) -> Column:
    """Lower case without diacritics, composed or not; other scripts keep their letters."""
    plain = F.translate(F.lower(x), MARKED + _MARKS, PLAIN)  # what has no counterpart goes
    for letter, two in LIGATURES.items():
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    return plain


def folded(text: str) -> str:
    """``fold`` of a user's own text."""
    plain = "".join(c for c in unicodedata.normalize("NFC", text).lower().translate(str.maketrans(MARKED, PLAIN)) if not 0x300 <= ord(c) <= 0x36F)
    for letter, two in LIGATURES.items():
        plain = plain.replace(letter, two)
    return plain


def tokens(x: Column) -> Column:
    """Folded runs of letters and digits; none for null."""
    return F.filter(F.split(fold(F.coalesce(x, F.lit(""))), GAP), lambda t: t != "")


def words(x: Column) -> Column:
    """Lower-case runs of letters and digits with their marks; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), MARKED_GAP), lambda t: t != "")


def stemmed_tokens(x: Column) -> Column:
    """The Czech stems of a text's words, folded."""
    return F.transform(words(x), lambda w: fold(czech.stem(w)))


def stemmed_token(word: str) -> str:
    """``stemmed_tokens`` of one word of a user's own."""
    return folded(czech.stemmed(unicodedata.normalize("NFC", word).lower()))


def gram_hashes(words: Column, doublings: int = 3) -> Column:
    """64-bit hashes of all runs of ``2 ** doublings`` words, each from two hashes of half the length."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for i in range(doublings):
        hashes = _double(hashes, 2**i)
    return hashes


def _double(hashes: Column, step: int) -> Column:
    def pairs(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    return F.transform(F.array(hashes), pairs)[0]  # the inner array is computed once


def stem(word: Column) -> Column:
    """A folded word without its longest known ending."""
    return F.regexp_replace(word, f"^([a-z0-9]{{{LEAST_STEM},}}?)({'|'.join(ENDINGS)})$", "$1")


def slug(title: Column, most: int | None = 60) -> Column:
    """Folded title with hyphens, cut to ``most`` characters (None: whole) without a hyphen at either end."""
    whole = F.regexp_replace(F.regexp_replace(fold(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most is None:
        return whole
    return F.regexp_replace(F.substring(whole, 1, most), "-+$", "")


def web_slug(segment: Column, most: int = 100) -> Column:
    """A URL's last segment; longer ones keep a prefix and 7 hex digits of their SHA-1, ``most`` characters in all."""
    return F.when(F.length(segment) > most, F.concat(F.substring(segment, 1, most - 8), F.lit("-"), F.substring(F.sha1(segment), 1, 7))).otherwise(segment)


def shorten(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def blank_to_null(x: Column) -> Column:
    """Trimmed, and null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def sentinel_to_null(x: Column) -> Column:
    """Null for texts that say that there is nothing."""
    cleaned = blank_to_null(x)
    return F.when(F.lower(cleaned).isin(*SENTINELS), None).otherwise(cleaned)


def listed(items: Column, empty: str = "neuvedeno") -> Column:
    """Items joined by a comma, or ``empty``."""
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(empty))


def provenance(source: Column, fetched: Column) -> Column:
    """The note under a text that says where it is from and when it was fetched."""
    return F.concat(F.lit("> Zdroj: "), F.coalesce(source, F.lit("neuvedeno")), F.lit(", staženo "), F.coalesce(fetched, F.lit("neuvedeno")), F.lit("."))


def status(x: Column) -> Column:
    """A status in one form: trimmed and in lower case."""
    return F.lower(F.trim(x))


# ---- URLs ------------------------------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_param(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def url_segment(url: Column) -> Column:
    """The last part of the path that is not empty."""
    return F.regexp_extract(url_path(url), r"([^/]+)/*$", 1)


#: Parameters that tell where a reader came from, not what is shown.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|dclid|msclkid|igshid|igsh|si|ref|ref_src|ref_url|sid|hilit|ab_channel|feature|__[^=]*)(=|$)"
#: Sites whose paths name the thing, so that no parameter does.
BY_PATH = ("x.com", "bsky.app", "instagram.com")
#: Parts of paths that are no account.
NO_ACCOUNT = ("i", "home", "hashtag", "search", "intent", "share", "explore", "login", "watch", "groups", "photo", "photo.php", "events", "pages", "sharer")


def _site(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url_host(url), r"^(www|m|mobile)\.", ""), r"^twitter\.com$", "x.com")


def canonical_url(url: Column) -> Column:
    """An address in one form, null where there is none.

    https, a host without www. or m., twitter.com as x.com, no fragment, no slash at the end, and the parameters in
    order; those that only track readers are left out.  All forms of a video's address become its ``watch?v=``.
    """
    u = F.replace(F.trim(url), F.lit("&amp;"), F.lit("&"))
    site, path = _site(u), F.regexp_replace(F.regexp_replace(url_path(u), "/{2,}", "/"), "/+$", "")
    pairs = F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&")
    named = F.array_sort(F.array_distinct(F.filter(pairs, lambda p: (p != "") & ~p.rlike(TRACKING))))
    query = F.when(site.isin(*BY_PATH) | (F.size(named) == 0), F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(named, "&")))
    video = F.when(site == "youtu.be", F.regexp_extract(path, "^/([^/]+)", 1)).when(site == "youtube.com", F.coalesce(F.nullif(F.regexp_extract(path, "^/(?:live|embed|shorts|v)/([^/]+)", 1), F.lit("")), url_param(u, "v")))
    whole = F.concat(F.lit("https://"), site, path, query)
    return F.when(F.coalesce(video, F.lit("")) != "", F.concat(F.lit("https://youtube.com/watch?v="), video)).when(site != "", whole)


def account_handle(url: Column) -> Column:
    """``host/handle`` of a social account's address, in lower case; null without a handle."""
    u = F.trim(url)
    site, parts = _site(u), F.filter(F.split(url_path(u), "/"), lambda p: p != "")
    parts = F.when((F.size(parts) > 1) & F.lower(F.get(parts, F.lit(0))).isin("profile", "c", "user", "channel"), F.slice(parts, 2, 1)).otherwise(parts)
    handle = F.lower(F.regexp_replace(F.get(parts, F.lit(0)), "^@", ""))
    numbered = F.when(url_param(u, "id") != "", F.concat(F.lit("profile.php?id="), url_param(u, "id")))
    handle = F.when(handle == "profile.php", numbered).otherwise(handle)
    return F.when((site != "") & (handle != "") & ~handle.isin(*NO_ACCOUNT), F.concat(site, F.lit("/"), handle))


# ---- things inside texts ---------------------------------------------------------------------------------------


def without_code(x: Column) -> Column:
    """A Markdown text without fenced blocks and code spans."""
    return F.regexp_replace(F.regexp_replace(x, r"(?ms)^(```|~~~).*?^\1[^\n]*$", " "), r"(?s)(?<!`)(`{1,8})(?!`).+?(?<!`)\1(?!`)", " ")


def markdown_links(x: Column) -> Column:
    """Targets of ``[label](target)`` and ``[label](<target> "title")`` that are not empty, outside of code.

    Labels may hold brackets, such as those of an image, and targets may hold one pair of parentheses.
    """
    label, target = r"\[(?:[^\[\]]|\[[^\[\]]*\](?:\([^()]*\))?)*+\]", r"(?:<([^<>\n]*)>|([^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*))"
    found = rf"""{label}\(\s*{target}(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)"""
    plain = without_code(x)
    pairs = F.arrays_zip(F.regexp_extract_all(plain, F.lit(found), F.lit(1)).alias("a"), F.regexp_extract_all(plain, F.lit(found), F.lit(2)).alias("b"))
    return F.filter(F.transform(pairs, lambda p: F.coalesce(F.nullif(p["a"], F.lit("")), p["b"])), lambda t: t != "")


def autolinks(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"<(https?://[^>\s]+)>"), F.lit(1))


def hashtags(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?:^|[^0-9A-Za-z_&/])#([0-9A-Za-z_]+)"), F.lit(1))


def mentions(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?:^|[^0-9A-Za-z_.@])@([A-Za-z0-9_][A-Za-z0-9_.-]*)"), F.lit(1))


def engagement(x: Column) -> Column:
    """Likes, reposts and replies from a line such as ``3 lajků, 2 repostů, 1 odpovědí``; null without one."""
    part = lambda i: F.nullif(F.regexp_extract(x, r"(\d+) lajk\S*, (\d+) repost\S*, (\d+) odpověd", i), F.lit("")).try_cast("long")
    return F.struct(part(1).alias("likes"), part(2).alias("reposts"), part(3).alias("replies"))


#: The totals of a vote: their words in minutes.
TALLY = (("pro", "pro"), ("proti", "proti"), ("zdrzel", "zdrželo se"), ("nehlasoval", "nehlasovalo"), ("pritomno", "přítomno"))


def tally(x: Column) -> Column:
    """Totals of a vote from its sentence; each null if missing."""
    return F.struct(*[F.nullif(F.regexp_extract(x, rf"(?:^|[\s(]){word} (\d+)", 1), F.lit("")).try_cast("long").alias(name) for name, word in TALLY])


def sections(body: Column, mark: str = "##") -> Column:
    """(heading, text) of each part behind a heading line; what stands before the first heading has heading ''."""
    parts = F.split(F.concat(F.lit("\n"), body), rf"\n{mark} ")
    return F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(F.trim(F.substring_index(p, "\n", 1))).alias("heading"),
            F.trim(F.when(i == 0, p).otherwise(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p))), F.lit(" \n")).alias("text"),
        ),
    )


def key_values(body: Column) -> Column:
    """Bullets ``- key: value`` as an array of (key, value)."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^- [^:]+: "))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^- ([^:]+): (.*)$", 1).alias("key"), F.trim(F.regexp_extract(x, r"^- ([^:]+): (.*)$", 2)).alias("value")))


def block_quote(body: Column) -> Column:
    """The text of quote lines, without marks."""
    return F.array_join(F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith(">")), lambda x: F.regexp_replace(x, "^> ?", "")), "\n")


def statutes(x: Column) -> Column:
    """Numbers of laws such as ``111/1994 Sb.``"""
    return F.regexp_extract_all(x, F.lit(r"(\d+/\d{4}) Sb\."), F.lit(1))


#: An article or section with its paragraph and letter: ``čl. 9 odst. 5 písm. b)``, ``§ 12a odst. 1``.
_PROVISION = r"(čl\.|§)\s*(\d+[a-z]?)(?:\s+odst\.\s*(\d+))?(?:\s+písm\.\s*([a-zž])\))?"


def provisions(x: Column) -> Column:
    """Articles and sections that a text names, as (kind, number, paragraph, letter); parts that are not named are null."""
    part = lambda i: F.regexp_extract_all(x, F.lit(_PROVISION), F.lit(i)).alias(str(i))
    empty = lambda c: F.nullif(c, F.lit(""))
    rows = F.arrays_zip(part(1), part(2), part(3), part(4))
    return F.transform(rows, lambda r: F.struct(F.when(r["1"] == "§", "section").otherwise("article").alias("kind"), r["2"].alias("number"), empty(r["3"]).try_cast("int").alias("paragraph"), empty(r["4"]).alias("letter")))


def money(x: Column) -> Column:
    """A decimal from ``1 234,50 Kč``; null if it is none, or has more than 36 digits before the point."""
    plain = F.regexp_replace(F.regexp_replace(x, "[\\s\\u00a0]|Kč|,-|CZK|EUR|€", ""), ",", ".")
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain).try_cast("decimal(38,2)")


VOTE_CODES = {"A": "ano", "B": "ne", "N": "ne", "C": "zdrzel", "K": "zdrzel", "F": "nehlasoval", "@": "nepritomen", "M": "omluven", "W": "pred-slibem"}


def vote_value(code: Column) -> Column:
    """The value of a one-letter vote code; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in VOTE_CODES.items() for x in pair]), code)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def table_rows(body: Column) -> Column:
    """Cells of a Markdown table's rows below its heading and rule."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)))
    return F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0)))


def table_maps(body: Column) -> Column:
    """A Markdown table's rows as maps from heading to cell; short rows are filled with nulls.

    A heading that stands there again gets its column's number: ``H``, ``H (2)``.
    """
    first = F.split(F.regexp_replace(F.get(F.filter(F.split(body, "\n"), lambda x: x.startswith("|")), 0), r"^\||\|\s*$", ""), r"\|")
    trimmed = F.transform(first, lambda h: F.trim(h))
    again = lambda h, i: F.array_position(trimmed, h) <= i
    heading = F.transform(trimmed, lambda h, i: F.when(again(h, i), F.concat(h, F.lit(" ("), (i + 1).cast("string"), F.lit(")"))).otherwise(h))
    pairs = lambda r: F.transform(heading, lambda h, i: F.struct(h.alias("key"), F.get(r, i).alias("value")))
    once = lambda r: F.filter(pairs(r), lambda p, i: F.array_position(heading, p["key"]) == i + 1)
    return F.transform(table_rows(body), lambda r: F.map_from_entries(once(r)))


#: A tag with its quoted attributes, in which a > is none; a quote that is not closed ends with the tag.  The bound keeps
#: the expression's own stack small.
TAG = r"""<[A-Za-z/!?](?:[^"'>]++|"[^"]*+"|'[^']*+'){0,400}+>|<[A-Za-z/!?][^>]*+>"""
#: Elements without visible text, and comments.
UNSEEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"


def _entity(name: Column) -> Column:
    """The character of ``amp``, ``#39`` or ``#x27``; null for what is none."""
    named = F.create_map(*[F.lit(x) for k, v in sorted(name2codepoint.items()) for x in (k, chr(v))], F.lit("apos"), F.lit("'"))
    code = F.when(name.startswith("#x") | name.startswith("#X"), F.conv(F.substring(name, F.lit(3), F.lit(8)), 16, 10)).when(name.startswith("#"), F.substring(name, F.lit(2), F.lit(10))).try_cast("long")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(valid, char).when(code.isNotNull(), F.lit("\ufffd")).otherwise(F.try_element_at(named, name))


def decode_entities(x: Column) -> Column:
    """Named and numbered character references as characters, in one pass; what is none stays."""

    def part(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,10}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(_entity(name), F.substring(p, F.length(name) + 2, F.length(p))), F.concat(F.lit("&"), p)))

    return F.array_join(F.transform(F.split(x, "&"), part), "")


def clean_html(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags, entities decoded, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), TAG, " ")
    return F.trim(F.regexp_replace(F.replace(decode_entities(text), F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\n]+", " "))


def language_ratio(x: Column, words: tuple[str, ...]) -> Column:
    """The share of tokens that are among ``words``; null without tokens."""
    t = tokens(x)
    return F.try_divide(F.size(F.filter(t, lambda w: w.isin(*words))), F.size(t))
