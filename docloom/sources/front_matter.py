"""Documents with YAML front matter: ``---``, keys, ``---``, a heading and a body.

A file is read whole and becomes one row.  The keys are parsed in Arrow batches by a small reader of the YAML subset
that front matter uses: scalars, quoted strings, lists (block and inline) and lists of mappings.  Scalars keep their
text, so ids such as ``'1001'`` or ``10/1`` never turn into numbers; typed columns are cut from them explicitly.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = re.compile(r"^([^\s:#-][^:]*):(?:\s+(.*))?$")
_SPLIT = re.compile(r"^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$", re.S)


def scalar(text: str) -> str | list | None:
    """A plain, quoted or inline-list value; null and ~ are None."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) >= 2 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in re.findall(r"\s*('(?:[^']|'')*'|\"(?:[^\"\\]|\\.)*\"|[^,]+)", text[1:-1]) if x.strip()]
    text = re.sub(r"\s+#.*$", "", text)
    return None if text in ("", "null", "~") else text


def parse_yaml(source: str) -> dict:
    """Keys to scalars (text or None), lists of scalars, or lists or dicts of scalars."""
    out: dict = {}
    key, items = None, None
    for line in source.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        bare = line.strip()
        if not line[0].isspace() and not bare.startswith("- ") and bare != "-":
            found = _KEY.match(bare)
            if not found:
                continue  # a line that is no YAML is passed over
            key, items = found[1].strip(), None
            out[key] = scalar(found[2]) if found[2] is not None else None
            continue
        if key is None:
            continue
        if bare.startswith("- ") or bare == "-":
            items = out[key] = out[key] if isinstance(out[key], list) else []
            inner = bare[2:].strip()
            pair = None if inner[:1] in ("'", '"', "[") else _KEY.match(inner)
            items.append({pair[1].strip(): scalar(pair[2] or "")} if pair else scalar(inner))
        elif (pair := _KEY.match(bare)) and items and isinstance(items[-1], dict):
            items[-1][pair[1].strip()] = scalar(pair[2] or "")
        elif pair and (out[key] is None or isinstance(out[key], dict)):
            out[key] = {**(out[key] or {}), pair[1].strip(): scalar(pair[2] or "")}
        elif isinstance(out[key], str):
            out[key] += " " + bare  # a folded scalar
    return out


def split_document(text: str) -> tuple[dict, str, str, str | None]:
    """(keys, title, body, error) of a document's text."""
    found = _SPLIT.match(text)
    if not found:
        return {}, "", text, "no front matter"
    body = (found[2] or "").strip("\n")
    title = ""
    if body.startswith("# "):
        head, _, body = body.partition("\n")
        title, body = head[2:].strip(), body.strip("\n")
    return parse_yaml(found[1]), title, body, None


_SCHEMA = "path string, title string, attrs map<string,string>, lists map<string,array<string>>, records map<string,string>, body string, error string"


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
            try:
                keys, title, body, error = split_document((raw or b"").decode())
            except UnicodeDecodeError as e:
                keys, title, body, error = {}, "", None, f"UnicodeDecodeError: {e}"
            flat = {k: v for k, v in keys.items() if v is None or isinstance(v, str)}
            lists = {k: [x for x in v if x is None or isinstance(x, str)] for k, v in keys.items() if isinstance(v, list) and not any(isinstance(x, dict) for x in v)}
            records = {k: json.dumps(v, ensure_ascii=False) for k, v in keys.items() if isinstance(v, dict) or (isinstance(v, list) and any(isinstance(x, dict) for x in v))}
            rows.append((path, title, list(flat.items()), list(lists.items()), list(records.items()), body, error))
        text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
        types = (text, text, pairs, pa.map_(pa.string(), pa.list_(pa.string())), pairs, text, text)
        names = ["path", "title", "attrs", "lists", "records", "body", "error"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def parse_documents(texts: DataFrame) -> DataFrame:
    """Rows of ``path, value`` as documents; those without front matter have ``error`` set and keep their text.

    So do those that are no UTF-8, without a text.
    """
    return texts.select("path", "value").mapInArrow(_parse, _SCHEMA)


def read_documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Every matching file below ``root``; source, kind and year come from the path."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    docs = parse_documents(texts.select(F.col("_metadata.file_path").alias("path"), "value"))
    inner = F.split(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    return docs.withColumns({"source": F.get(inner, F.lit(0)), "kind": F.get(inner, F.lit(1)), "year": F.regexp_extract("path", r"/((?:19|20)\d\d)/", 1).try_cast("int")})


def attribute(name: str) -> Column:
    return F.element_at("attrs", F.lit(name))


def typed(docs: DataFrame) -> DataFrame:
    """The core columns with their types: ``datum`` is a date, an instant goes to ``ts``; a missing date stays null."""
    raw = attribute("datum")
    return docs.select(
        "path",
        *[F.trim(attribute(k)).alias(k) for k in ("zdroj", "nazev", "typ", "viditelnost", "autorita", "autor")],
        attribute("stazeno").try_cast("date").alias("stazeno"),
        F.when(raw.rlike(r"^\d{4}-\d\d-\d\d$"), raw).try_cast("date").alias("datum"),
        F.when(raw.rlike(r"T\d\d:\d\d"), raw).try_cast("timestamp").alias("ts"),
        "attrs",
        "lists",
        "records",
        "title",
        "body",
    )


def write_document(keys: dict, title: str, body: str) -> str:
    """A document's text from string, list and None values."""
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    lines = ["---"]
    for k, v in keys.items():
        if isinstance(v, list):
            lines += [f"{k}:" + " []" * (not v), *(f"- {quote(x)}" for x in v)]
        else:
            lines.append(f"{k}: {quote(v)}")
    return "\n".join([*lines, "---", "", f"# {title}", "", body])
