"""Rules over documents: policy, lifecycle, deduplication, sources, periods, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLIC = "verejne"
#: Keys that every document must have.
CORE = ("zdroj", "nazev", "typ", "viditelnost", "stazeno")
#: Further required keys by type.
REQUIRED = {
    "brand": ("autorita", "reviewed_at"),
    "stanovisko": ("datum", "tema", "autorita"),
    "vysledek": ("datum", "shrnuti", "zdroj"),
    "programovy-dokument": ("autorita", "stav", "schvalil", "schvaleno_dne"),
}


def public_only(docs: DataFrame, column: str = "viditelnost") -> DataFrame:
    """The only documents that a public query may return; null is not public."""
    return docs.filter(F.col(column) == PUBLIC)


def approved(docs: DataFrame, column: str = "stav") -> DataFrame:
    return docs.filter(F.col(column) == "schvaleno")


def with_evidence(docs: DataFrame, columns: Sequence[str] = ("zdroj", "autorita")) -> DataFrame:
    """Documents with a provable source and an authority."""
    return docs.filter(" and ".join(f"nullif(trim({c}), '') is not null" for c in columns))


def authority(person: Column) -> Column:
    """A named person's own statement, or the web."""
    return F.when(person.isNotNull(), "vyjadreni-politika").otherwise("web")


def violations(docs: DataFrame, attrs: str = "attrs", key: str = "path") -> DataFrame:
    """``path, rule`` for each required key that a document lacks; nothing is thrown."""
    by_type = F.create_map(*[x for t, keys in REQUIRED.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in keys]))])
    needed = F.array_distinct(F.concat(F.array(*[F.lit(k) for k in CORE]), F.coalesce(F.element_at(by_type, F.element_at(attrs, "typ")), F.array().cast("array<string>"))))
    missing = F.filter(needed, lambda k: F.element_at(F.col(attrs), k).isNull())
    return docs.select(key, F.explode(missing).alias("rule"))


def one_per_content(files: DataFrame, content: Column, path: str = "path", total: bool = False) -> DataFrame:
    """``hash, path, n``: the least path of each content, and how many files have it; ``total`` adds up numeric paths.

    What is null is no content, and nobody's copy.
    """
    hashed = files.filter(content.isNotNull()).select(F.sha2(content, 256).alias("hash"), path)
    return hashed.groupBy("hash").agg(F.min(path).alias(path), F.count("*").alias("n"), *[F.sum(path).alias("total")] * total)


def other_places(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """``path, other``: for each least path the further ones with its content, a row each, however many there are."""
    hashed = files.filter(content.isNotNull()).select(F.sha2(content, 256).alias("hash"), F.col(path).alias("other")).distinct()
    first = hashed.groupBy("hash").agg(F.min("other").alias(path))
    return hashed.join(first, "hash").filter(F.col("other") != F.col(path)).select(path, "other")


def unite(*sources: DataFrame) -> DataFrame:
    """All sources under one schema; missing columns become null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def newly_seen(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(known.select(*keys).distinct(), list(keys), "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def inventory(paths: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Counts of files by first path part and whether the extension is a document's."""
    from ..functions.text import extension

    return paths.select(F.split("path", "/")[0].alias("root"), extension(F.col("path")).isin(*extensions).alias("is_document")).groupBy("root", "is_document").agg(F.count("*").alias("n"))


def prefix_counts(paths: DataFrame, depth: int = 3) -> DataFrame:
    """Counts by the first ``depth`` parts of a path; a doubled first part counts once."""
    parts = F.split("path", "/")
    parts = F.when(F.get(parts, F.lit(0)) == F.get(parts, F.lit(1)), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return paths.select(F.array_join(F.slice(parts, 1, depth), "/").alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def split_by_size(files: DataFrame, size: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Files within the limit, and those rejected with a reason."""
    return files.filter(F.col(size) <= most), files.filter(F.col(size) > most).withColumn("reason", F.lit(f"larger than {most}"))


def superseded(edges: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that no edge revokes; ``edges`` has the keys of what is revoked."""
    return rows.join(edges.select(*key).distinct(), list(key), "left_anti")
