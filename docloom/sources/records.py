"""Record files with fixed schemas: JSON lines of members and votes, tab-separated lists, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A map of members stays a map: inference would give a column for each member.
VOTES = (
    "id_hlasovani bigint, schuze int, cislo int, datum date, cas string, nazev string, pro int, proti int, zdrzel int, nehlasoval int, "
    "prihlaseno int, kvorum int, vysledek string, url string, pirati map<string,string>, pirati_souhrn map<string,int>"
)
MEMBERS = "id_osoba bigint, jmeno string, prijmeni string, kluby array<struct<od date, do date>>, funkce_v_klubu string, id_poslanec_podle_obdobi map<string,bigint>"


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOTES).json(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMBERS).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A list of ``extension, source, target`` by tabs; blank lines are passed over."""
    rows = spark.read.csv(path, sep="\t", schema="ext string, src string, dst string", encoding="UTF-8", quote="")
    return rows.filter(F.length(F.trim(F.coalesce("ext", F.lit("")))) > 0)


def append_json(rows: DataFrame, path: str) -> None:
    """Append to a log; nothing leaves for the network."""
    rows.write.mode("append").json(path)


def heterogeneous_tally(raw: DataFrame, column: str) -> DataFrame:
    """A key that is a list of ids in some rows and a struct of totals in others, as ``ids`` and ``tally``."""
    v = F.try_parse_json(column)
    totals = F.struct(*[F.try_variant_get(v, f"$.{k}", "int").alias(k) for k in ("pro", "proti", "zdrzel")])
    ids = F.try_variant_get(v, "$", "array<bigint>")
    return raw.withColumn("ids", ids).withColumn("tally", F.when(F.try_variant_get(v, "$.pro", "int").isNotNull(), totals))
