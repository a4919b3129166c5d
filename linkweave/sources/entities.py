"""Entity tables: TSV files, and the entity view of a documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
SOURCES = ("S1", "S2", "S3")


def resolve_column(columns: list[str], *patterns: str, exact: bool = False) -> str:
    """The column for the first pattern that any column's lower-cased name contains (or equals)."""
    for p in patterns:
        for c in columns:
            if (c.lower() == p) if exact else (p in c.lower()):
                return c
    raise ValueError(f"none of {columns} is like any of {patterns}")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, quote: str = '"') -> DataFrame:
    """A tab-separated file with a header, all strings, an empty field null."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", quote).option("escape", quote or "\\").option("nullValue", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def entities(raw: DataFrame) -> DataFrame:
    """(entity_id, name, address, country) from a table whose columns are found by name."""
    found = {
        "entity_id": resolve_column(raw.columns, "entity_id", "id"),
        "name": resolve_column(raw.columns, "business_name", "name"),
        "address": resolve_column(raw.columns, "business_address", "address", "addr"),
        "country": resolve_column(raw.columns, "country"),
    }
    return raw.select(*[F.col(c).cast("string").alias(k) for k, c in found.items()])


def source_of(entity_id: Column) -> Column:
    """S1, S2 or S3, from the id's prefix."""
    return F.substring(entity_id, 1, 2)


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table seen as entities: (entity_id, name, address, country, src, text).

    The source's number modulo 3 gives S1, S2 or S3; the first six tokens are the name, the next
    twelve and the length the address, the language the country.
    """
    t = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    src = F.concat(F.lit("S"), (F.substring("source", 4, 9).cast("int") % 3 + 1).cast("string"))
    return (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .select("doc_id", "lang", "text", "n_chars", src.alias("src"), t.alias("t"))
        .select(
            F.concat("src", F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
            F.array_join(F.slice("t", 1, 6), " ").alias("name"),
            F.concat(F.array_join(F.slice("t", 7, 12), " "), F.lit(" "), F.col("n_chars").cast("string")).alias("address"),
            F.col("lang").alias("country"),
            "src",
            "text",
        )
    )


def queries_and_pool(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The S1 rows, and the rows of all other sources."""
    return e.where("src = 'S1'"), e.where("src <> 'S1'")


def check_rows(df: DataFrame, expected: int | None) -> DataFrame:
    """Raise if a table has another number of rows than it should."""
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows where {expected} are expected")
    return df
