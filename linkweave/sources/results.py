"""Result lists: one row per query entity with its comma-joined ids, as a table and as a TSV file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
SEPARATORS = (",", ";", "|", " ")


def separator(lists: DataFrame, column: str) -> DataFrame:
    """The separator that most rows contain, and in how many; ties go by SEPARATORS' order."""
    counts = lists.agg(*[F.count_if(F.col(column).contains(s)).alias(f"n{i}") for i, s in enumerate(SEPARATORS)])
    rows = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("rank"), F.lit(s).alias("separator")) for i, s in enumerate(SEPARATORS)])
    return counts.select(F.array_max(rows).alias("best")).select("best.separator", F.col("best.n").alias("n_rows"))


def ids_of(column: Column, sep: str = ",") -> Column:
    """The ids of a list; none for null or empty text."""
    trimmed = F.transform(F.split(F.coalesce(column, F.lit("")), "\\" + sep), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def n_matches(column: Column, sep: str = ",") -> Column:
    """How many ids a list has."""
    return F.size(ids_of(column, sep))


def explode_lists(lists: DataFrame, sep: str = ",") -> DataFrame:
    """Distinct (s1_id, cand_id) pairs."""
    key, ids = lists.columns[:2]
    return lists.select(F.col(key).alias("s1_id"), F.explode(ids_of(F.col(ids), sep)).alias("cand_id")).distinct()


def assemble(s1: DataFrame, pairs: DataFrame, names: tuple[str, str] = MATCHES) -> DataFrame:
    """A row for each distinct query id, its ids sorted and comma-joined, empty if it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias("ids"))
    spine = s1.select(F.col("entity_id").alias("s1_id")).distinct()
    return spine.join(lists, "s1_id", "left").select(F.col("s1_id").alias(names[0]), F.coalesce("ids", F.lit("")).alias(names[1]))


def write_lists(lists: DataFrame, path: str) -> None:
    """Write as TSV without quotes; an empty list is an empty field."""
    lists.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_lines(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    """A result file as it is: (line, is_header, well_formed, key, ids), split at the first tab.
    A header may differ in case and outer spaces."""
    text = spark.read.text(path).select(F.col("value").alias("line"))
    at = F.instr("line", "\t")
    key = F.when(at > 0, F.left(F.col("line"), at - 1)).otherwise(F.col("line"))
    titles = F.transform(F.split("line", "\t"), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return text.select("line", (titles == F.array(*map(F.lit, names))).alias("is_header"), (at > 0).alias("well_formed"), F.trim(key).alias("key"), F.when(at > 0, F.substr("line", at + 1)).alias("ids"))


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a TSV file's first column."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.select(F.col(df.columns[0]).alias("id")).distinct()
