"""Rules for result files, as one table of findings: (rule, severity, n, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def _finding(rows: DataFrame, column: str, rule: str, severity: str = "error") -> DataFrame:
    """Count and first examples of the offending values; no more than the examples are gathered."""
    top = rows.select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(EXAMPLES)
    counted = rows.agg(F.count("*").alias("n")).withColumn("v", F.lit(None).cast("string"))
    both = counted.unionByName(top.withColumn("n", F.lit(0).cast("long"))).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("v")).alias("examples"))
    return both.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples").where("n > 0")


def lists(rows: DataFrame, known_ids: DataFrame | None = None, required: DataFrame | None = None) -> DataFrame:
    """Findings on (key, ids): ids comma-joined, null for a line without a tab; such a line that is blank is no fault.

    known_ids: (id), the pool's; without it ids are not looked up. required: (id), the query ids, of
    which each must come once.
    """
    good = rows.where("ids is not null")
    each = good.select("key", F.explode(F.filter(F.split("ids", ","), lambda x: F.trim(x) != "")).alias("raw")).select("key", F.trim("raw").alias("id"))
    repeated = each.groupBy("key", "id").agg(F.count("*").alias("n")).where("n > 1")
    findings = [
        _finding(rows.where(F.col("ids").isNull() & ~F.coalesce("key", F.lit("-")).rlike(r"^\s*$")), "key", "malformed_row"),
        _finding(good.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "duplicate_key"),
        _finding(repeated, "key", "duplicate_id_in_list"),
        _finding(each.where(F.col("id").startswith("S1-")), "id", "self_match"),
        _finding(each.where(~F.col("id").rlike("^S[123]-")), "id", "wrong_prefix"),
    ]
    if known_ids is not None:
        pool = each.where(F.col("id").rlike("^S[23]-")).select("id").distinct()
        findings.append(_finding(pool.join(known_ids.select("id").distinct(), "id", "left_anti"), "id", "unknown_id"))
    if required is not None:
        keys, need = good.select(F.col("key").alias("id")).distinct(), required.select("id").distinct()
        findings.append(_finding(need.join(keys, "id", "left_anti"), "id", "missing_key"))
        findings.append(_finding(keys.join(need, "id", "left_anti"), "id", "unexpected_key"))
    return reduce(DataFrame.unionByName, findings)


def header(line: str | None, names: tuple[str, str]) -> list[tuple[str, str]]:
    """What is wrong with a file's first line: (rule, severity). Case and outer spaces don't matter."""
    if line is None:
        return [("empty_file", "error")]
    if [c.strip().lower() for c in line.split("\t")] == list(names):
        return []
    if "\t" not in line and "," in line:
        return [("comma_separated", "error")]
    return [("bad_header", "error")]


def subset(matches: DataFrame, cands: DataFrame) -> DataFrame:
    """A warning for pairs (s1_id, cand_id) that are matched but were no candidates."""
    outside = matches.select("s1_id", "cand_id").distinct().join(cands.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_anti")
    return _finding(outside.withColumn("v", F.concat_ws(" -> ", "s1_id", "cand_id")), "v", "match_not_candidate", "warning")


def passed(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()
