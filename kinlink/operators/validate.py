"""Checks of result lists: shape, ids, duplicates, completeness. Each is one row of findings for each offending thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: checks that only warn
WARNINGS = ("match_not_candidate", "candidates_missing", "targets_missing", "ids_unchecked")


def _elements(lists: DataFrame, column: str) -> DataFrame:
    """(source_id, element) of every list; an empty list has no element, ``a,,b`` has an empty one."""
    rest = F.coalesce(F.col(column), F.lit(""))
    return lists.select(F.col("source1_entity_id").alias("source_id"), F.explode(F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))).alias("element"))


def _finding(df: DataFrame, check: str, subject: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.coalesce(subject, F.lit("")).alias("subject")).distinct()


def one_finding(spark: SparkSession, file: str, check: str, subject: str = "") -> DataFrame:
    return spark.createDataFrame([(file, "warning" if check in WARNINGS else "error", check, subject)], "file string, severity string, check string, subject string")


def malformed(lines: DataFrame, file: str, column: str) -> tuple[DataFrame, bool]:
    """(file, severity, check, subject) of what is wrong with the raw lines(line, value) of a result file, and whether its
    rows can be checked: not so if it is empty or no UTF-8, or its header isn't that of the column."""
    one = lambda check, subject: one_finding(lines.sparkSession, file, check, subject)
    if garbled := lines.where(~F.is_valid_utf8("value")).select("line").orderBy("line").first():
        return one("not_utf8", f"line {garbled.line}"), False
    first = lines.where("line = 1").first()
    if first is None:
        return one("empty_file", ""), False
    if "\t" not in first.value and "," in first.value:
        return one("comma_separated", first.value), False
    if [c.strip().lower() for c in first.value.split("\t")] != ["source1_entity_id", column]:
        return one("wrong_header", first.value), False
    rows = lines.where((F.col("line") > 1) & (F.trim("value") != "") & (F.instr("value", "\t") == 0))
    return rows.select(F.lit(file).alias("file"), F.lit("error").alias("severity"), F.lit("row_without_tab").alias("check"), F.concat_ws(":", F.col("line").cast("string"), "value").alias("subject")), True


def duplicate_rows(lists: DataFrame) -> DataFrame:
    return _finding(lists.groupBy("source1_entity_id").count().where("count > 1"), "duplicate_row", F.col("source1_entity_id"))


def repeated_elements(lists: DataFrame, column: str) -> DataFrame:
    rest = F.split(F.coalesce(F.col(column), F.lit("")), ",")
    some = F.trim(F.coalesce(F.col(column), F.lit(""))) != ""
    return _finding(lists.where(some & (F.size(rest) != F.size(F.array_distinct(rest)))), "repeated_id", F.col("source1_entity_id"))


def self_matches(lists: DataFrame, column: str) -> DataFrame:
    return _finding(_elements(lists, column).where(F.startswith("element", F.lit("S1-"))), "self_match", F.concat_ws(":", "source_id", "element"))


def foreign_ids(lists: DataFrame, column: str) -> DataFrame:
    e = F.col("element")
    return _finding(_elements(lists, column).where(~(F.startswith(e, F.lit("S1-")) | F.startswith(e, F.lit("S2-")) | F.startswith(e, F.lit("S3-")))), "foreign_id", F.concat_ws(":", "source_id", "element"))


def unknown_ids(lists: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    known = targets.select(F.col("entity_id").alias("element")).distinct()
    e = _elements(lists, column).where(F.startswith("element", F.lit("S2-")) | F.startswith("element", F.lit("S3-")))
    return _finding(e.join(known, "element", "left_anti"), "unknown_id", F.concat_ws(":", "source_id", "element"))


def missing_sources(lists: DataFrame, required: DataFrame) -> DataFrame:
    return _finding(required.join(lists, required.entity_id == lists.source1_entity_id, "left_anti"), "missing_source", F.col("entity_id"))


def extra_sources(lists: DataFrame, required: DataFrame) -> DataFrame:
    return _finding(lists.join(required, required.entity_id == lists.source1_entity_id, "left_anti"), "extra_source", F.col("source1_entity_id"))


def _last(lists: DataFrame) -> DataFrame:
    """Of a source in several rows the last, if the rows have a line."""
    if "line" not in lists.columns:
        return lists
    w = W.partitionBy("source1_entity_id").orderBy(F.desc("line"))
    return lists.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unmatched_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sources with matches that are no candidates of theirs."""
    m, c = _elements(_last(matches), "matched_entity_ids"), _elements(_last(candidates), "candidate_entity_ids")
    return _finding(m.join(c, ["source_id", "element"], "left_anti"), "match_not_candidate", F.col("source_id"))


def list_counts(lists: DataFrame, column: str) -> DataFrame:
    """(rows, empty, non_empty): rows of a result file, and those with and without a list."""
    empty = F.sum((F.trim(F.coalesce(F.col(column), F.lit(""))) == "").cast("int"))
    return lists.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(empty, F.lit(0)).alias("empty")).withColumn("non_empty", F.col("rows") - F.col("empty"))


def all_findings(matches: DataFrame | None, candidates: DataFrame | None, required: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(file, severity, check, subject) of every finding in the lists that there are, one at least. Checks of ids need the targets and are left out without them."""
    out = []
    for name, lists, column in (("matching_results", matches, "matched_entity_ids"), ("candidate_pairs", candidates, "candidate_entity_ids")):
        if lists is None:
            continue
        found = [duplicate_rows(lists), repeated_elements(lists, column), self_matches(lists, column), foreign_ids(lists, column), missing_sources(lists, required), extra_sources(lists, required)]
        if targets is not None:
            found.append(unknown_ids(lists, column, targets))
        out += [f.select(F.lit(name).alias("file"), "check", "subject") for f in found]
    if matches is not None and candidates is not None:
        out.append(unmatched_candidates(matches, candidates).select(F.lit("matching_results").alias("file"), "check", "subject"))
    every = out[0]
    for f in out[1:]:
        every = every.union(f)
    return every.withColumn("severity", F.when(F.col("check").isin(*WARNINGS), "warning").otherwise("error"))


def summary(findings: DataFrame, examples: int = 5) -> DataFrame:
    """(file, severity, check, n, examples): how many of each kind, and the first few in order."""
    counted = findings.groupBy("file", "severity", "check").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("file", "severity", "check").orderBy("subject")
    few = findings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples).groupBy("file", "severity", "check").agg(F.array_join(F.array_sort(F.collect_list("subject")), " ").alias("examples"))
    return counted.join(few, ["file", "severity", "check"])
