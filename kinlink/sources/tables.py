"""Reading and writing the tab-separated files of records, labels and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])


class MissingColumns(ValueError):
    pass


def numbered(df: DataFrame, column: str = "rid") -> DataFrame:
    """Adds the row's place, from 0, to what is read from files: files in the order of their names, rows in that of their
    file. Rows are counted by block of a file; nothing is sorted or sent to one task, one number a block reaches the
    driver."""
    spark = df.sparkSession
    marked = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    rows, at = [], 0
    for r in sorted(marked.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("least")).collect(), key=lambda r: (r["_f"], r["_b"])):
        rows.append((r["_f"], r["_b"], at - r["least"]))
        at += r["n"]
    moved = spark.createDataFrame(rows, "_f string, _b bigint, _d bigint")
    return marked.join(F.broadcast(moved), ["_f", "_b"]).withColumn(column, F.col("_i") + F.col("_d")).drop("_f", "_b", "_i", "_d")  # one row a block


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a file, or of a folder of part files, lines counted from 0. Each part has the header of the whole; it
    counts once."""
    raw = spark.read.text(path)
    lines = numbered(raw, "line")
    if len(raw.inputFiles()) < 2 or (first := lines.where("line = 0").first()) is None:
        return lines
    return lines.where((F.col("line") == 0) | (F.col("value") != first.value))


def read_quoted(spark: SparkSession, path: str, src: int = 0, line_breaks: bool = False) -> DataFrame:
    """Records of a quoted file with a header, any order of columns; missing ones are an error, missing values empty.
    line_breaks: quoted values may hold some, for which each file is read by one task."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=line_breaks, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if lacking := [c for c in RECORD_COLUMNS if c not in raw.columns]:
        raise MissingColumns(f"{path}: no column {', '.join(lacking)}")
    return numbered(raw.select(*RECORD_COLUMNS)).na.fill("", list(RECORD_COLUMNS)).withColumn("src", F.lit(src))


def read_plain(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Records of an unquoted file by position: the header is skipped, rows of fewer than four fields are dropped, further
    fields ignored."""
    rows = numbered(spark.read.text(path)).where("rid > 0").select("rid", F.split("value", "\t", -1).alias("f")).where("size(f) >= 4")
    return rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(RECORD_COLUMNS)], "rid", F.lit(src).alias("src"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first fields, without the header and blank lines."""
    lines = _lines(spark, path).where("line > 0")
    return lines.select(F.trim(F.get(F.split("value", "\t"), F.lit(0))).alias("entity_id")).where("entity_id <> ''").distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a file as it is, lines counted from 1."""
    return _lines(spark, path).withColumn("line", F.col("line") + 1)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_results(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(line, source1_entity_id, column) of a result file or folder, as written below; another header is an error."""
    first = read_lines(spark, path).where("line = 1").first()
    if first is None or [c.strip().lower() for c in first.value.split("\t")] != ["source1_entity_id", column]:
        raise MissingColumns(f"{path}: its header isn't source1_entity_id and {column}")
    return read_lists(spark, path).where("list is not null").select("line", F.col("id").alias("source1_entity_id"), F.col("list").alias(column))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, list) of a result file, parted at the first tab; malformed lines have a null list."""
    lines = _lines(spark, path).where("line > 0 and trim(value) <> ''")
    at = F.instr("value", "\t")
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    return lines.select((F.col("line") + 1).alias("line"), F.trim(F.substring_index("value", "\t", 1)).alias("id"), rest.alias("list"))


def interleaved(records: DataFrame) -> DataFrame:
    """(src, rid, entity_id, place): rows of several sources taken in turn.

    The place is made of counts per block of rids, so that no task ever sorts all rows."""
    block = F.floor(F.col("rid") / 65536)
    sizes = records.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for 65,536 rids
    w = W.partitionBy("_b").orderBy("rid", "src")
    return records.withColumn("_b", block).withColumn("_r", F.row_number().over(w)).join(before, "_b").select("src", "rid", "entity_id", (F.col("_base") + F.col("_r")).alias("place"))


def write_lists(lists: DataFrame, path: str, column: str) -> None:
    """(source1_entity_id, column) as a folder of tab-separated files with a header each, nothing quoted."""
    lists.select("source1_entity_id", column).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def replace_lists(lists: DataFrame, path: str, column: str) -> None:
    """The same in the place of what is there, which may be what the lists are made of: written beside it first."""
    spark = lists.sparkSession
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = paths(path), paths(f"{path}.new")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(new, True)
    write_lists(lists, f"{path}.new", column)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path}.new can't be moved to {path}")


def write_ordered(sources: DataFrame, lists: DataFrame, path: str, column: str) -> None:
    """Every source in the order of its file; those without a row get an empty list."""
    full = sources.select(F.col("entity_id").alias("source1_entity_id"), "rid").join(lists.select("source1_entity_id", column), "source1_entity_id", "left")
    full.orderBy("rid").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column)).write.csv(path, sep="\t", header=True, quote="", emptyValue="")
