"""Telling whether a stored index belongs to the files it is to be used with, and going on where a run stopped."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import retrieval as R
from kinlink.plans.model import NORMALIZER_VERSION


class StaleIndex(RuntimeError):
    pass


def file_signature(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 over the names, sizes and times of the files below the paths."""
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(paths).select("path", "length", "modificationTime")
    row = meta.select(F.to_json(F.struct(F.element_at(F.split("path", "/"), -1).alias("n"), "length", F.unix_micros("modificationTime").alias("t"))).alias("j"))
    return row.agg(F.sha2(F.to_json(F.array_sort(F.collect_list("j"))), 256).alias("s")).first().s  # one entry a file


def signature_of_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """SHA-256 over the names and row counts of tables."""
    counts = [df.agg(F.concat_ws(":", F.lit(n), F.count(F.lit(1)).cast("string")).alias("c")) for n, df in tables.items()]
    every = counts[0]
    for c in counts[1:]:
        every = every.union(c)
    return every.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("c")), ","), 256).alias("signature"))


def open_index(spark: SparkSession, path: str, files: list[str], targets: DataFrame, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """(normalized targets, postings): read from ``path`` if they were made of these files by this normalizer; built there if
    nothing is there or ``rebuild`` is set; an error if something else is there."""
    expected = {"signature": file_signature(spark, files), "normalizer": str(NORMALIZER_VERSION)}
    jvm = spark.sparkContext._jvm
    manifest = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(manifest) and not rebuild:
        held = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
        if {k: held.get(k) for k in expected} != expected:
            raise StaleIndex(f"{path} was not made of these files; rebuild it")
    else:
        R.normalized(targets).write.mode("overwrite").parquet(f"{path}/records")
        records = spark.read.parquet(f"{path}/records")
        R.index(records).write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
        spark.createDataFrame([(json.dumps(expected | {"records": records.count()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/postings").select("country", "field", "term", "ord")


def remaining(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources without a row in the results done(source1_entity_id) so far."""
    return sources.join(done.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")


def reconciled(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of two result tables whose source is in both: what a stopped run finished."""
    return one.join(other.select("source1_entity_id"), "source1_entity_id", "left_semi"), other.join(one.select("source1_entity_id"), "source1_entity_id", "left_semi")


def same_sources(one: DataFrame, other: DataFrame) -> DataFrame:
    """(same): whether two result tables hold the same set of sources."""
    ids = lambda d: d.select("source1_entity_id").where("source1_entity_id is not null").distinct()
    lone = ids(one).withColumn("_a", F.lit(1)).join(ids(other).withColumn("_b", F.lit(1)), "source1_entity_id", "full").where("_a is null or _b is null")
    return lone.agg((F.count(F.lit(1)) == 0).alias("same"))
