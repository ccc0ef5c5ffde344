"""Resolving source records as they arrive: files of records in, result lists out, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinlink.plans.pipelines import rule_matches
from kinlink.sources.tables import RECORD

SCHEMA = T.StructType([*RECORD.fields, T.StructField("src", T.IntegerType()), T.StructField("rid", T.LongType())])


def resolve_stream(spark: SparkSession, folder: str, targets: DataFrame, out: str, checkpoint: str, resolve: Callable[[DataFrame, DataFrame], DataFrame] = rule_matches) -> StreamingQuery:
    """Parquet files of source records under ``folder`` matched against the targets; results are appended to ``out`` by batch,
    overwritten if a batch is run again, so every record is answered once. Ends when no file is left."""

    def each(batch: DataFrame, number: int) -> None:
        resolve(batch, targets).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
