from pyspark.sql import functions as F

from kinlink.llm.lookalike import same_looking
from kinlink.scratch import Scratch


def _shuffle_blocks(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(i).name() for i in range(blocks.size()) if blocks.apply(i).isShuffle()}


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark):
    before = _shuffle_blocks(spark)
    settings = {k: spark.conf.get(k, None) for k in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")}
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    written = Scratch(spark, "test").cut(counted)
    assert not _shuffle_blocks(spark) - before  # counted is still referred to: no garbage collection would remove them
    assert written.count() == 7 and counted.count() == 7
    assert all(spark.conf.get(k, None) == v for k, v in settings.items())


def test_look_alikes_leave_no_shuffle_files_before_the_last_join(spark):
    before = _shuffle_blocks(spark)
    texts = spark.createDataFrame([("f", f"{i}", t) for i, t in enumerate(["Corp one", "Cоrp one", "Ｃorp one", "Corp two"])], "field string, entity_id string, text string")
    pairs = same_looking(texts, ["field"])  # written up to its last join
    assert not _shuffle_blocks(spark) - before
    assert {(r.entity_id_a, r.entity_id_b) for r in pairs.collect()} == {("0", "1"), ("0", "2"), ("1", "2")}
