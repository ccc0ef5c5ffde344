import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from kinlink.plans import trees
from kinlink.ship import ship


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    made = spark.range(4000).select(F.concat(F.lit("S1-"), "id").alias("source_id"), F.concat(F.lit("S2-"), "id").alias("target_id"), *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(c) for i, c in enumerate("abc")])
    return made.withColumn("label", ((F.col("a") > 0.5) != (F.col("b") > 0.3)).cast("int")).cache()


def test_all_rounds_in_few_jobs(spark, rows):
    spark.sparkContext.setJobGroup("trees", "")
    trees.fitted(rows, ("a", "b", "c"), 350, 1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("trees")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 30  # not some for each level of each tree


def test_what_is_learnt_and_kept(spark, rows, tmp_path):
    model = PipelineModel([trees.fitted(rows, ("a", "b", "c"), 60, 1)])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    got = model.transform(rows).select("source_id", "label", "p").toPandas().sort_values("source_id")
    assert ((got.p > 0.5) == (got.label == 1)).mean() > 0.98
    assert np.array_equal(got.p, again.transform(rows).select("source_id", "p").toPandas().sort_values("source_id").p)


def test_as_many_tasks_as_wanted(spark, rows, monkeypatch):
    one = trees.fitted(rows, ("a", "b", "c"), 20, 1).transform(rows).toPandas().sort_values("source_id")
    monkeypatch.setattr(trees, "ROWS_A_TASK", 2000)
    two = trees.fitted(rows, ("a", "b", "c"), 20, 1).transform(rows).toPandas().sort_values("source_id")
    assert np.allclose(one.p, two.p)


def test_first_split_by_hand():
    rng = np.random.default_rng(0)
    x = rng.integers(0, trees.BINS, (3, 500)).astype(np.uint8)
    g, h = rng.normal(size=500), np.full(500, 0.25)
    feature, cut, value, leaf = trees.grow(x, g, h, np.arange(500), np.arange(3), lambda a: a)
    worth = {}
    for j in range(3):
        for c in range(trees.BINS - 1):
            left = x[j] <= c
            if min(h[left].sum(), h[~left].sum()) >= trees.LEAST_WEIGHT:
                worth[j, c] = sum(g[s].sum() ** 2 / (h[s].sum() + trees.RIDGE) for s in (left, ~left))
    assert (feature[0], cut[0]) == max(worth, key=worth.get)
    for k in set(leaf.tolist()):
        at = leaf == k
        assert np.isclose(value[k], trees.RATE * g[at].sum() / (h[at].sum() + trees.RIDGE))


def test_counted_together_as_one_by_one():
    rng = np.random.default_rng(0)
    bins = [9, 7, 19, 18, 16, 8, 3, 3, 27, 3, 3, 29, 28, 32, 5, 3, 3]
    x = np.stack([rng.integers(0, k, 3000) for k in bins]).astype(np.uint8)
    packed = trees.packs(x, bins)
    assert len(packed) <= 6 and sorted(j for _, features, _ in packed for j in features) == list(range(17))
    at, base, w = np.flatnonzero(rng.random(3000) < 0.7), rng.integers(0, 4, 3000), rng.normal(size=3000)
    place = np.array([j if j < 15 else -1 for j in range(17)])
    got = trees._counted(packed, at, base[at], 4, (w[at],), place)
    assert got.shape == (1, 15, 4, trees.BINS)
    for j in range(15):
        assert np.allclose(got[0, j].ravel(), np.bincount(base[at] * trees.BINS + x[j][at], w[at], 4 * trees.BINS))
