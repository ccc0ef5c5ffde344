"""Labels, recall, macro F0.5, thresholds and policies, cross-validation, audits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinlink.functions.text import bucket, id_list
from kinlink.operators.features import set_features
from kinlink.scratch import Scratch


def truth(labels: DataFrame) -> DataFrame:
    """(source_id, target_id), one row for each labelled match; repeated rows and elements count once."""
    return labels.select(F.col("source1_entity_id").alias("source_id"), F.explode(id_list("matched_entity_ids")).alias("target_id")).distinct()


def labelled_sources(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("source1_entity_id").alias("source_id")).distinct()


def with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of labelled sources with label 1 if they match, else 0."""
    known = pairs.join(labelled_sources(labels), "source_id", "left_semi")
    return known.join(truth(labels).withColumn("label", F.lit(1)), ["source_id", "target_id"], "left").fillna(0, ["label"])


def candidate_recall(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(hits, actual, recall) of the candidates of labelled sources; recall 0 if there is nothing to find."""
    t = truth(labels)
    hit = t.join(pairs.select("source_id", "target_id").distinct().withColumn("hit", F.lit(1)), ["source_id", "target_id"], "left")
    out = hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("actual"))
    return out.withColumn("recall", F.when(F.col("actual") > 0, F.col("hits") / F.col("actual")).otherwise(0.0))


def fscore(actual: Column, predicted: Column, hit: Column) -> Column:
    """F0.5 of one entity from three counts: nothing to find is right if nothing is predicted."""
    return F.when(actual == 0, F.when(predicted == 0, 1.0).otherwise(0.0)).when((predicted == 0) | (hit == 0), 0.0).otherwise(1.25 * hit / (0.25 * actual + predicted))


def entity_scores(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """(source_id, actual, predicted, hit, f05) for every labelled source; predicted(source_id, target_id)."""
    t = truth(labels)
    p = predicted.select("source_id", "target_id").distinct()
    count = lambda d, c: d.groupBy("source_id").agg(F.count(F.lit(1)).alias(c))
    out = labelled_sources(labels).join(count(t, "actual"), "source_id", "left").join(count(p, "predicted"), "source_id", "left").join(count(p.join(t, ["source_id", "target_id"], "left_semi"), "hit"), "source_id", "left").fillna(0)
    return out.withColumn("f05", fscore(F.col("actual"), F.col("predicted"), F.col("hit")))


def sweep(scored: DataFrame, labels: DataFrame, grid: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(t2, t3, extra..., entities, f05): macro F0.5 of each pair of thresholds of grid(t2, t3), one for pairs of source 2 and
    one for the rest; scored(source_id, target_id, p, is_source2).

    Every source adds to every row of the grid, so its counts are made in two steps: the pairs that pass, by source and row
    (only they are multiplied by the grid, a table of at most a few hundred rows), then what the sources without any such
    pair add, by their number of true matches."""
    extra = extra or []
    sources = labelled_sources(labels)
    if extra:
        sources = sources.join(scored.select("source_id", *extra).distinct(), "source_id")
    counts = sources.join(truth(labels).groupBy("source_id").agg(F.count(F.lit(1)).alias("actual")), "source_id", "left").fillna(0, ["actual"])
    marked = with_labels(scored.drop(*extra), labels).join(counts, "source_id")
    passing = marked.join(F.broadcast(grid), F.col("p") >= F.when(F.col("is_source2"), F.col("t2")).otherwise(F.col("t3")))
    each = passing.groupBy("t2", "t3", *extra, "source_id").agg(F.count(F.lit(1)).alias("predicted"), F.sum("label").alias("hit"), F.first("actual").alias("actual"))
    some = each.groupBy("t2", "t3", *extra).agg(F.sum(fscore(F.col("actual"), F.col("predicted"), F.col("hit"))).alias("score"), F.sum(F.when(F.col("actual") == 0, 1).otherwise(0)).alias("wrongly"))
    whole = counts.groupBy(*extra).agg(F.count(F.lit(1)).alias("entities"), F.sum(F.when(F.col("actual") == 0, 1).otherwise(0)).alias("empty"))
    frame = whole.join(F.broadcast(grid)).join(some, ["t2", "t3", *extra], "left").fillna(0, ["score", "wrongly"])
    return frame.select("t2", "t3", *extra, "entities", ((F.col("score") + F.col("empty") - F.col("wrongly")) / F.col("entities")).alias("f05"))


def global_grid(spark, first: int, last: int, step: int) -> DataFrame:
    """Equal thresholds for both sources, in hundredths."""
    return spark.range(first, last + 1, step).select((F.col("id") / 100.0).alias("t2"), (F.col("id") / 100.0).alias("t3"))


def source_grid(spark, first: int, last: int, step: int) -> DataFrame:
    one = lambda c: spark.range(first, last + 1, step).select((F.col("id") / 100.0).alias(c))
    return one("t2").crossJoin(one("t3"))  # at most some hundred rows


def best_policy(swept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best row of a sweep, of equal ones that with the least thresholds; one for each value of ``by``. Scores are compared
    to 12 places, so that the order in which they were added up decides nothing."""
    by = by or []
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(F.round("f05", 12)), "t2", "t3")
    return swept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cross_validated(scored: DataFrame, labels: DataFrame, grid: DataFrame) -> DataFrame:
    """(fold, t2, t3, tuned, f05): thresholds tuned on the entities of one fold and scored on those of the other."""
    swept = sweep(scored.withColumn("fold", bucket("source_id", 2)), labels, grid, ["fold"]).select("fold", "t2", "t3", "f05")
    tuned = best_policy(swept, ["fold"]).select("fold", "t2", "t3", F.col("f05").alias("tuned"))
    other = swept.select((1 - F.col("fold")).alias("fold"), "t2", "t3", "f05")
    return tuned.join(other, ["fold", "t2", "t3"]).select("fold", "t2", "t3", "tuned", "f05")


def fixed_grid(spark, with_current: bool = False) -> DataFrame:
    """The thresholds that are set beforehand; with those in use, for comparison."""
    return spark.createDataFrame([(0.50, 0.70), *([(0.52, 0.52)] if with_current else [])], "t2 double, t3 double")


def policies_cross_validated(scored: DataFrame, labels: DataFrame, grids: dict[str, DataFrame]) -> DataFrame:
    """(policy, fold, t2, t3, tuned, f05) of each policy's grid in both folds; a grid of one row has nothing to tune."""
    out, scored = None, Scratch(scored.sparkSession, "policies").cut(scored)  # read by every sweep
    for policy, grid in grids.items():
        one = cross_validated(scored, labels, grid).select(F.lit(policy).alias("policy"), "fold", "t2", "t3", "tuned", "f05")
        out = one if out is None else out.union(one)
    return out


def holdout(records: DataFrame, column: str, folds: int = 5) -> DataFrame:
    """Marks about one in ``folds`` records as held out, by a hash of the id."""
    return records.withColumn("held_out", bucket(column, folds) == 0)


def hash_sample(records: DataFrame, column: str, n: int, seed: int = 2026) -> DataFrame:
    """n records with the least seeded hashes: uniform, the same on every run."""
    return records.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column)), 256)).orderBy("_h", column).limit(n).drop("_h")


def missed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled matches that are no candidates."""
    return truth(labels).join(pairs.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")


def miss_audit(pairs: DataFrame, labels: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """How many missed matches share something of each kind: what the retrieval had to go by and didn't use."""
    f = set_features(missed(pairs, labels), sources, targets)
    kinds = {"name_words": "name_jaccard", "name_triples": "name_trigram_jaccard", "address_words": "address_jaccard", "digits": "exact_digit_overlap", "exact_name": "exact_name", "exact_address": "exact_address"}
    return f.agg(F.count(F.lit(1)).alias("missed"), *[F.coalesce(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)), F.lit(0)).alias(k) for k, c in kinds.items()])
