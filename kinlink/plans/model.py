"""Training, scoring and reporting of the pair classifier."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import evaluate as E
from kinlink.operators.features import NAMES
from kinlink.plans import trees
from kinlink.ship import ship

ROUNDS = 350
SEED = 2026
NORMALIZER_VERSION = 3


def probabilities(model: PipelineModel, featured: DataFrame, *keep: str) -> DataFrame:
    """(source_id, target_id, keep..., p, is_source2) of featured pairs."""
    ship(featured.sparkSession)
    return model.transform(featured).select("source_id", "target_id", *keep, "p", (F.col("is_source2") > 0).alias("is_source2"))


def trained(featured: DataFrame, labels: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> tuple[PipelineModel, DataFrame]:
    """The model fitted to the pairs of four fifths of the labelled entities, and the scored pairs of the rest."""
    marked = E.holdout(E.with_labels(featured, labels), "source_id").withColumn("label", F.col("label").cast("double")).cache()
    learnt = marked.where("not held_out")
    if learnt.select("label").distinct().count() != 2:
        raise ValueError("both labels must occur among the pairs to learn from")
    ship(featured.sparkSession)
    model = PipelineModel([trees.fitted(learnt, NAMES, rounds, seed)])
    return model, probabilities(model, marked.where("held_out"))


def report(featured: DataFrame, labels: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row: the tuned threshold, its macro F0.5 on the held-out entities, their number, recall and class counts."""
    return report_of(trained(featured, labels, rounds, seed)[1], featured, labels, rounds, seed)


def report_of(scored: DataFrame, featured: DataFrame, labels: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """The report on the held-out pairs that trained() scored."""
    spark = featured.sparkSession
    held = E.holdout(labels, "source1_entity_id").where("held_out").drop("held_out")
    tuned = E.best_policy(E.sweep(scored, held, E.global_grid(spark, 10, 94, 2)))
    recall = E.candidate_recall(featured, labels).select(F.col("recall").alias("candidate_recall"))
    counts = E.with_labels(featured.select("source_id", "target_id"), labels).agg(F.sum("label").alias("positive_pairs"), F.count(F.lit(1)).alias("pairs"))
    row = tuned.select(F.col("t2").alias("threshold"), F.col("f05").alias("macro_f05"), F.col("entities").alias("validation_entities"))
    return row.crossJoin(recall).crossJoin(counts).withColumns({"seed": F.lit(seed), "rounds": F.lit(rounds), "normalizer_version": F.lit(NORMALIZER_VERSION)})
