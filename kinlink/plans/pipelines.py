"""The two pipelines from end to end."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators import features as X
from kinlink.operators import retrieval as R
from kinlink.operators import rules as A
from kinlink.plans import model as M
from kinlink.scratch import Scratch


def rule_matches(sources: DataFrame, targets: DataFrame, most: int = A.MOST_CANDIDATES) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids, matched_entity_ids) of every source record, by the rules."""
    scratch = Scratch(sources.sparkSession, "rules")  # blocks and rules read these tables several times each
    s, t = scratch.cut(A.prepared(A.one_each(sources), True)), scratch.cut(A.prepared(targets, False))
    return A.output_lists(s, A.best(A.judged(A.candidates(s, t), s, A.one_each(t)), most))


def retrieved_features(sources: DataFrame, targets: DataFrame, limit: int = R.LIMIT) -> DataFrame:
    """Candidates of retrieval with their rank and all similarities."""
    scratch = Scratch(sources.sparkSession, "retrieval")
    s, t = scratch.cut(R.normalized(A.one_each(sources))), scratch.cut(R.normalized(targets))
    found = R.retrieve(s, t, limit)
    return X.all_features(found, s, A.one_each(t)).join(found, ["source_id", "target_id"])


def predicted_lists(sources: DataFrame, targets: DataFrame, model: PipelineModel, threshold: float, limit: int = R.LIMIT) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids, matched_entity_ids): candidates in retrieval order, matches those of at
    least the threshold."""
    scored = M.probabilities(model, retrieved_features(sources, targets, limit), "rank")
    return A.output_lists(A.one_each(sources).select("entity_id"), scored.withColumn("matched", F.col("p") >= threshold))
