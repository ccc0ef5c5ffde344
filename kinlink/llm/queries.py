"""The queries of these operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.gazetteer import same_location
from kinlink.llm.groups import connected_groups, linked_ids
from kinlink.llm.language import LanguageModel, language_segments, mislabelled, model_of
from kinlink.llm.leaks import cleaned, leaked_items, leaked_spans
from kinlink.llm.lookalike import consistent_forms, same_looking
from kinlink.llm.matching import match
from kinlink.llm.packing import filling, measured, packed
from kinlink.llm.variants import forms, verified
from kinlink.ship import ship

TABLES = {1: "train_source1", 2: "train_source2", 3: "train_source3"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "train_source1").select(F.lit("name").alias("field"), "entity_id", F.col("business_name").alias("text"))
    return names.union(_read(spark, sf_dir, "train_source2").select(F.lit("address"), "entity_id", "business_address"))


def p1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p1_found with their confidence."""
    ours = lambda i: _read(spark, sf_dir, TABLES[i]).select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")
    links = linked_ids(_read(spark, sf_dir, "train_labels"), "source1_entity_id", "matched_entity_ids").where("u is not null").select(F.col("u").alias("id"), F.col("v").alias("other"))
    pairs, _ = match(ours(1), ours(2).union(ours(3)), links)
    return pairs.select(F.col("a_id").alias("source1_entity_id"), F.col("b_id").alias("entity_id"), "confidence")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_scored(spark, sf_dir).select("source1_entity_id", "entity_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (_read(spark, sf_dir, TABLES[i]).select(F.col("entity_id").alias("id"), F.col("business_address").alias("address")) for i in (1, 2))
    return same_location(one, two).select(F.col("id_a").alias("source1_entity_id"), F.col("id_b").alias("source2_entity_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, three = (_read(spark, sf_dir, TABLES[i]).select("entity_id", F.col("business_name").alias("name")).where("entity_id is not null").distinct() for i in (1, 3))
    pairs = forms(verified(one.select("name"), three.select("name"))).where("name_a <> name_b")
    left = one.select(F.col("entity_id").alias("source1_entity_id"), F.col("name").alias("name_a"))
    right = three.select(F.col("entity_id").alias("source3_entity_id"), F.col("name").alias("name_b"))
    return pairs.join(left, "name_a").join(right, "name_b").select("source1_entity_id", "source3_entity_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking(_texts(spark, sf_dir), ["field"]).select("entity_id_a", "entity_id_b").distinct()


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its consistent form."""
    return consistent_forms(_texts(spark, sf_dir), ["field"])


def _model(spark: SparkSession, sf_dir: str) -> LanguageModel:
    return model_of(_read(spark, sf_dir, "lang_samples"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pack_limits"))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers of p6_packed hold, for each capacity. Without their fill and number, which depend on the packing,
    so that SQL can tell what they must be."""
    documents = _read(spark, sf_dir, "documents")
    got = filling(packed(documents, _read(spark, sf_dir, "pack_limits")), measured(documents))
    return got.selectExpr("limit_id", "capacity_tokens", "texts", "tokens = placed as all_placed", "cast(repeated as int) as repeated", "cast(cut as int) as cut", "cast(over as int) as over", "fill > 0.9 as well_filled")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items")).distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of speech that holds a passage, with how much of it."""
    return leaked_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages it holds."""
    return cleaned(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_read(spark, sf_dir, "documents"), _model(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every document, with its confidence."""
    return language_segments(_read(spark, sf_dir, "documents"), _model(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(linked_ids(_read(spark, sf_dir, "matching_results"), "source1_entity_id", "matched_entity_ids")).select("group_id", "entity_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_scored, p2_found, p3_found, p4_found, p4_forms, p5_found, p6_packed, p6_check, p7_found, p7_spans, p7_cleaned, p8_found, p8_segments)}

ORACLE_SQL: dict[str, str] = {
    "p6_check": """
        SELECT limit_id, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, true AS all_placed,
               0 AS repeated, 0 AS cut, 0 AS over, true AS well_filled FROM pack_limits""",
    "p5_found": """
        WITH RECURSIVE each AS (
            SELECT nullif(trim(source1_entity_id), '') AS u, nullif(trim(v), '') AS v
            FROM (SELECT source1_entity_id, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS v FROM matching_results)),
        link AS (SELECT u AS a, v AS b FROM each WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM each WHERE u IS NOT NULL AND v IS NOT NULL),
        ids AS (SELECT u AS id FROM each WHERE u IS NOT NULL UNION SELECT v FROM each WHERE v IS NOT NULL),
        reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
        SELECT min(b) AS group_id, a AS entity_id FROM reach GROUP BY a""",
}
