"""The 17 similarities of a candidate pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.text import containment, digit_runs, jaccard, parts, ratio_columns, smaller_share, trigrams

SEQUENCE = ("name_sequence_ratio", "name_sorted_ratio", "address_sorted_ratio")
NAMES = (
    "name_jaccard", "name_containment", "name_trigram_jaccard", "address_jaccard", "address_containment", "digit_jaccard", "exact_name", "exact_address", "name_length_ratio",
    "is_source2", "first_token_overlap", *SEQUENCE, "digit_containment", "exact_digit_overlap", "last_token_overlap",
)


def _context(side: str) -> list:
    """Token sets of the normalized record whose texts are in side_name and side_address."""
    name, address = F.col(f"{side}_name"), F.col(f"{side}_address")
    words = parts(name)
    of = {"names": F.array_distinct(words), "places": F.array_distinct(parts(address)), "digits": digit_runs(address), "triples": trigrams(name), "first": F.coalesce(F.get(words, F.lit(0)), F.lit("")), "last": F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))}
    return [x.alias(f"{side}_{k}") for k, x in of.items()]


def set_features(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs(source_id, target_id) with the 14 similarities that need no sequence alignment, and both texts. Only texts are
    shuffled and sorted, a sixth of what their token sets would be; these are made of the pairs."""
    side = lambda d, s, i: d.select(F.col("entity_id").alias(i), F.col("name").alias(f"{s}_name"), F.col("address").alias(f"{s}_address"))
    j = pairs.join(side(sources, "a", "source_id"), "source_id").join(side(targets, "b", "target_id"), "target_id")
    j = j.select("*", *_context("a"), *_context("b"))
    c = F.col
    flag = lambda x: x.cast("double")
    return j.select(
        "source_id", "target_id", "a_name", "b_name", "a_address", "b_address",
        jaccard(c("a_names"), c("b_names")).alias("name_jaccard"), containment(c("a_names"), c("b_names")).alias("name_containment"), jaccard(c("a_triples"), c("b_triples")).alias("name_trigram_jaccard"),
        jaccard(c("a_places"), c("b_places")).alias("address_jaccard"), containment(c("a_places"), c("b_places")).alias("address_containment"), jaccard(c("a_digits"), c("b_digits")).alias("digit_jaccard"),
        flag((c("a_name") != "") & (c("a_name") == c("b_name"))).alias("exact_name"), flag((c("a_address") != "") & (c("a_address") == c("b_address"))).alias("exact_address"),
        smaller_share(F.length("a_name"), F.length("b_name")).alias("name_length_ratio"), flag(F.startswith(c("target_id"), F.lit("S2-"))).alias("is_source2"),
        flag((c("a_first") != "") & F.array_contains(c("b_names"), c("a_first"))).alias("first_token_overlap"),
        smaller_share(F.size("a_digits"), F.size("b_digits")).alias("digit_containment"), flag(F.arrays_overlap("a_digits", "b_digits")).alias("exact_digit_overlap"),
        flag((c("a_last") != "") & F.array_contains(c("b_names"), c("a_last"))).alias("last_token_overlap"),
    )


def all_features(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    sets = set_features(pairs, sources, targets)
    return sets.withColumn("_r", ratio_columns("a_name", "b_name", "a_address", "b_address")).select("source_id", "target_id", *[F.col(f"_r.{x}").alias(x) if x in SEQUENCE else F.col(x) for x in NAMES])
