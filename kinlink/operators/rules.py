"""The rule matcher: blocking by canonical name, rare words and digits within a country, rules, score, best K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinlink.functions.text import address_tokens, canonical, clean_text, digit_words, jaccard, name_tokens

MOST_POSTINGS = 50
MOST_EXACT = 20
MOST_CANDIDATES = 8
SHORTEST_RARE = 4
LEAST_OVERLAP = 2


def prepared(records: DataFrame, source: bool) -> DataFrame:
    """What the rules need of records(entity_id, business_name, business_address, country, src, rid). The canonical name of a
    source record is made of its distinct words, that of a target of all of them, so a target that repeats a word has no
    exact partner. Nulls are empty texts."""
    filled = records.select("entity_id", F.coalesce("country", F.lit("")).alias("country"), "src", "rid", F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"))
    cleaned = filled.withColumn("name_clean", clean_text("name")).withColumn("address_clean", clean_text("address"))
    tokens = name_tokens(F.col("name_clean"))
    return cleaned.select(
        "entity_id", "country", "src", "rid",
        F.array_distinct(tokens).alias("name_set"),
        canonical(F.array_distinct(tokens) if source else tokens).alias("canonical_name"),
        F.array_distinct(address_tokens(F.col("address_clean"))).alias("address_set"),
        digit_words(F.concat_ws(" ", "name", "address")).alias("digits"),
        F.regexp_replace("name_clean", " ", "").alias("name_run"),
    )


def one_each(records: DataFrame) -> DataFrame:
    """One record an id, the last delivered."""
    w = W.partitionBy("entity_id").orderBy(F.desc("src"), F.desc("rid"))
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def postings(targets: DataFrame, column: str, shortest: int = 1) -> DataFrame:
    """(country, key, entity_id) of each key of each target record; a record delivered twice is posted twice."""
    return targets.select("country", F.explode(column).alias("key"), "entity_id").where(F.length("key") >= shortest)


def rare(posted: DataFrame, most: int = MOST_POSTINGS) -> DataFrame:
    """Keys with at most ``most`` postings in their country. Counted before anything is joined, so that a key with a third
    of all postings costs one partially aggregated count."""
    return posted.groupBy("country", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)


def block_exact(sources: DataFrame, targets: DataFrame, most: int = MOST_EXACT) -> DataFrame:
    """(source_id, target_id) with one canonical name, of each name the first targets in the order of delivery."""
    w = W.partitionBy("country", "canonical_name").orderBy("src", "rid")
    first = targets.where("canonical_name <> ''").select("country", "canonical_name", "entity_id", "src", "rid").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return sources.where("canonical_name <> ''").select("country", "canonical_name", F.col("entity_id").alias("source_id")).join(first.select("country", "canonical_name", F.col("entity_id").alias("target_id")), ["country", "canonical_name"]).select("source_id", "target_id").distinct()


def _block(sources: DataFrame, targets: DataFrame, column: str, shortest: int, most: int) -> DataFrame:
    posted = postings(targets, column, shortest)
    kept = posted.join(rare(posted, most).select("country", "key"), ["country", "key"], "left_semi")
    wanted = sources.select("country", F.explode(column).alias("key"), F.col("entity_id").alias("source_id"))
    return wanted.join(kept.withColumnRenamed("entity_id", "target_id"), ["country", "key"]).select("source_id", "target_id").distinct()


def block_rare_word(sources: DataFrame, targets: DataFrame, most: int = MOST_POSTINGS) -> DataFrame:
    return _block(sources, targets, "name_set", SHORTEST_RARE, most)


def block_digit(sources: DataFrame, targets: DataFrame, most: int = MOST_POSTINGS) -> DataFrame:
    """Pairs that share a rare number and at least two words of the address."""
    pairs = _block(sources, targets, "digits", 1, most)
    sets = lambda d, i, a: d.select(F.col("entity_id").alias(i), F.col("address_set").alias(a))
    return pairs.join(sets(sources, "source_id", "_a"), "source_id").join(sets(one_each(targets), "target_id", "_b"), "target_id").where(F.size(F.array_intersect("_a", "_b")) >= LEAST_OVERLAP).select("source_id", "target_id")


def candidates(sources: DataFrame, targets: DataFrame, most: int = MOST_POSTINGS) -> DataFrame:
    return block_exact(sources, targets).union(block_rare_word(sources, targets, most)).union(block_digit(sources, targets, most)).distinct()


def _overlap(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def judged(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs(source_id, target_id) with the first rule that holds (0 for none), matched, and the score. sources and targets
    hold one record an id."""
    side = lambda d, s, i: d.select(F.col("entity_id").alias(i), *[F.col(c).alias(f"{s}_{c}") for c in ("name_set", "canonical_name", "address_set", "digits", "name_run")])
    both = pairs.join(side(sources, "s", "source_id"), "source_id").join(side(targets, "t", "target_id"), "target_id")
    both = both.select(
        "source_id", "target_id",
        ((F.col("s_canonical_name") == F.col("t_canonical_name")) & (F.col("s_canonical_name") != "")).alias("exact"),
        jaccard(F.col("s_name_set"), F.col("t_name_set")).alias("nj"), jaccard(F.col("s_address_set"), F.col("t_address_set")).alias("aj"),
        _overlap("s_name_set", "t_name_set").alias("no"), _overlap("s_address_set", "t_address_set").alias("ao"), _overlap("s_digits", "t_digits").alias("do"),
        ((F.size("s_address_set") == 0) | (F.size("t_address_set") == 0)).alias("open"),
        F.exists("s_name_set", lambda t: (F.length(t) >= SHORTEST_RARE) & F.contains(F.col("t_name_run"), t)).alias("within"),
    )
    nj, no, ao, do = (F.col(c) for c in ("nj", "no", "ao", "do"))
    near = (ao >= 2) | ((do >= 1) & (ao >= 1))
    rule = (
        F.when(F.col("exact") & ((ao >= 1) | (do >= 1) | F.col("open")), 1)
        .when(((nj >= 0.5) | (no >= 2)) & near, 2)
        .when(F.col("within") & near, 3)
        .when((do >= 1) & (ao >= 3), 4)
        .when((nj >= 0.85) & ((ao >= 1) | F.col("open")), 5)
        .otherwise(0)
    )
    out = both.withColumn("rule", rule).withColumn("matched", F.col("rule") > 0)
    return out.withColumn("score", F.when(F.col("matched"), 2.0).otherwise(0.0) + nj * 0.6 + F.col("aj") * 0.4).select("source_id", "target_id", "rule", "matched", "score")


def best(scored: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The best candidates of each source by score, ties by id, with their rank."""
    w = W.partitionBy("source_id").orderBy(F.desc("score"), "target_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def output_lists(sources: DataFrame, ranked: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids, matched_entity_ids) for every source, in rank order, empty where there are
    none. Lists hold at most K ids."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["target_id"]), ",")
    pair = F.struct("rank", "target_id")
    lists = ranked.groupBy("source_id").agg(ordered(pair).alias("candidate_entity_ids"), ordered(F.when(F.col("matched"), pair)).alias("matched_entity_ids"))
    out = sources.select(F.col("entity_id").alias("source_id")).join(lists, "source_id", "left")
    return out.select(F.col("source_id").alias("source1_entity_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("candidate_entity_ids", "matched_entity_ids")])
