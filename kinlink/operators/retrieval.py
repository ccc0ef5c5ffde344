"""Budgeted full-text retrieval: up to eight queries a source record against an inverted index of the targets.

The index is a table of tokens with their positions. A query is a set of terms that must all occur in the record's field,
in its country; the name phrase must occur as such. Of each query only the first hits in the order of delivery count, as
many as its budget, before hits of different queries are merged; then a record's candidates are cut to the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinlink.functions.text import address_terms, longest_first, name_terms, normal_address, normal_name, parts
from kinlink.scratch import Scratch

LIMIT = 100
#: words that the index knows: no underscore
INDEXED = r"[\p{L}\p{N}]+"


def normalized(records: DataFrame) -> DataFrame:
    """records(entity_id, business_name, business_address, country, src, rid) with normalized name and address; the place in
    the order of delivery interleaves the sources row by row."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return records.select("entity_id", text("country").alias("country"), "src", "rid", normal_name("business_name").alias("name"), normal_address("business_address").alias("address")).withColumn("ord", F.col("rid") * 4 + F.col("src"))


def country_key(column: str = "country"):
    """Countries are compared by their words in lower case; one without words matches nothing."""
    return F.array_join(F.regexp_extract_all(F.lower(column), F.lit(INDEXED), F.lit(0)), " ")


def budgets(limit: int) -> dict[int, int]:
    return {1: max(8, limit // 5), 2: max(10, limit // 4), 3: max(10, limit // 4), 4: max(10, limit // 4), 5: max(4, limit // 40), 6: max(4, limit // 40), 7: max(4, limit // 40), 8: max(8, limit // 6)}


def queries(sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source_id, country, q, budget, phrase, terms): terms are structs of field and term; phrase is null but for q 1."""
    s = sources.withColumn("nt", longest_first(name_terms(F.col("name")), 3)).withColumn("at", longest_first(address_terms(F.col("address")), 3))
    s = s.withColumn("country", country_key()).where("country <> ''").withColumn("first", F.slice(F.array_distinct(parts(F.col("name"))), 1, 6))
    term = lambda field, arr, n: F.transform(F.slice(arr, 1, n), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))
    one = lambda field, arr, i: F.array(F.struct(F.lit(field).alias("field"), F.get(arr, F.lit(i)).alias("term")))
    names, places = F.size("nt"), F.size("at")
    cost = budgets(limit)

    def query(q: int, holds, terms, phrase=None):
        return F.when(holds, F.struct(F.lit(q).alias("q"), F.lit(cost[q]).alias("budget"), (F.lit(None).cast("string") if phrase is None else phrase).alias("phrase"), terms.alias("terms")))

    asked = [
        query(1, (names >= 1) & (F.size("first") >= 1), F.transform("first", lambda t: F.struct(F.lit("name").alias("field"), t.alias("term"))), F.array_join("first", " ")),
        query(2, names >= 2, term("name", "nt", 3)),
        query(3, (names >= 1) & (places >= 1), F.concat(term("name", "nt", 2), term("address", "at", 2))),
        query(4, places >= 1, term("address", "at", 2)),
        query(5, places >= 1, one("address", "at", 0)),
        query(6, places >= 2, one("address", "at", 1)),
        query(7, places >= 3, one("address", "at", 2)),
        query(8, names >= 1, one("name", "nt", 0)),
    ]
    return s.select(F.col("entity_id").alias("source_id"), "country", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).select("source_id", "country", "x.*")


def index(targets: DataFrame) -> DataFrame:
    """(country, field, term, ord) of each distinct indexed word of each field of each target record."""
    each = [targets.select(country_key().alias("country"), F.lit(f).alias("field"), F.explode(F.array_distinct(F.regexp_extract_all(f, F.lit(INDEXED), F.lit(0)))).alias("term"), "ord") for f in ("name", "address")]
    return each[0].union(each[1]).where("country <> ''")


def hits(asked: DataFrame, indexed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_id, q, ord): the first hits of each query, as many as its budget.

    A query that many sources ask is answered once, up to the largest of their budgets. Single terms need no more of a
    word's postings than that, so these are cut before the join; a word with a third of all postings costs a window that
    keeps a few rows of each partition. Queries of several terms are led by their rarest term, whose postings are met with
    those of the next, as numbers; texts are read only where a phrase or a third term is left to be verified."""
    scratch = Scratch(asked.sparkSession, "retrieval")
    most = asked.agg(F.coalesce(F.max("budget"), F.lit(0)).alias("m")).first().m
    indexed = scratch.cut(indexed.select(F.xxhash64("country", "field", "term").alias("k"), "ord"))
    asked = asked.withColumn("terms", F.array_distinct("terms")).withColumn("qk", F.xxhash64("country", "phrase", "terms"))
    asked = scratch.cut(asked.select("source_id", "q", "budget", "qk", "phrase", "terms", F.transform("terms", lambda t: F.xxhash64("country", t["field"], t["term"])).alias("ks")))
    whole = scratch.cut(asked.groupBy("qk", "phrase", "terms", "ks").agg(F.max("budget").alias("most")))
    single = whole.where("size(ks) = 1").select("qk", F.get("ks", F.lit(0)).alias("k"))
    head = indexed.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy("ord"))).where(F.col("_r") <= most).drop("_r")
    found = single.join(head, "k").select("qk", "ord")
    several = whole.where("size(ks) > 1")
    counts = indexed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    each = several.select("qk", F.explode("ks").alias("k")).join(counts, "k")
    lead = each.groupBy("qk").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("l"))  # at most six terms
    open_ = F.col("phrase").isNotNull() | (F.size("ks") > 2)
    lead = lead.join(several.select("qk", F.size("ks").alias("size"), open_.alias("open")), "qk").where("size(l) = size").select("qk", F.get("l", F.lit(0))["k"].alias("k"), F.get("l", F.lit(1))["k"].alias("k2"), "open")
    near = lead.join(indexed, "k").select("qk", "open", "ord", F.col("k2").alias("k"))
    near = scratch.cut(near.join(indexed, ["k", "ord"]).select("qk", "open", "ord"))
    worded = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(c, F.lit(INDEXED), F.lit(0)), " "), F.lit(" ")).alias(c)
    doubtful = near.where("open").select("qk", "ord").join(several.select("qk", "phrase", "terms"), "qk").join(targets.select("ord", worded("name"), worded("address")), "ord")
    holds = F.forall("terms", lambda t: F.contains(F.when(t["field"] == "name", F.col("name")).otherwise(F.col("address")), F.concat(F.lit(" "), t["term"], F.lit(" "))))
    holds = holds & (F.col("phrase").isNull() | F.contains(F.col("name"), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    found = found.union(near.where("not open").select("qk", "ord")).union(doubtful.where(holds).select("qk", "ord"))
    first = found.withColumn("_r", F.row_number().over(W.partitionBy("qk").orderBy("ord"))).where(F.col("_r") <= most)
    return asked.select("source_id", "q", "budget", "qk").join(first, "qk").where("_r <= budget").select("source_id", "q", "ord")


def merged(found: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source_id, target_id, rank): hits of all queries, each target once where it came up first, at most ``limit``."""
    ids = found.join(targets.select("ord", F.col("entity_id").alias("target_id")), "ord")
    first = ids.groupBy("source_id", "target_id").agg(F.min(F.struct("q", "ord")).alias("f"))
    w = W.partitionBy("source_id").orderBy("f.q", "f.ord")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("source_id", "target_id", "rank")


def retrieve(sources: DataFrame, targets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Candidates of normalized sources (one record an id) among normalized targets."""
    return merged(hits(queries(sources, limit), index(targets), targets), targets, limit)
