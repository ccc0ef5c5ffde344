from pyspark.sql import functions as F

from kinlink.operators import evaluate as E
from kinlink.operators import retrieval as R
from kinlink.operators import rules as A
from kinlink.plans.pipelines import rule_matches

KIND = "entity_id string, business_name string, business_address string, country string, src int, rid bigint, score string"


def records(spark, rows, src):
    return spark.createDataFrame([(*r, "US" if len(r) == 3 else None, src, i, "x")[:7] if len(r) == 3 else (*r, src, i, "x") for i, r in enumerate(rows)], KIND)


def test_caps_and_rules(spark):
    one = records(spark, [("S1-1", "foo bar", "12 Elm Hill"), ("S1-2", None, None), ("S1-3", "SJ Ace Vendome Inc", "9 Oak Hill"), ("S1-4", "lonely", "")], 1)
    two = records(spark, [(f"S2-{i:02d}", "Bar Foo Ltd", "12 Elm Hill") for i in range(21)] + [("S2-90", "foo foo bar", "12 Elm Hill"), ("S2-91", "sjacevendome.com", "9 Oak Hill"), ("S2-92", None, "")], 2)
    s, t = A.prepared(one, True), A.prepared(two, False)
    assert A.block_exact(s, t).where("source_id = 'S1-1'").count() == 20
    assert not {"S2-20", "S2-90"} & {r.target_id for r in A.block_exact(s, t).collect()}
    got = {r.source1_entity_id: r for r in rule_matches(one, two).collect()}
    assert set(got) == {"S1-1", "S1-2", "S1-3", "S1-4"}
    assert got["S1-2"].candidate_entity_ids == "" and got["S1-4"].matched_entity_ids == ""
    assert len(got["S1-1"].candidate_entity_ids.split(",")) == 8
    assert got["S1-3"].matched_entity_ids == "S2-91"
    for r in got.values():
        assert set(r.matched_entity_ids.split(",")) - {""} <= set(r.candidate_entity_ids.split(","))


def test_rare_keys(spark):
    post = spark.createDataFrame([("US", "w50", str(i)) for i in range(50)] + [("US", "w51", str(i)) for i in range(51)], "country string, key string, entity_id string")
    assert [r.key for r in A.rare(post).collect()] == ["w50"]


def test_retrieval(spark):
    one = R.normalized(records(spark, [("S1-1", "Alpha Beta", "Longword 5"), ("S1-2", "a b a c", "x"), ("S1-3", "Gamma", "")], 1).withColumn("country", F.when(F.col("entity_id") == "S1-3", "").otherwise("US")))
    two = R.normalized(records(spark, [("S2-1", "Alpha Beta Inc", "nowhere"), ("S2-2", "beta alpha", "longword"), ("S2-3", "a b a c", "y"), ("S2-4", "Gamma", "")], 2))
    got = {(r.source_id, r.target_id): r.rank for r in R.retrieve(one, two).collect()}
    assert got[("S1-1", "S2-1")] == 1 and got[("S1-1", "S2-2")] == 2
    assert not any(s == "S1-3" for s, _ in got)
    asked = {(r.source_id, r.q): r.phrase for r in R.queries(one).collect()}
    assert ("S1-2", 1) not in asked or asked[("S1-2", 1)] == "a b c"
    many = R.normalized(records(spark, [(f"S2-{i:03d}", "Alpha Beta", "") for i in range(150)], 2))
    ranks = [r.rank for r in R.retrieve(one, many, 20).where("source_id = 'S1-1'").collect()]
    assert sorted(ranks) == list(range(1, 11))  # 8 by phrase, 10 by both words: the first ones again


def test_scores(spark):
    labels = spark.createDataFrame([("a", "x,y"), ("b", ""), ("c", None), ("d", "z"), ("a", "x,y")], "source1_entity_id string, matched_entity_ids string")
    predicted = spark.createDataFrame([("a", "x"), ("b", "q"), ("d", "z")], "source_id string, target_id string")
    f = {r.source_id: r.f05 for r in E.entity_scores(predicted, labels).collect()}
    assert f == {"a": 1.25 * 1 / (0.25 * 2 + 1), "b": 0.0, "c": 1.0, "d": 1.0}
    for actual, guessed, hit in [(3, 2, 1), (1, 1, 1), (5, 4, 3)]:
        p, r = hit / guessed, hit / actual
        assert abs(1.25 * p * r / (0.25 * p + r) - 1.25 * hit / (0.25 * actual + guessed)) < 1e-12
    scored = spark.createDataFrame([("a", "x", 0.9, True), ("a", "q", 0.3, False), ("b", "q", 0.6, False), ("d", "z", 0.5, True)], "source_id string, target_id string, p double, is_source2 boolean")
    swept = {(r.t2, r.t3): r.f05 for r in E.sweep(scored, labels, E.global_grid(spark, 20, 80, 20)).collect()}
    brute = {}
    for t in (0.2, 0.4, 0.6, 0.8):
        kept = scored.where(F.col("p") >= t).select("source_id", "target_id")
        brute[(t, t)] = E.entity_scores(kept, labels).agg(F.avg("f05").alias("m")).first().m
    assert {k: round(v, 9) for k, v in swept.items()} == {k: round(v, 9) for k, v in brute.items()}
    best = E.best_policy(E.sweep(scored, labels, E.global_grid(spark, 20, 80, 20))).first()
    assert best.f05 == max(swept.values()) and best.t2 == min(t for (t, _), v in swept.items() if abs(v - best.f05) < 1e-12)
