from kinlink.operators.features import set_features


def test_only_texts_are_joined(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "source_id string, target_id string")
    one = spark.createDataFrame([("S1-1", "oak bakery", "12 elm street")], "entity_id string, name string, address string")
    two = spark.createDataFrame([("S2-1", "oak bakers", "12 elm road")], "entity_id string, name string, address string")
    got = set_features(pairs, one, two)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "array_distinct" not in plan.split("Join", 1)[1]  # token sets are made above all joins
    row = got.first()
    assert (round(row.name_jaccard, 6), row.digit_jaccard, round(row.address_jaccard, 6)) == (0.333333, 1.0, 0.5)
