import random

from kinlink.llm.groups import connected_groups, linked_ids
from tests_util import brute_groups


def _links(spark, rows):
    return spark.createDataFrame(rows, "u string, v string")


def test_random_graphs_against_union_find(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    rows += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]  # a long path
    rows += [("hub", f"leaf{i:03d}") for i in range(200)]  # a hot vertex
    got = {r.entity_id: r.group_id for r in connected_groups(_links(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_lists_with_blanks_nulls_and_padding(spark):
    lists = spark.createDataFrame([("a", "b, c ,,"), (" a ", None), ("d", ""), (None, "e,f"), ("g", "g,g"), (None, None), ("", " ")], "k string, l string")
    got = {r.entity_id: r.group_id for r in connected_groups(linked_ids(lists, "k", "l")).collect()}
    # a row without id links nothing: its elements are ids of their own
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g"}


def test_empty_table(spark):
    assert connected_groups(_links(spark, [])).count() == 0
