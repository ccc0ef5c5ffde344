import pytest

from kinlink.llm.lookalike import consistent_forms, same_looking
from kinlink.llm.looks import dominant, repairs, visual_fold


def test_folding_keeps_what_looks_different():
    assert visual_fold("Ｑｕｉｌｌ　ｍａｒｔ") == "Quill mart"
    assert visual_fold("Co­rp​ ﬁrm") == "Corp firm"
    assert visual_fold("é") == "é"
    assert visual_fold("x² ½ É é A a 0 O") == "x² ½ É é A a 0 O"


def test_scripts():
    assert dominant("Vеtеrіnаrу") == "latin"  # most letters are Cyrillic, but some Latin ones have no twin there
    assert repairs("Со", "latin") == ["Co"]
    assert dominant("привет") == "cyrillic" and repairs("привет", "cyrillic") == []
    assert repairs("дом", "latin") == []  # no twin of д


def test_repair_needs_the_vocabulary(spark):
    rows = [("a", "Svarman Traders"), ("b", "Svаrman Traders"), ("c", "Nоwhere Traders"), ("d", None), ("e", ""), ("f", "привет Traders"), ("a", "Svarman Traders")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "entity_id string, text string, spelling_count int")
    got = [(r.entity_id, r.form) for r in consistent_forms(df).collect()]
    assert len(got) == len(rows)
    forms = dict(got)
    assert forms["b"] == "Svarman Traders" and forms["c"] == "Nоwhere Traders" and forms["d"] is None and forms["e"] == "" and forms["f"] == "привет Traders"


def test_pairs(spark):
    rows = [("2", "Corp"), ("1", "Cоrp"), ("3", "CORP"), ("4", "Ｃorp"), ("2", "Corp"), ("5", "Corp"), (None, "Corp"), ("6", None), ("7", "​")]
    df = spark.createDataFrame([("f", *r) for r in rows], "field string, entity_id string, text string")
    got = {(r.entity_id_a, r.entity_id_b) for r in same_looking(df, ["field"]).collect()}
    assert got == {("1", "2"), ("1", "4"), ("1", "5"), ("2", "4"), ("4", "5")}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "field string, entity_id string, text string")
    assert same_looking(df, ["field"]).count() == 0
    with pytest.raises(ValueError):
        consistent_forms(spark.createDataFrame([("a", "b")], "text string, form string"))


def test_plain_letters_are_their_own_form(spark):
    letters = [chr(c) for c in range(0xC0, 0x250)]
    rows = {r.text: r.form for r in consistent_forms(spark.createDataFrame([(x,) for c in letters for x in (c, f"{c} a")], "text string")).collect()}
    for c in letters:
        assert rows[c] == visual_fold(c) and rows[f"{c} a"] == f"{visual_fold(c)} a", c


def test_corroborated_spellings_are_an_option(spark):
    df = spark.createDataFrame([("Nоwhere",), ("Nowherе",)], "text string")
    assert {r.form for r in consistent_forms(df).collect()} == {"Nоwhere", "Nowherе"}
    assert {r.form for r in consistent_forms(df, twice=True).collect()} == {"Nowhere"}
