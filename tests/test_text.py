import unicodedata

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "tokens", "name"),
    [
        ("BS Projects Ltd Ltd", ["bs", "projects"], "bs projects"),
        ("Limited Company", [], ""),
        ("Novent Ówl PLLC", ["novent", "owl"], "novent owl"),
        ("PLLC Novent Ówl", ["novent", "owl"], "pllc novent owl"),
        ("L’Oréal", ["loreal"], "l oreal"),
        ("Straße Œuvre ½", ["strae", "uvre", "12"], "strasse œuvre 1 2"),
        ("उत्तर प्रदेश", [], "उततर परद श"),
        (None, [], ""),
        ("", [], ""),
    ],
)
def test_names(spark, raw, tokens, name):
    assert one(spark, raw, X.name_tokens(X.clean_text("v"))) == tokens
    assert one(spark, raw, X.normal_name("v")) == name


def test_digits(spark):
    assert one(spark, "12A 12 a-12", X.digit_words("v")) == ["12"]
    assert one(spark, "12a 7", X.digit_runs("v")) == ["12", "7"]


def test_address(spark):
    assert one(spark, "12 Main St., Ste 4", X.normal_address("v")) == "12 main street suite 4"
    assert one(spark, "Shop No 4, 12 Main Road", X.address_tokens(X.clean_text("v"))) == ["12", "main"]


def test_terms(spark):
    assert one(spark, "bb aaa ccc aaa d", X.longest_first(X.name_terms(F.col("v")), 3)) == ["ccc", "aaa", "bb"]
    assert one(spark, "ab", X.trigrams(F.col("v"))) == [" ab", "ab "] and one(spark, "", X.trigrams(F.col("v"))) == [] and one(spark, "a", X.trigrams(F.col("v"))) == [" a "]


def test_word_class_agrees_with_python(spark):
    values = [s for i in (1, 2, 3) for c in ("business_name", "business_address") for s in pd.read_parquet(f"/root/testdata/sf0.001/train_source{i}.parquet")[c].dropna()]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(X.clean_text("v").alias("a"), X.normal_address("v").alias("b")).collect()
    import re

    for v, r in zip(values, got, strict=True):
        a = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower())).strip()
        b = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).casefold()
        assert r.a == a
        from kinlink.functions.wordlists import ADDRESS_WORDS

        assert r.b == " ".join(ADDRESS_WORDS.get(t, t) for t in re.findall(r"\w+", b))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@given(st.text("abé ", max_size=80), st.text("abé ", max_size=80))
def test_sequence_ratio(a, b):
    assert X.common_length(a, b) == lcs(a, b)
    assert X.indel_ratio(a, b) == X.indel_ratio(b, a)
    assert X.indel_ratio(a, a) == (1.0 if a else 0.0)
    assert X.sorted_ratio("b a", "a  b") == 1.0


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), ([], [])], "a array<string>, b array<string>")
    rows = df.select(X.jaccard(F.col("a"), F.col("b")).alias("j"), X.jaccard(F.col("b"), F.col("a")).alias("k"), X.containment(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.j, r.k, r.c) for r in rows] == [(0.5, 0.5, 1.0), (0, 0, 0), (0, 0, 0)]
