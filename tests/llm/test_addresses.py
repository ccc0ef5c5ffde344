import pytest

from kinlink.llm.addresses import read_address
from kinlink.llm.gazetteer import same_location


@pytest.mark.parametrize(
    ("raw", "number", "postcode", "street"),
    [
        ("Shop No 891, Svakachil Vihar Industrial Area, Kanedhishabad - 389365, Banatak", "891", "389365", "svakakil vihar industrialarea"),
        ("3rd Flr, 787/A Wing, Radenen Ngr, Opp. Post Office, Tunachikgarh - 165 113", "787", "165113", "radenen nagar"),
        ("Suite 50,1721 S Lorninifrod Hwy,Talsotecott Heights,DE 73727-1234", "1721", "73727", "lorninifrod highway"),
        ("898 bis chemin du Jourariac, 61130 Techenaron CEDEX 4", "898bis", "61130", "jourariak chemin"),
        ("rue du Pont, 12, 75001 Paris", "12", "75001", "pont rue"),
        ("57181 salosathorpe pe 1026 e calnilason hwy", "1026", "57181", "kalnilason highway"),
        ("４１２／A Wing， Radirir Bagh Mg， ８０７４１７", "412", "807417", "radirir bagh marg"),
    ],
)
def test_parts(raw, number, postcode, street):
    a = read_address(raw)
    assert (a.number, a.postcode, a.street) == (number, postcode, street)


def test_nothing():
    assert read_address(None) is None and read_address("  ") is None and read_address("").__class__ is type(None)
    assert read_address("somewhere").number == ""
    read_address("1 " + "x" * 200_000)


def test_locations(spark):
    one = [
        ("a1", "12 Hill Street, Dale, Upland 10001"), ("a2", "12 bis Hill Street, Dale, Upland 10001"), ("a3", "12 N Hill Street, Dale, Upland 10001"), ("a4", None), ("a5", ""), ("a6", "7 Mill Road, Dale, Upland 10001"),
        ("a1", "12 Hill Street, Dale, Upland 10001"), ("a7", "9 Broad Lane, Dale, Upland 10001"),
    ]
    two = [("b1", "Unit 4, 12 Hill St., Dale"), ("b2", "12 Hlil Street; Dale; 10001"), ("b3", "12 S Hill Street, Dale, Upland 10001"), ("b4", None), ("b5", "12 Hill Street, Dale, Upland 10001"), ("b6", "Dale 10001, 7 Mill Rd"), ("b7", "12 Hill Street, Vale, Upland 20002"), ("b8", "10 Broad Lane, Dale, Upland 10001")]
    kinds = "id string, address string, place string"
    got = same_location(spark.createDataFrame([(*r, "x") for r in one], kinds), spark.createDataFrame([(*r, "x") for r in two], kinds)).collect()
    assert {(r.id_a, r.id_b) for r in got} == {("a1", "b1"), ("a1", "b2"), ("a1", "b3"), ("a3", "b1"), ("a3", "b2"), ("a3", "b5"), ("a6", "b6")}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, address string")
    assert same_location(df, df).count() == 0
