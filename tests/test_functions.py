"""Golden edge cases for the column functions (query parsing, names, ratings, URLs)."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import queryparse as QP
from shelfspark.functions import text as T
from shelfspark.functions import urls as U


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("q,expect", [
    ("hoodies under $100", dict(intent="hoodies", max_price=100.0, min_price=None)),
    ("Roots jackets made in canada", dict(intent="Roots jackets", brand="Roots", wants_origin=True)),
    ("warm winter boots 4+ stars", dict(intent="warm winter boots", min_rating=4.0)),
    ("$50-$100 jacket", dict(intent="jacket", min_price=50.0, max_price=100.0)),
    ("jackets 2 to 4 stars", dict(intent="jackets stars", min_price=2.0, max_price=4.0, min_rating=4.0)),
    ("FABRIQUÉ AU CANADA tuque", dict(intent="tuque", wants_origin=True)),
    ("hi", dict(intent="hi")),
])
def test_parse_query(spark, q, expect):
    row = QP.parse_queries(spark.createDataFrame([(q,)], "text string")).first()
    for k, v in expect.items():
        assert row[k] == v, (q, k, row[k])


@pytest.mark.parametrize("name,norm", [
    ("Flag Fleece Hoodie Black", "flag fleece hoodie"),
    ("Classic T-Shirt - S", "t-shirt"),
    ("Men's Joggers", "joggers"),
    ("Black Men's Hoodie", "men's hoodie"),
])
def test_normalize_name(spark, name, norm):
    assert one(spark, T.normalize_name(F.col("x")), name) == norm


def test_product_type_substring_quirk(spark):
    assert one(spark, T.product_type(F.col("x")), "Laptop Sleeve") == "top"


def test_url_base(spark):
    assert one(spark, U.url_base(F.col("x")), "https://x/p/mens-hoodie-xl?v=1") == "https://x/p/menhoodie"


@pytest.mark.parametrize("r,n,expect", [
    (None, 100, 4.0), (5.0, 1, 4.0), (3.5, 2, 4.0), (3.5, 50, 3.5), (4.8, 100, 520 / 110), (5.0, 10, 4.5)])
def test_smooth_rating(spark, r, n, expect):
    df = spark.createDataFrame([(r, n)], "r double, n int")
    got = df.select(T.smooth_rating("r", "n").alias("s")).first()["s"]
    assert got == pytest.approx(expect)


@pytest.mark.parametrize("price,expect", [("$1,299.00 CAD", 1299.0), ("N/A", None), ("1.2.3", None)])
def test_price_number(spark, price, expect):
    assert one(spark, T.price_number(F.col("x")), price) == expect


def test_tracked_url_encoding(spark):
    got = one(spark, U.tracked_url(F.col("x"), base_url="http://h", product_name=F.lit("A b~*")), "https://s/p")
    assert got == "http://h/click?url=https%3A%2F%2Fs%2Fp&product_name=A+b~%2A"


def test_add_utm(spark):
    got = one(spark, U.add_utm(F.col("x"), {"utm_source": "z2", "utm_medium": "referral", "utm_campaign": "c",
                                            "referrer": "r"}), "https://a.com/p?x=1&utm_source=z&b=#f")
    assert got == "https://a.com/p?x=1&utm_source=z&utm_medium=referral&utm_campaign=c&referrer=r#f"


def test_brand_display(spark):
    df = spark.createDataFrame([(None, "www.roots.com"), (None, "src3.example.com"), (None, None), ("B", "x")],
                               "b string, s string")
    got = [r[0] for r in df.select(T.brand_display("b", "s")).collect()]
    assert got == ["Roots", "Src3.Example", "Unknown Brand", "B"]


def test_owned_flag(spark):
    df = spark.createDataFrame([("Yes",), ("✘",), ("Partly",)], "x string")
    assert [r[0] for r in df.select(T.owned_flag("x")).collect()] == [True, False, None]
