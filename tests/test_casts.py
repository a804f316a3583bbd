from __future__ import annotations

import math
from datetime import date

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratacart.functions.casts import cast_fields, to_bigint, to_date_lenient, to_double, to_int
from stratacart.schemas import BRONZE

INTS = {
    "12": 12, " 4.2 ": 4, "12.7": 12, "-3.9": -3, "5.": 5, ".5": 0, ".": 0, "-.5": 0,
    "1e3": None, "NaN": None, "+7": 7, "2147483647.9": 2147483647, "2147483648": None,
    "-2147483648.5": -2147483648, "4.a": None, "-": None, "--1": None, "1.2.3": None,
    "": None, "\t8\n": 8, "9.9\n": 9,
}


def one_column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def by_index(df, names):
    return {r.i: tuple(r[n] for n in names) for r in df.collect()}


def test_to_int(spark):
    values = [*INTS, None]
    got = by_index(
        one_column(spark, values).select("i", to_int(F.col("v")).alias("n")), ["n"]
    )
    assert [got[i][0] for i in range(len(values))] == [*INTS.values(), None]


def test_to_bigint_reaches_beyond_int(spark):
    values = ["2147483648", "9223372036854775807.5", "9223372036854775808"]
    got = by_index(
        one_column(spark, values).select("i", to_bigint(F.col("v")).alias("n")), ["n"]
    )
    assert [got[i][0] for i in range(3)] == [2147483648, 9223372036854775807, None]


def test_to_double(spark):
    values = ["1e3", "NaN", ".5", "abc", None, " 2.5 "]
    got = by_index(
        one_column(spark, values).select("i", to_double(F.col("v")).alias("n")), ["n"]
    )
    numbers = [got[i][0] for i in range(len(values))]
    assert numbers[0] == 1000.0 and math.isnan(numbers[1])
    assert numbers[2:] == [0.5, None, None, 2.5]


def test_to_date_lenient(spark):
    day = date(2024, 1, 5)
    values = {
        "2024-01-05": day, "2024-1-5": day, "2024-01-05 10:11:12": day,
        "2024-01-05T10:11:12": day, "2024": date(2024, 1, 1), "05/01/2024": None,
        "2024-13-01": None, "junk": None,
    }
    got = by_index(
        one_column(spark, list(values)).select("i", to_date_lenient(F.col("v")).alias("d")),
        ["d"],
    )
    assert [got[i][0] for i in range(len(values))] == list(values.values())


def test_dates_and_timestamps_pass_through(spark):
    df = spark.sql("SELECT DATE '2024-01-05' d, TIMESTAMP_NTZ '2024-01-05 23:59:00' t")
    row = df.select(to_date_lenient(F.col("d")), to_date_lenient(F.col("t"))).first()
    assert tuple(row) == (date(2024, 1, 5), date(2024, 1, 5))


numberish = st.text(alphabet="0123456789+-. e\t\nNa\x7f١", max_size=14)


@settings(
    max_examples=6,
    deadline=None,
    derandomize=True,
    phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(values=st.lists(numberish, min_size=300, max_size=400))
def test_same_as_plain_cast_without_ansi(spark, with_conf, values):
    """The casts under ANSI mode give what plain casts give with ANSI off."""
    legacy = with_conf(spark__sql__ansi__enabled="false")
    ansi = with_conf(spark__sql__ansi__enabled="true")
    names = ["a", "b", "c", "d"]
    v = F.col("v")
    plain = one_column(legacy, values).select(
        "i",
        v.cast("int").alias("a"),
        v.cast("bigint").alias("b"),
        v.cast("double").cast("string").alias("c"),
        F.to_date(v).cast("string").alias("d"),
    )
    ours = one_column(ansi, values).select(
        "i",
        to_int(v).alias("a"),
        to_bigint(v).alias("b"),
        to_double(v).cast("string").alias("c"),
        to_date_lenient(v).cast("string").alias("d"),
    )
    expected, got = by_index(plain, names), by_index(ours, names)
    assert {i: (values[i], got[i], expected[i]) for i in got if got[i] != expected[i]} == {}
    fields = (("i", "int"), ("c", "double"), ("d", "date"))
    texts = one_column(ansi, values).select("i", v.alias("c"), v.alias("d"))
    ours = cast_fields(texts, fields).select(
        "i", F.col("c").cast("string").alias("c"), F.col("d").cast("string").alias("d")
    )
    expected, got = by_index(plain, ["c", "d"]), by_index(ours, ["c", "d"])
    assert {i: (values[i], got[i], expected[i]) for i in got if got[i] != expected[i]} == {}


EDGES = [
    "1d", "1.5F", "0x1p3", "0x.8P-1d", "0x1", "inf", "-Infinity", "+nan", "iNf", "NANd", "1e400",
    ".", "-.e1", "1_0", "٣", " 2.5\x7f", "1e", "2024", "+2024-1", "2024-1-5T", "2024-01-05 x\ny",
    "2024-01-05x", "-0044-03-15", "12024-01-01", "\x002024-02-30", "2024-", "24-01-01", "\u00a02024",
]


def test_edges_as_in_a_plain_cast(spark, with_conf):
    legacy = with_conf(spark__sql__ansi__enabled="false")
    v = F.col("v")
    plain = one_column(legacy, EDGES).select(
        "i",
        v.cast("double").cast("string").alias("c"),
        F.to_date(v).cast("string").alias("d"),
    )
    fields = (("i", "int"), ("c", "double"), ("d", "date"))
    texts = one_column(spark, EDGES).select("i", v.alias("c"), v.alias("d"))
    ours = cast_fields(texts, fields).select(
        "i", F.col("c").cast("string").alias("c"), F.col("d").cast("string").alias("d")
    )
    expected, got = by_index(plain, ["c", "d"]), by_index(ours, ["c", "d"])
    assert {i: (EDGES[i], got[i], expected[i]) for i in got if got[i] != expected[i]} == {}


def test_typed_sources_keep_their_numbers(spark):
    """A database brings its own types; a double keeps its whole part, however large."""
    products = spark.sql(
        "SELECT 5L AS product_id, 'p' AS product_name, 'c' AS category, 'b' AS brand, "
        "CAST(9.5 AS DECIMAL(10,2)) AS price, 12345678.9D AS stock_quantity, 1 AS extra"
    )
    row = cast_fields(products, BRONZE["products"]).first()
    assert tuple(row) == (5, "p", "c", "b", 9.5, 12345678)


def test_key_type(spark):
    raw = spark.sql("SELECT '3000000000' AS customer_id, 'f' AS gender, 'x' AS country, "
                    "'2024' AS signup_date")  # fmt: skip
    assert cast_fields(raw, BRONZE["customers"], "int").first().customer_id is None
    assert cast_fields(raw, BRONZE["customers"]).first().customer_id == 3000000000
    with pytest.raises(ValueError, match="key_type"):
        cast_fields(raw, BRONZE["customers"], "string")
