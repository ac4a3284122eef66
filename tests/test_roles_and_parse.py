import pytest
from pyspark.sql import functions as F

from tablewright.config import ImportanceConfig, ImputationConfig, SchemaConfig
from tablewright.functions.parse import MISSING_TOKENS, as_number, label_missing, name
from tablewright.functions.stats import adjusted_skewness, average_ranks
from tablewright.operators.roles import Roles, classify, coerce, numeric_fractions

NUMBERS = {" 7 ": 7.0, "\t8": 8.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "+5": 5.0, "-2.5e-1": -0.25, "inf": float("inf"), "-Infinity": float("-inf")}
NOT_NUMBERS = ["1d", "2f", "1_000", "0x10", "1e400", "nan", "NaN", "", "-", "--", "1,5", "1 2", "e5", ".", "ten", None, "٣"]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(t,) for t in [*NUMBERS, *NOT_NUMBERS]], "t string")
    got = {r.t: r.v for r in df.select("t", as_number(F.col("t"), df.schema["t"].dataType).alias("v")).collect()}
    assert got == NUMBERS | dict.fromkeys(NOT_NUMBERS)


def test_nan_counts_as_missing_and_booleans_as_numbers(spark):
    df = spark.createDataFrame([(float("nan"), True, 1), (1.5, None, None)], "d double, b boolean, i int")
    rows = df.select(*(as_number(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns)).collect()
    assert [tuple(r) for r in rows] == [(None, 1.0, 1.0), (1.5, None, None)]


def test_missing_labels(spark):
    lost = [None, "", "  ", " ", " nAn ", "N/a", "nUlL", "NONE", "-", "--", "　NA\t", "\x1cna\x85"]
    kept = ["n.a.", "unknown", "---", "0", " x "]
    df = spark.createDataFrame([(t,) for t in [*lost, *kept]], "t string")
    assert [r.m for r in df.select(label_missing(F.col("t")).alias("m")).collect()] == [True] * len(lost) + [False] * len(kept)
    assert len(MISSING_TOKENS) == 10


def text_frame(spark):
    rows = [("word" if i == 9 else str(i * 3), str(i), "abcde"[i % 5], ["4", "", "nan", "NA", "5", "6", "7", "8", "9", "1"][i]) for i in range(10)]
    return spark.createDataFrame(rows, "mostly string, clean string, label string, tokens string")


def test_threshold_is_inclusive(spark):
    df = text_frame(spark)
    assert numeric_fractions(df) == {"mostly": 0.9, "clean": 1.0, "label": 0.0, "tokens": 1.0}
    assert classify(df).numeric == ("mostly", "clean", "tokens")
    assert classify(df, SchemaConfig(numeric_threshold=0.95)).numeric == ("clean", "tokens")


def test_every_column_has_one_role(spark):
    df = spark.createDataFrame([(1, 0.5, None, "x", None)], "PAT_ID long, Y2 double, hollow double, word string, `a.b` string")
    roles = classify(df)
    assert sorted(roles.pick(tagged=True)) == sorted(df.columns) and not set(roles.numeric) & set(roles.categorical)
    assert roles.identifiers == ("PAT_ID",) and roles.outcomes == ("Y2",) and "hollow" in roles.categorical
    assert roles.pick() == ["hollow", "word", "a.b"] and roles.pick("numeric") == [] and roles.pick(without=("word",)) == ["hollow", "a.b"]
    assert roles.counts() == {"numeric": 2, "categorical": 3, "identifiers": 1, "outcomes": 1}


def test_names_with_dots_and_differing_by_case(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([("1", "2", "a")], "`x.y` string, X1 string, x1 string")
        assert classify(df).numeric == ("x.y", "X1") and coerce(df, classify(df)).first()[:] == (1.0, 2.0, "a")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_coerce_leaves_its_input_and_skipped_columns(spark):
    df = text_frame(spark)
    out = coerce(df, classify(df), ("mostly",))
    assert out.columns == df.columns and dict(out.dtypes)["mostly"] == "string" and dict(df.dtypes)["clean"] == "string"
    assert [r.tokens for r in out.collect()] == [4.0, None, None, None, 5.0, 6.0, 7.0, 8.0, 9.0, 1.0]


def test_dates_are_labels_and_nested_types_are_refused(spark):
    df = spark.sql("SELECT date'2024-01-01' AS d, timestamp'2024-01-01 00:00:00' AS t, CAST(1.5 AS DECIMAL(5, 2)) AS m")
    assert classify(df) == Roles(("m",), ("d", "t"))
    with pytest.raises(TypeError):
        classify(spark.sql("SELECT array(1) AS a"))


@pytest.mark.parametrize("make", [lambda: SchemaConfig(numeric_threshold=0), lambda: SchemaConfig(numeric_threshold=1.1), lambda: ImputationConfig(n_neighbors=0), lambda: ImputationConfig(weights="x"), lambda: ImportanceConfig("Y1", test_size=1.0)])
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_average_ranks_match_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(-5, 5, 300).astype(float), rng.normal(0, 1e6, 300), rng.normal(0, 1e-9, 50)])
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r["rank"] for r in average_ranks(df, ["g"], "v", "n").collect()}
    assert [got[v] for v in values] == pd.Series(values).rank().tolist()


def test_skewness(spark):
    import pandas as pd

    data = {"a": [1.0, 2.0, 3.0, 10.0, None], "b": [4.0] * 5, "c": [1.0, 2.0, None, None, None]}
    df = spark.createDataFrame(list(zip(*data.values())), "a double, b double, c double")
    row = df.agg(*(adjusted_skewness(name(c)).alias(c) for c in data)).first()
    assert row.a == pytest.approx(pd.Series(data["a"]).skew()) and row.b == 0 and row.c is None
