import numpy as np
import pandas as pd
import pytest

from tablewright.operators import correlate as R
from tablewright.operators import profile as P
from tablewright.operators.roles import Roles, classify, coerce


def mixed(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        rows.append((i + 1, float(rng.normal(0.5, 0.2)), None if i < 5 else float(rng.normal(120, 15)), float(rng.exponential(2) ** 3), None if i in (10, 11, 12) else ["GEN", "SURG", "PSY"][i % 3], "text" if i == 0 else "phone" if i == 1 else "email", None))
    return spark.createDataFrame(rows, "PAT_ID long, Y1 double, systolic double, cost double, department string, reminder string, hollow string")


def test_missing_shares_in_order(spark):
    df = mixed(spark)
    rows = [(r.column_name, round(r.missing_fraction, 6)) for r in P.missing_fractions(coerce(df, classify(df))).collect()]
    assert rows[:3] == [("hollow", 1.0), ("systolic", round(5 / 60, 6)), ("department", 0.05)] and len(rows) == 7
    assert P.columns_with_missing(coerce(df, classify(df))).count() == 3


def test_dominant_label_and_ties(spark):
    df = mixed(spark)
    assert [(r.column_name, r.value, r.share) for r in P.dominant_categories(coerce(df, classify(df)), classify(df)).collect()] == [("reminder", "email", 58 / 60)]
    tied = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert P.dominant_categories(tied, Roles((), ("c",)), 0.5).first()[:] == ("c", "a", 0.5)


def test_profile_of_a_table_and_of_an_empty_one(spark):
    df = mixed(spark)
    made = P.profile(df, classify(df))
    assert (made.n_rows, made.n_columns) == (60, 7) and "cost" in made.to_text() and "email" in made.to_text()
    assert P.skewness(coerce(df, classify(df)), classify(df)).first().column_name == "cost"
    nothing = df.where("false")
    text = P.profile(nothing, classify(nothing)).to_text()
    assert "0 rows" in text and "Not enough numeric columns" in text and "None" in text


def wide(spark, n=250, gaps=0.2, ties=True, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    data = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(0, 0.2, n), "c": rng.integers(0, 6, n).astype(float) if ties else rng.normal(size=n), "d": rng.exponential(size=n) ** 3 * 1e6})
    data = data.mask(rng.random(data.shape) < gaps)
    rows = [tuple(None if v != v else float(v) for v in r) for r in data.itertuples(index=False)]
    return data, spark.createDataFrame(rows, "a double, b double, c double, d double")


def pairs(df):
    return {(r.feature_1, r.feature_2): r.correlation for r in df.collect()}


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_pairwise_complete(spark, method):
    data, df = wide(spark)
    want = data.corr(method)
    for (x, y), v in pairs(R.METHODS[method](df, list(data))).items():
        assert v == pytest.approx(want.loc[x, y], abs=1e-9)


def tau_b(x, y):
    s = tx = ty = 0
    n = len(x)
    for i in range(n):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, tx, ty = s + a * b, tx + (a == 0), ty + (b == 0)
    n0 = n * (n - 1) / 2
    return s / np.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("grid", [2, 5, 64])
def test_kendall(spark, grid):
    data, df = wide(spark, 120)
    for (x, y), v in pairs(R.kendall(df, list(data), grid)).items():
        both = data[[x, y]].dropna()
        assert v == pytest.approx(tau_b(both[x].to_numpy(), both[y].to_numpy()), abs=1e-9)


def test_constants_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 1.0, 5.0, None), (3.0, 4.0, 5.0, None)], "a double, b double, flat double, hollow double")
    made = R.correlations(df, Roles(("a", "b", "flat", "hollow"), ()))
    assert made.columns == ("a", "b") and len(pairs(made.pairs)) == 1
    with pytest.raises(ValueError):
        R.correlations(df, Roles(("a",), ()))
    with pytest.raises(ValueError):
        R.correlations(df, Roles(("a", "b"), ()), "cosine")


def test_no_variance_on_shared_rows_gives_no_pair(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0), (None, 4.0), (2.0, 5.0)], "a double, b double")
    assert pairs(R.pearson(df, ["a", "b"])) == {} and pairs(R.spearman(df, ["a", "b"])) == {} and pairs(R.kendall(df, ["a", "b"])) == {}


def test_monotone_curve(spark):
    df = spark.createDataFrame([(float(i), float(i) ** 4) for i in range(100)], "x double, y double")
    assert pairs(R.spearman(df, ["x", "y"]))["x", "y"] == pytest.approx(1) and pairs(R.kendall(df, ["x", "y"]))["x", "y"] == pytest.approx(1)
    assert pairs(R.pearson(df, ["x", "y"]))["x", "y"] < 0.99


def test_ranking_identifiers_and_outcomes(spark):
    _, df = wide(spark)
    roles = Roles(("a", "b", "c", "d"), (), ("c",), ("b",))
    made = R.correlations(df, roles)
    assert made.columns == ("a", "b", "d") and made.top(1).first()[:2] == ("a", "b")
    assert all(r.abs_correlation >= 0.9 for r in made.above(0.9).collect()) and made.matrix().count() == 9
    assert R.correlations(df, roles, exclude_identifiers=False).columns == ("a", "b", "c", "d")
    assert pairs(R.correlations(df.where("false"), roles).pairs) == {}
