import math
import random

import numpy as np
import pytest

from tablewright.llm import quantiles as Q


def rank_gap(values, found, per_mille):
    """How far the found value's ranks lie from the wanted rank."""
    values = np.sort(values)
    want = max(1, math.ceil(per_mille * len(values) / 1000))
    low, high = np.searchsorted(values, found, "left") + 1, np.searchsorted(values, found, "right")
    assert high >= low, "not a value of the data"
    return max(0, low - want, want - high)


@pytest.mark.parametrize("shape", ["sorted", "reversed", "random", "ties", "two values"])
@pytest.mark.parametrize("parts", [1, 7])
def test_error_stays_within_its_own_bound(shape, parts):
    rng = np.random.default_rng(5)
    values = {"sorted": np.arange(60_000.0), "reversed": np.arange(60_000.0)[::-1], "random": rng.normal(size=60_000), "ties": rng.integers(0, 9, 60_000).astype(float), "two values": rng.integers(0, 2, 60_000).astype(float)}[shape]
    total = Q.Summary(64, 5)
    for part in np.array_split(values, parts):
        one = Q.Summary(64, 5)
        for chunk in np.array_split(part, 11):
            one.add(chunk)
        total.merge(Q.Summary.from_row(*one.row(), 64, 5))
    marks = [0, 1, 50, 250, 500, 750, 950, 999, 1000]
    levels = math.ceil(math.log(60_000 / 64, 5))
    assert total.n == 60_000 and 0 < total.error <= 60_000 * levels / (2 * 64)
    for p, v in zip(marks, total.quantiles(marks)):
        assert rank_gap(values, v, p) <= total.error


def test_weights_are_kept():
    s = Q.Summary(16, 3)
    for i in range(1000):
        s.add(np.array([float(i % 37)]))
    assert sum(len(b) for b in s.loose) + sum(len(b) * 3**level for level, bs in s.full.items() for b in bs) == 1000
    assert all(len(b) == 16 for bs in s.full.values() for b in bs) and all(len(bs) < 3 for bs in s.full.values())


def test_exact_below_the_buffer_size():
    s = Q.Summary().add(np.array([3.0, 1.0, np.nan, 2.0]))
    assert (s.error, s.quantiles([0, 500, 1000]), Q.Summary().quantiles([500])) == (0, [1.0, 2.0, 3.0], [None])
    with pytest.raises(ValueError):
        Q.Summary(10, 4)


def test_groups_and_merges(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "a", "a", None]), rnd.randint(1, 4), rnd.choice([None, float("nan"), rnd.gauss(0, 1)]), rnd.randint(0, 50), "clash") for _ in range(6000)]
    df = spark.createDataFrame(data, "g string, day int, x double, y int, n string").repartition(9)
    days = Q.summarise(df, ["g", "day"], ["x", "y"], size=32, fan_in=3)
    assert days.columns == ["g", "day", "column_name", "n", "error", "low", "high", "levels", "buffers"]
    whole = Q.merge_summaries(days, ["g"], 32, 3, spread=4, arity=2)
    got = {(r.g, r.column_name): r for r in Q.percentiles(whole, ["g"], [250, 500, 900], 32, 3).collect()}
    assert len(got) == 4
    for g in ("a", None):
        for i, c in ((2, "x"), (3, "y")):
            values = [float(r[i]) for r in data if r[0] == g and r[i] is not None and r[i] == r[i]]
            r = got[g, c]
            assert r.n == len(values)
            for p, v in ((250, r.p250), (500, r.p500), (900, r.p900)):
                assert rank_gap(values, v, p) <= r.rank_error < 0.2 * r.n


def test_many_groups_leave_early(spark, monkeypatch):
    monkeypatch.setattr(Q, "GROUPS", 3)
    df = spark.range(500).selectExpr("id % 50 AS g", "id AS x").coalesce(2)
    got = Q.percentiles(Q.summarise(df, ["g"], ["x"]), ["g"], [500]).collect()
    assert sorted(r.g for r in got) == list(range(50)) and all(r.n == 10 and r.rank_error == 0 and r.p500 == r.g + 200 for r in got)


def test_empty_table_and_groups_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "g long, x double")
    assert [r.g for r in Q.summarise(df, ["g"], ["x"]).collect()] == [2]
    assert Q.summarise(df.where("false"), ["g"], ["x"]).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    """Every figure's true rank, counted over all rows here, is within the stated error, where buffers have collapsed too."""
    from tablewright.llm import queries as L

    rows = L.department_rows(spark, sf, "day").collect()
    days = Q.summarise(L.department_rows(spark, sf, "day"), ["department", "day"], L.P2_COLUMNS, size=8, fan_in=3)
    merged = Q.merge_summaries(days, ["department"], 8, 3, spread=4)
    got = Q.percentiles(merged, ["department"], L.PER_MILLE, 8, 3).collect()
    for r in got:
        values = [x[r.column_name] for x in rows if x.department == r.department and x[r.column_name] is not None and x[r.column_name] == x[r.column_name]]
        assert r.n == len(values) and all(rank_gap(values, r[f"p{p:03d}"], p) <= r.rank_error for p in L.PER_MILLE)
    assert sum(r.rank_error > 0 for r in got) > len(got) / 2


def test_percentiles_of_departments_are_within_their_bounds(spark, sf, monkeypatch):
    from tablewright.llm import queries as L

    monkeypatch.setattr(L, "CHECK_SIZES", (16, 1024))
    got = L.p2_departments(spark, sf).collect()
    assert all(r.within for r in got) and any(r.collapsed for r in got) and {r["size"] for r in got} == set(L.CHECK_SIZES)
