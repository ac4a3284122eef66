import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators.propagate import Edge, fill_missing, near

SCHEMA = "id long, p long, g string, x double, l string, source string"


def edges():
    return [Edge("patient", (F.col("p"),), 8.0), Edge("group", (F.col("g"),), 1.0)]


def run(spark, rows, **kw):
    out = fill_missing(spark.createDataFrame(rows, SCHEMA), "id", ["x"], ["l"], edges(), **kw)
    return {r.id: r for r in out.rows.collect()}, sorted((r.id, r.column_name, r.source) for r in out.fills.collect())


def test_observed_values_stay_and_fills_are_marked(spark):
    rows = [(1, 1, "a", 10.0, "u", "s"), (2, 1, "a", None, None, "s"), (3, 2, "a", float("nan"), " N/A ", "s"), (4, 2, "a", 50.0, "v", "s"), (5, 3, "b", None, None, "s"), (6, None, None, None, "", "s")]
    got, fills = run(spark, rows)
    assert fills == [(2, "l", "patient"), (2, "x", "patient"), (3, "l", "patient"), (3, "x", "patient"), (5, "l", "all"), (5, "x", "all"), (6, "l", "all"), (6, "x", "all")]
    assert (got[1].x, got[1].x_fill, got[4].l, got[4].l_fill) == (10.0, None, "v", None)
    assert got[2].x == pytest.approx(10, abs=4) and got[2].x < got[3].x and got[2].l == "u" and got[3].l == "v"
    assert got[6].l == "u" and got[6].x is not None


def test_one_round_is_the_weighted_mean_of_group_means(spark):
    rows = [(1, 1, "a", 10.0, "u", ""), (2, 1, "b", 20.0, "u", ""), (3, 2, "a", 60.0, "u", ""), (4, 1, "a", None, None, "")]
    got, _ = run(spark, rows, rounds=1)
    assert got[4].x == pytest.approx((8 * 15 + 1 * 35) / 9)


def test_values_reach_further_with_more_rounds(spark):
    """A patient without observed values passes on what its other rows got from their group."""
    rows = [(1, 1, "a", 10.0, "u", ""), (2, 2, "a", None, None, ""), (3, 2, None, None, None, "")]
    got, fills = run(spark, rows)
    assert got[3].x == pytest.approx(10.0) and (3, "x", "propagated") in fills and (2, "x", "group") in fills


def test_rounds_settle_on_a_chain(spark):
    """Values run along a chain of records that share a patient or a group in turn, until nothing changes."""
    rows = [(0, 0, "g0", 10.0, "u", "")] + [(i, (i + 1) // 2, f"g{i // 2}", None, None, "") for i in range(1, 8)]
    got, fills = run(spark, rows)
    assert all(got[i].x == pytest.approx(10.0) and got[i].l == "u" for i in range(8))
    assert {f[2] for f in fills} == {"group", "propagated"}


def test_similar_readings_are_an_edge(spark):
    rows = [(1, 81.0, 5.0), (2, 83.0, None), (3, 99.0, 50.0), (4, float("nan"), None), (5, 84.9, 7.0)]
    df = spark.createDataFrame(rows, "id long, r double, x double")
    out = fill_missing(df, "id", ["x"], [], [Edge("alike", (near("r", 5.0),), 1.0)])
    got = {r.id: (r.x, r.x_fill) for r in out.rows.collect()}
    assert got[2] == (6.0, "alike") and got[4][1] == "all" and got[4][0] == pytest.approx(62 / 3)


def test_found_rule_on_random_rows(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, *range(20)]), rnd.choice([None, "a", "b"]), rnd.choice([None, float("nan"), rnd.gauss(0, 1)]), rnd.choice([None, "", "u", "v", "null"]), "") for i in range(300)]
    _, fills = run(spark, rows)
    seen_x = {r[1] for r in rows if r[1] is not None and r[3] is not None and r[3] == r[3]}
    seen_l = {r[1] for r in rows if r[1] is not None and r[4] in ("u", "v")}
    want = [(r[0], "x") for r in rows if (r[3] is None or r[3] != r[3]) and r[1] in seen_x] + [(r[0], "l") for r in rows if r[4] not in ("u", "v") and r[1] in seen_l]
    assert sorted(f[:2] for f in fills if f[2] == "patient") == sorted(want)
    assert len(fills) == sum(r[3] is None or r[3] != r[3] for r in rows) + sum(r[4] not in ("u", "v") for r in rows)


def test_large_hub_tables_are_shuffled(spark, monkeypatch):
    import tablewright.plans.shared as shared

    rows = [(i, i % 5, "a", None if i % 3 else float(i), "u" if i % 2 else None, "") for i in range(60)]
    want = run(spark, rows)
    monkeypatch.setattr(shared, "MAX_BROADCAST_ROWS", 0)
    got = run(spark, rows)
    assert got[1] == want[1] and all(got[0][k].x == pytest.approx(want[0][k].x) and got[0][k].l == want[0][k].l for k in want[0])


def test_readings_out_of_bounds_stay_without_a_vote(spark):
    rows = [(i, 1, "a", 70.0 + i % 10, "u", "") for i in range(400)] + [(1000, 2, "a", 99999.0, "u", ""), (1001, 2, "a", None, "u", "")]
    got, fills = run(spark, rows, bounds={"x": (0.0, 300.0)})
    # the patient's only reading has no vote, so its hub takes what the group gives; it was observed all the same
    assert got[1001].x == pytest.approx(74.5) and got[1000].x == 99999.0 and fills == [(1001, "x", "patient")]


def test_nothing_observed_empty_and_repeated_rows(spark):
    got, fills = run(spark, [(1, 1, "a", None, None, ""), (1, 1, "a", None, None, "")])
    assert fills == [] and got[1].x is None
    assert run(spark, [])[1] == []
    out = fill_missing(spark.createDataFrame([(1, 1, "a", None, "u", ""), (1, 1, "a", None, "u", ""), (2, 1, "a", 5.0, "u", "")], SCHEMA), "id", ["x"], ["l"], edges())
    assert sorted((r.id, r.x) for r in out.rows.collect()) == [(1, 5.0), (1, 5.0), (2, 5.0)]
