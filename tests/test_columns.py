import math
import random

import numpy as np
import pytest

from tablewright.operators import columns as C

SCHEMA = "load_id long, x double, y string, cnt string"


def rows(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x = rnd.choice([None, float("nan"), rnd.gauss(50, 20), float(rnd.randint(0, 5)), -0.0, 0.0])
        out.append((rnd.randint(1, 6), x, rnd.choice(["a", "b", "b", "c", " ", "N/A", " none", None, "d"]), "other"))
    return out


def test_profile_from_counts_equals_the_rows(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    counts = C.delta(df, "load_id", ["x", "y"])
    got = {(r.load_id, r.c): r for r in C.profile(counts, ["x", "y"], [C.ColumnSpec("x", 0, 80), C.ColumnSpec("y", allowed=("a", "b"))]).collect()}
    for load in range(1, 7):
        xs = [r[1] for r in data if r[0] == load]
        seen = [x for x in xs if x is not None and x == x]
        p = got[load, 0]
        assert (p.row_count, p.missing, p.distinct_values) == (len(xs), len(xs) - len(seen), len(set(seen)))
        assert (p.min_number, p.max_number, p.broken) == (min(seen), max(seen), sum(not 0 <= x <= 80 for x in seen))
        share = np.unique(np.array(seen) + 0.0, return_counts=True)[1] / len(seen)
        assert p.entropy == pytest.approx(-(share * np.log(share)).sum())
        assert [p[q] for q in ("q1", "median", "q3")] == pytest.approx(np.quantile(seen, [0.25, 0.5, 0.75]))
        ys = [r[2] for r in data if r[0] == load and r[2] in ("a", "b", "c", "d")]
        assert got[load, 1].missing == len(xs) - len(ys) and got[load, 1].broken == sum(y not in ("a", "b") for y in ys)


def test_signed_deltas_undo_a_load(spark, tmp_path):
    a, b = spark.createDataFrame(rows(1), SCHEMA), spark.createDataFrame(rows(2), SCHEMA)
    store = C.CountStore(spark, str(tmp_path / "counts"), ["x", "y"])
    store.commit(C.delta(a, "load_id", ["x", "y"]))
    before = kept(store)
    store.commit(C.delta(b, "load_id", ["x", "y"]))
    assert kept(store) != before
    again = C.CountStore(spark, str(tmp_path / "counts"), ["x", "y"])
    again.commit(C.delta(b, "load_id", ["x", "y"], sign=-1))
    assert again.version() == 3 and kept(again) == before
    again.commit(C.delta(b, "load_id", ["x", "y"]), version=3)
    assert kept(again) == before


def kept(store):
    return sorted(map(repr, C.merged(store.counts()).collect()))


def test_segments_are_merged_and_removed(spark, tmp_path, monkeypatch):
    """One commit per load appends; a load that is corrected leaves and comes back; the state is that of all rows."""
    monkeypatch.setattr(C, "SEGMENTS", 3)
    monkeypatch.setattr(C, "SLICE_ROWS", 40)
    store = C.CountStore(spark, str(tmp_path / "counts"), ["x", "y"])
    data = [(k % 8, *r[1:]) for k, r in enumerate(rows(3))]
    parts = [spark.createDataFrame([r for r in data if r[0] == k], SCHEMA) for k in range(8)]
    for d in parts:
        store.commit(C.delta(d, "load_id", ["x", "y"]))
    wrong = spark.createDataFrame([(5, 1e6, "q", "")] * 7, SCHEMA)
    store.commit(C.delta(wrong, "load_id", ["x", "y"]))
    store.commit(C.delta(wrong, "load_id", ["x", "y"], sign=-1))
    assert store.version() == 10 and len(store._live()) < 6 and len(store._segments()) < 11
    want = C.CountStore(spark, str(tmp_path / "whole"), ["x", "y"])
    want.commit(C.delta(spark.createDataFrame(data, SCHEMA), "load_id", ["x", "y"]))
    assert shown(C.profile(store.counts(), ["x", "y"])) == shown(C.profile(want.counts(), ["x", "y"]))
    for d in parts:
        store.commit(C.delta(d, "load_id", ["x", "y"], sign=-1))
    assert C.merged(store.counts()).count() == 0 and C.profile(store.counts(), ["x", "y"]).count() == 0


def findings(spark, data, loads, specs):
    names = [s.column for s in specs]
    counts = C.temporary_store(spark, names).commit(C.delta(spark.createDataFrame(data, SCHEMA), "load_id", names))
    return sorted((r.load_id, r.column_name, r.finding) for r in C.load_findings(counts, names, specs, spark.createDataFrame(loads, "load_id long, feed_id string, seq_no int")).collect())


def test_findings(spark):
    specs = [C.ColumnSpec("x", 0, 100), C.ColumnSpec("y", allowed=("a", "b"))]
    calm = [(1, float(i), "a" if i % 2 else "b", "") for i in range(40)]
    moved = [(2, float(i + 30), "a", "") for i in range(40)]
    hollow = [(3, None, None, "")] * 40
    wild = [(4, 500.0, "z", "")] * 40
    loads = [(1, "F", 1), (2, "F", 2), (3, "F", 3), (4, "F", 4), (4, "F", 4)]
    got = findings(spark, calm + moved + hollow + wild, loads, specs)
    assert got == [
        (2, "x", "distribution"), (2, "y", "distribution"), (3, "x", "null_rate"), (3, "y", "null_rate"), (4, "x", "null_rate"), (4, "x", "pattern"), (4, "y", "null_rate"), (4, "y", "pattern"),
    ]


def test_first_loads_gaps_in_sequence_and_null_loads_have_patterns_only(spark):
    data = [(1, 500.0, "a", "")] * 5 + [(3, None, "a", "")] * 5 + [(None, 500.0, "a", "")] * 5 + [(9, 500.0, "a", "")] * 2
    assert findings(spark, data, [(1, "F", 1), (3, "F", 3)], [C.ColumnSpec("x", 0, 100)]) == [(1, "x", "pattern"), (9, "x", "pattern")]


def test_limits_are_strict(spark):
    data = [(1, 200.0 if i < 3 else 1.0, "a", "") for i in range(100)]
    assert findings(spark, data, [(1, "F", 1)], [C.ColumnSpec("x", 0, 100)]) == []
    assert findings(spark, [*data, (1, 200.0, "a", "")], [(1, "F", 1)], [C.ColumnSpec("x", 0, 100)]) == [(1, "x", "pattern")]


def test_empty_table(spark):
    assert findings(spark, [], [], [C.ColumnSpec("x", 0, 1)]) == []
    assert C.profile(C.delta(spark.createDataFrame([], SCHEMA), "load_id", ["x", "y"]), ["x", "y"]).count() == 0


def test_very_long_labels_and_unicode_blanks(spark):
    long = "z" * 200_000
    df = spark.createDataFrame([(1, 1.0, long, ""), (1, 1.0, long, ""), (1, 1.0, "  N/a  ", ""), (1, 1.0, "　", "")], SCHEMA)
    r = C.profile(C.delta(df, "load_id", ["y"]), ["y"]).first()
    assert (r.missing, r.distinct_values, len(r.max_label), math.isclose(r.entropy, 0)) == (2, 1, 200_000, True)


def shown(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_hot_loads_get_the_same_profile(spark, monkeypatch):
    df = spark.createDataFrame([*rows(4), (None, 1.0, "a", "")], SCHEMA)
    want = shown(C.profile_loads(df, "load_id", ["x", "y"]))
    monkeypatch.setattr(C, "SLICE_ROWS", 20)
    monkeypatch.setattr(C, "CHUNK", 7)
    got = shown(C.profile_loads(df, "load_id", ["x", "y"]))
    assert got == want and len(got) == 14


def test_changes_of_columns_without_rules(spark):
    """Every kind of column is compared with the load before: numbers, labels, times and numbers kept as text."""
    from datetime import datetime, timedelta

    start, cells = datetime(2024, 1, 1), []
    for load in (1, 2, 3, None):
        for i in range(40):
            wrong = load == 2
            cells.append((load, float(i + 30 * wrong), None if wrong and i < 10 else i, "a" if wrong or i % 2 else "b", start + timedelta(hours=i + 900 * wrong), str(36 + i / 10) if not wrong or i < 25 else "warm", "k", i % 7))
    df = spark.createDataFrame(cells, "load_id long, x double, gap int, y string, at timestamp_ntz, txt string, same string, n int")
    names = [c for c in df.columns if c != "load_id"]
    loads = spark.createDataFrame([(1, "F", 1), (2, "F", 2), (3, "F", 3)], "load_id long, feed_id string, seq_no int")
    got = sorted((r.load_id, r.column_name, r.finding) for r in C.change_findings(df, "load_id", names, [], loads, ("at", "txt")).collect())
    both = [("at", "distribution"), ("gap", "null_rate"), ("txt", "distribution"), ("x", "distribution"), ("y", "distribution")]
    assert got == [(load, c, f) for load in (2, 3) for c, f in both]


def test_changes_hold_the_findings_of_the_columns_with_rules(spark, sf):
    from tablewright.plans.data_queries import QUERIES, column_specs

    ruled = [s.column for s in column_specs(spark, sf)]
    every = [tuple(r) for r in QUERIES["p3_changes"](spark, sf).collect()]
    assert sorted(r for r in every if r[1] in ruled) == sorted(tuple(r) for r in QUERIES["p3_found"](spark, sf).collect())


def test_a_hot_null_load_has_its_quartiles(spark, monkeypatch):
    df = spark.createDataFrame([*rows(4), *((None, float(i % 50), "a", "") for i in range(100))], SCHEMA)
    want = shown(C.profile_loads(df, "load_id", ["x", "y"]))
    monkeypatch.setattr(C, "SLICE_ROWS", 20)
    monkeypatch.setattr(C, "CHUNK", 7)
    made = C.profile_loads(df, "load_id", ["x", "y"])
    null = made.where("load_id IS NULL AND c = 0").first()
    assert shown(made) == want and (null.row_count, null.q1, null.median, null.q3) == (100, 12.0, 24.5, 37.0)
