import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.config import ImportanceConfig
from tablewright.operators import supervise as M
from tablewright.operators.roles import Roles


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"y {kind}")


@pytest.mark.parametrize(
    ("values", "kind", "most", "task"),
    [
        ([float(i % 10) for i in range(50)], "double", 10, "classification"), ([float(i % 10) for i in range(50)], "double", 9, "regression"), ([0.5, 1.5, 2.0] * 9, "double", 10, "regression"),
        (["a", "b"] * 9, "string", 10, "classification"), ([None, None], "double", 10, "classification"), (["1"] * 9 + ["x"], "string", 10, "classification"), (["1"] * 10 + ["x"], "string", 10, "classification"),
        (["1.5"] * 19 + ["x"], "string", 10, "regression"), ([float(i) for i in range(500)], "double", 10, "regression"), ([1.0, 2.0, float("nan")], "double", 10, "classification"), ([], "double", 10, "classification"),
    ],
)
def test_task(spark, values, kind, most, task):
    assert M.infer_task(column(spark, values, kind), "y", most) == task


def test_codes_follow_the_order_of_values(spark):
    df = spark.createDataFrame([(1, "red", 5.0), (2, None, 6.0), (3, "blue", 7.0), (4, "red", 8.0), (5, "NA", 1.0)], "k int, colour string, n double")
    out = M.ordinal_encode(df, ["colour"])
    assert out.columns == df.columns and [r.colour for r in out.orderBy("k").collect()] == [1.0, None, 0.0, 1.0, None]
    assert [r[:] for r in M.codes(df.select("n"), "n").orderBy("code").limit(2).collect()] == [(1.0, 0), (5.0, 1)]


@pytest.mark.parametrize("strata", ["g", None])
def test_split_sizes_are_exact(spark, strata):
    df = spark.range(1003).select("id", (F.col("id") % 7 == 0).cast("int").alias("g"))
    out = M.held_out(df, "id", 0.2, 42, strata)
    sizes = {r.g: (r.t, r.n) for r in out.groupBy("g").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect()}
    if strata:
        assert all(t == math.ceil(0.2 * n) for t, n in sizes.values())
    assert sum(n for _, n in sizes.values()) == 1003 and abs(sum(t for t, _ in sizes.values()) - math.ceil(0.2 * 1003)) <= (1 if strata else 0)
    again = M.held_out(df.repartition(5), "id", 0.2, 42, strata)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_single_rows_in_a_class_and_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, g string")
    assert M.held_out(df, "id", 0.5, 1, "g").where("is_test").count() == 2
    assert M.held_out(df.where("false"), "id", 0.5, 1, "g").count() == 0


def metrics(df):
    return {r.metric: r.value for r in df.collect()}


def test_metrics_against_their_definitions(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 15, 300).astype(float)
    p = (s + y * 3 > 8).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(y, p, s)], "y int, p int, s double")
    got = metrics(M.classification_metrics(df, "y", "p", "s"))
    f1 = [2 * ((y == c) & (p == c)).sum() / ((y == c).sum() + (p == c).sum()) for c in (0, 1)]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert got == pytest.approx({"accuracy": (y == p).mean(), "macro_f1": np.mean(f1), "roc_auc": auc})
    three = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2), (2, 2, 0.3)], "y int, p int, s double")
    assert metrics(M.classification_metrics(three, "y", "p", "s")) == pytest.approx({"accuracy": 2 / 3, "macro_f1": (2 / 3 + 0 + 1) / 3})
    assert M.auc(three.where("y = 1"), "y", "s").first().auc is None
    r = metrics(M.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double"), "y", "p"))
    assert r == pytest.approx({"rmse": math.sqrt(2 / 3), "mae": 2 / 3, "r2": 1 - 2 / 8})
    assert metrics(M.regression_metrics(spark.createDataFrame([(1.0, 2.0)], "y double, p double"), "y", "p"))["r2"] is None


def learnable(spark, n=400):
    rng = np.random.default_rng(7)
    s, noise = rng.normal(size=n), rng.normal(size=n)
    rows = [(i, float(s[i]), None if i % 9 == 0 else float(noise[i]), "abc"[i % 3], 7 if s[i] > 0 else 3, float(3 * s[i] + rng.normal(0, 0.1)) if i >= 50 else None) for i in range(n)]
    return spark.createDataFrame(rows, "PAT_ID long, signal double, noise double, kind string, Y1 int, Y2 double")


ROLES = Roles(("PAT_ID", "signal", "noise", "Y1", "Y2"), ("kind",), ("PAT_ID",), ("Y1", "Y2"))


@pytest.mark.parametrize(("target", "task", "measure"), [("Y1", "classification", "accuracy"), ("Y2", "regression", "r2")])
def test_study_finds_the_planted_feature(spark, target, task, measure):
    study = M.importance_study(learnable(spark), "PAT_ID", ROLES, ImportanceConfig(target, rounds=6, depth=3, n_permutation_repeats=3, max_shap_rows=40))
    assert study.task == task and study.metrics[measure] > 0.9 and study.failures == {}
    assert study.features == ["signal", "noise", "kind"]
    for way in ("gain", "permutation", "shap"):
        assert study.top(1, way).first().feature == "signal"
    assert "signal" in study.to_text()
    if target == "Y1":
        assert study.classes == [3, 7] and "roc_auc" in study.metrics


def test_unknown_and_empty_targets(spark):
    df = learnable(spark, 20)
    with pytest.raises(ValueError, match="Y1"):
        M.importance_study(df, "PAT_ID", ROLES, ImportanceConfig("nothing"))
    with pytest.raises(ValueError):
        M.importance_study(df.withColumn("Y2", F.lit(None).cast("double")), "PAT_ID", ROLES, ImportanceConfig("Y2"))


def test_tree_explanations_add_up():
    """Shapley values by definition: over all orders of the features, with conditional expectations along the tree."""
    from itertools import permutations

    tree = (0, 0.5, (1, 0.0, (1.0, 10.0), (5.0, 30.0), 40.0), (2, 1.0, (0, 2.0, (2.0, 20.0), (8.0, 15.0), 35.0), (-4.0, 25.0), 60.0), 100.0)

    def value(node, x, known):
        if len(node) == 2:
            return node[0]
        f, t, left, right, cover = node
        if f in known:
            return value(left if x[f] <= t else right, x, known)
        return (left[-1] * value(left, x, known) + right[-1] * value(right, x, known)) / cover

    for x in ([0.2, -1.0, 0.5], [1.0, 1.0, 0.5], [3.0, 0.0, 0.5], [0.7, 0.0, 2.0]):
        want = np.zeros(3)
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += (value(tree, x, set(order[: i + 1])) - value(tree, x, set(order[:i]))) / 6
        got = np.zeros(3)
        M._tree_shap(tree, np.array(x), got, 1.0)
        assert got == pytest.approx(want)


def test_registered_queries_use_the_whole_settings(spark, sf, monkeypatch):
    """Repeats, explained rows, rounds and depth are the operator's own, in every query that fits a model."""
    from tablewright.plans import model_queries as Q

    seen = []

    class Seen(Exception):
        pass

    def study(df, key, roles, config):
        seen.append(config)
        raise Seen

    monkeypatch.setattr(Q.M, "importance_study", study)
    for q in (Q.importance_rankings, Q.importance_gain, Q.importance_permutation, Q.model_evaluation, Q.importance_classes):
        with pytest.raises(Seen):
            q(spark, sf)
    assert seen == [ImportanceConfig(t) for t in ("Y4", "Y1", "Y3", "Y4", "Y5")]
    assert (seen[0].n_permutation_repeats, seen[0].max_shap_rows) == (10, 2000)


def test_other_ways_of_ranking_and_permutation_over_all_rows(spark):
    rows = [(i, float(i % 17), float((i * 7) % 13), int(i % 17 > 8)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, signal double, noise double, y int")
    from tablewright.config import ImportanceConfig
    from tablewright.operators import supervise as M
    from tablewright.operators.roles import Roles

    ways = {"permutation": M.RANKINGS["permutation"], "length": lambda model, test, names, task, c: {n: float(len(n)) for n in names}, "broken": lambda *a: 1 / 0}
    made = M.importance_study(df, "k", Roles(("k", "signal", "noise", "y"), (), ("k",), ("y",)), ImportanceConfig("y", n_permutation_repeats=3, rounds=4), ways)
    got = {r.feature: r for r in made.rankings.collect()}
    assert got["signal"].length == 6.0 and got["signal"].permutation > 0.2 and abs(got["noise"].permutation) < 0.05
    assert list(made.failures) == ["broken"] and made.metrics["accuracy"] > 0.95


TREES = [
    (0.5, (0, 0.5, (1, 0.0, (1.0, 10.0), (5.0, 30.0), 40.0), (2, 1.0, (0, 2.0, (2.0, 20.0), (8.0, 15.0), 35.0), (-4.0, 25.0), 60.0), 100.0)),
    (2.0, (3, -1.0, (0.5, 60.0), (0, 1.25, (3.0, 20.0), (7.0, 20.0), 40.0), 100.0)), (1.0, (4.0, 100.0)),
]


def test_many_rows_are_explained_at_once():
    x = np.round(np.random.default_rng(3).normal(size=(50, 4)) * 2) / 2
    together = np.zeros(x.shape)
    for w, tree in TREES:
        M._tree_shap(tree, x, together, w)
    alone = np.zeros(x.shape)
    for row, phi in zip(x, alone):
        for w, tree in TREES:
            M._tree_shap(tree, row, phi, w)
    assert together == pytest.approx(alone) and np.abs(together).sum() > 1


def test_trees_say_the_same_of_codes():
    def value(node, x):
        return node[0] if len(node) == 2 else value(node[2] if x[node[0]] <= node[1] else node[3], x)

    x = np.round(np.random.default_rng(4).normal(size=(200, 4)) * 4) / 4
    x[:5, 0], x[5:9, 1] = M.SENTINEL, np.nan
    (trees,), cuts = M._on_codes([TREES])
    codes = [np.searchsorted(at, x[:, c]).astype(M._code_type(cuts)) for c, at in cuts.items()]
    assert list(cuts) == [0, 1, 2, 3] and cuts[0].tolist() == [0.5, 1.25, 2.0]
    for (_, plain), (_, coded) in zip(TREES, trees):
        assert np.broadcast_to(M._tree_values(coded, codes), 200).tolist() == [value(plain, r) for r in x]
