import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.config import ImputationConfig
from tablewright.operators import explore as X
from tablewright.operators import impute as I
from tablewright.operators import validate as V
from tablewright.operators.roles import Roles, classify


def gappy(n=70, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 100, 1e4, 3]
    x[:, 3] = np.round(x[:, 3])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5] = np.nan
    x[7] = x[8]
    x[7, 0] = np.nan
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, *(None if v != v else float(v) for v in r)) for i, r in enumerate(x)], "k long, a double, b double, c double, d double")


def brute(x, k, weights):
    med = np.nanmedian(x, 0)
    full = np.where(np.isnan(x), med, x)
    z = (x - full.mean(0)) / full.std(0)
    out = x.copy()
    for i in range(len(x)):
        for c in range(x.shape[1]):
            if not np.isnan(x[i, c]):
                continue
            best = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, c]) and both.any():
                    best.append((round(float(np.sqrt(((z[i, both] - z[j, both]) ** 2).sum() * x.shape[1] / both.sum())), 9), j))
            best = sorted(best)[:k]
            if not best:
                out[i, c] = np.nanmean(x[:, c])
                continue
            d, v = np.array([b[0] for b in best]), np.array([x[b[1], c] for b in best])
            w = np.ones(len(d)) if weights == "uniform" else (d == 0).astype(float) if (d == 0).any() else 1 / d
            out[i, c] = (w * v).sum() / w.sum()
    return out


ROLES = Roles(("a", "b", "c", "d"), ())


@pytest.mark.parametrize("weights", ["distance", "uniform"])
@pytest.mark.parametrize("block", [(4096, 1024), (9, 16)])
def test_neighbours_match_brute_force(spark, monkeypatch, weights, block):
    monkeypatch.setattr(I, "SLICE", block[0])
    monkeypatch.setattr(I, "BLOCK", block[1])
    x = gappy()
    got = I.impute(frame(spark, x).repartition(3), "k", ImputationConfig(4, weights), ROLES).frame.orderBy("k").collect()
    want = brute(x, 4, weights)
    for i, r in enumerate(got):
        assert [r.a, r.b, r.c] == pytest.approx(want[i, :3].tolist())
        assert r.d == round(want[i, 3])


def test_nearest_neighbour_ignores_units(spark):
    df = spark.createDataFrame([(0, 20000.0, 1.0), (1, 20100.0, None), (2, 40000.0, 5.0), (3, 60000.0, 7.5), (4, 80000.0, 9.0)], "k long, cost double, score double")
    out = I.impute(df, "k", ImputationConfig(1), Roles(("cost", "score"), ())).frame
    assert out.where("k = 1").first().score == 1.0


def test_labels_placeholders_and_report(spark):
    df = spark.createDataFrame([(1, "b", None, None), (2, "a", " ", None), (3, "a", "x", None), (4, "b", "NA", None), (5, None, "x", None)], "k long, l string, m string, hollow string")
    made = I.impute(df, "k", ImputationConfig(categorical_placeholder="?"), Roles(("k",), ("l", "m", "hollow")))
    assert [r[1:] for r in made.frame.orderBy("k").collect()] == [("b", "x", "?"), ("a", "x", "?"), ("a", "x", "?"), ("b", "x", "?"), ("a", "x", "?")]
    assert sorted((r.column_name, r.strategy, r.filled) for r in made.report.collect()) == [("hollow", "placeholder", 5), ("l", "mode", 1), ("m", "mode", 2), ("m", "mode-fallback", 1)]
    assert made.total_filled() == 9 and "hollow" in made.summary()


def test_skip_originals_order_and_observed_values(spark):
    x = gappy()
    df = frame(spark, x).withColumn("note", F.lit("NA"))
    config = ImputationConfig(3, skip_columns=("note", "b"), keep_original_columns=True)
    out = I.impute(df, "k", config, Roles(("k", "a", "b", "c", "d"), ("note",))).frame
    assert out.columns == [*df.columns, "k_orig", "a_orig", "c_orig", "d_orig"] and out.count() == df.count()
    for r in out.collect():
        assert r.note == "NA" and (r.b is None) == bool(np.isnan(x[r.k, 1]))
        assert np.isnan(x[r.k, 0]) or r.a == x[r.k, 0]
        assert r.a is not None and r.c is not None and r.d == int(r.d)


def test_neighbours_are_capped_and_fit_can_be_reused(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 5.5, 2.0), (3, 7.5, 3.0)], "k long, a double, b double")
    fitted = I.Imputer.fit(df, "k", ImputationConfig(50), Roles(("a", "b"), ()))
    assert fitted.transform(df).frame.where("k = 1").first().a == pytest.approx(6.1667, abs=1e-3)
    other = fitted.transform(spark.createDataFrame([(9, None, None)], "k long, a double, b double")).frame.first()
    assert (other.a, other.b) == (6.5, 2.0)
    assert fitted.transform(df.where("false")).frame.count() == 0


def test_explicit_empty_numeric_column_falls_back_to_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, a double")
    made = I.impute(df, "k", ImputationConfig(), Roles(("a",), ()))
    assert [r.a for r in made.frame.collect()] == [0.0, 0.0] and made.report.first().strategy == "median-fallback"


# validation


def names(issues):
    return sorted((r.check_name, r.column_name) for r in issues.collect())


def test_checks_alone(spark):
    df = spark.createDataFrame([(1, 1.0, "x", "MISSING", " "), (2, None, "x", "MISSING", "a"), (3, float("nan"), "x", "b", "b")], "k int, gap double, same string, full string, blank string")
    assert names(V.validate(df).issues) == [("completeness", "blank"), ("completeness", "gap"), ("constant", "gap"), ("constant", "same"), ("placeholder", "full")]
    made = V.validate(df, skipped=("gap", "blank"))
    assert not made.passed and made.checks_run == 3 and "same" in made.to_text()
    fine = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    assert V.validate(fine, fine).passed and V.validate(fine, fine).to_text() == "PASSED: 6 checks"
    assert names(V.placeholder_saturation(fine.withColumn("l", F.lit("?")), "?")) == [("placeholder", "l")]


@pytest.mark.parametrize("key", ["k", None])
def test_checks_against_the_original(spark, key):
    was = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, l string, v double")
    now = was.where("k < 3").withColumn("l", F.when(F.col("k") == 2, "z").otherwise(F.col("l"))).drop("v")
    assert names(V.row_count(now, was)) == [("row_count", None)] and names(V.columns_kept(now, was)) == [("columns", None)]
    assert names(V.skipped_unchanged(now, was, ("l", "v"), key)) == [("skipped", "l")]
    assert names(V.skipped_unchanged(was, was, ("l", "v"), key)) == []
    assert names(V.skipped_unchanged(was.withColumn("v", F.col("v").cast("string")), was, ("v",), key)) == [("skipped", "v")]


# exploration


def numbers(spark, n=300):
    rng = np.random.default_rng(4)
    a = rng.normal(size=n)
    rows = [(i, float(a[i]), float(a[i] * 10 + rng.normal()), float(rng.normal()), None if i % 7 == 0 else float(rng.exponential()), ["u", "v", "w"][i % 3], 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, d double, l string, flat double")


def test_histogram_counts_every_present_value(spark):
    df = numbers(spark)
    roles = Roles(("a", "b", "c", "d", "flat"), ("l",), ("k",))
    bins = X.histograms(X.numeric_frame(df, roles), ["a", "d"]).toPandas()
    assert bins[bins.column_name == "d"].n.sum() == df.where("d IS NOT NULL").count()
    values = np.array([r.a for r in df.collect()])
    want, edges = np.histogram(values, "auto")
    got = bins[bins.column_name == "a"].set_index("bin")
    assert [int(got.n.get(i, 0)) for i in range(len(want))] == want.tolist()
    assert got.low.min() == pytest.approx(edges[0])


def test_pca_against_numpy(spark):
    df = numbers(spark)
    f = X.numeric_frame(df, Roles(("a", "b", "c", "d", "flat"), ("l",), ("k",)), "k")
    assert f.columns == ["a", "b", "c", "d"]
    marks, share, loadings = X.pca(f)
    x = np.array([[r[c] for c in "abcd"] for r in df.orderBy("k").collect()], float)
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert share == pytest.approx((s**2 / (s**2).sum())[:2]) and np.abs(loadings) == pytest.approx(np.abs(vt[:2].T))
    got = np.array([[r.pc1, r.pc2] for r in marks.orderBy("_key").collect()])
    assert np.abs(got) == pytest.approx(np.abs(z @ vt[:2].T), abs=1e-6)
    with pytest.raises(ValueError):
        X.pca(X.numeric_frame(df.select("k", "a", "b"), Roles(("a", "b"), ()), "k"))


def test_leaf_order_keeps_like_columns_together():
    m = np.array([[1, 0.9, 0, 0.1], [0.9, 1, 0.1, 0], [0, 0.1, 1, 0.95], [0.1, 0, 0.95, 1]])
    assert sorted(map(sorted, (X.leaf_order(m)[:2], X.leaf_order(m)[2:]))) == [[0, 1], [2, 3]]


def test_sample_hue_and_failed_stages(spark):
    df = numbers(spark)
    roles = Roles(("a", "b", "c", "d", "flat"), ("l",), ("k",))
    one = {r.k for r in X.seeded_sample(df, "k", 40, 42).collect()}
    assert len(one) == 40 and one == {r.k for r in X.seeded_sample(df.repartition(7), "k", 40, 42).collect()} and X.seeded_sample(df, "k", 999, 42).count() == 300
    assert X.hue_column(df, roles) == "l" and X.hue_column(df, roles, 2) is None
    made = X.explore(df, roles, "k", with_tsne=False)
    assert len(made.figures) == 5 and list(made.skipped) == ["tsne_projection"]
    poor = X.explore(df.select("k", "l"), Roles((), ("l",), ("k",)), "k")
    assert set(poor.figures) == {"missing_values_heatmap", "numeric_distributions"} and len(poor.skipped) == 4


def test_tsne_keeps_clusters_apart():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(40, 5)), rng.normal(size=(40, 5)) + 30])
    y = X._embed(x, 10, 250, 42)
    a, b = y[:40], y[40:]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())


def test_classified_frame_repairs_to_a_valid_one(spark):
    df = frame(spark, gappy()).withColumn("l", F.when(F.col("k") % 5 > 0, F.when(F.col("k") % 2 == 0, "even").otherwise("odd")))
    made = I.impute(df, "k", ImputationConfig(3), classify(df))
    assert V.validate(made.frame, df).passed


@pytest.mark.parametrize("kind", ["string", "decimal(30,2)"])
def test_keys_of_any_type(spark, kind):
    x = gappy()
    df = frame(spark, x).withColumn("id", F.concat(F.lit("1"), F.lpad(F.col("k").cast("string"), 24, "0")).cast(kind)).drop("k")
    want = brute(x, 4, "distance")
    got = I.impute(df.repartition(3), "id", ImputationConfig(4), ROLES).frame.orderBy("id").collect()
    for i, r in enumerate(got):
        assert [r.a, r.b] == pytest.approx(want[i, :2].tolist())


def test_rows_without_a_key_get_the_mean(spark):
    df = spark.createDataFrame([(None, None, 1.0), (1, 4.0, 1.0), (2, 6.0, 2.0)], "k long, a double, b double")
    made = I.impute(df, "k", ImputationConfig(1), Roles(("a", "b"), ()))
    assert made.frame.where("k IS NULL").first().a == 5.0 and made.frame.count() == 3


def test_capped_neighbours_are_reported(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 4.0, 1.0), (3, 6.0, 2.0)], "k long, a double, b double")
    assert [tuple(r) for r in I.impute(df, "k", ImputationConfig(20), Roles(("a", "b"), ())).report.collect()] == [("a", "knn(k=2)", 1)]


def test_other_ways_of_filling(spark):
    class Zeros(I.Filler):
        @classmethod
        def fit(cls, df, key, config=None, roles=None):
            return cls()

        def transform(self, df):
            return I.Imputed(df.fillna(0.0), df.sparkSession.createDataFrame([], "column_name string, strategy string, filled long"))

    class Loser(Zeros):
        def transform(self, df):
            return I.Imputed(df.drop("a"), None)

    df = frame(spark, gappy())
    made = I.impute(df, "k", way=Zeros)
    assert made.same_rows(df) and made.frame.where("a IS NULL").count() == 0
    with pytest.raises(ValueError, match="lost or moved"):
        I.impute(df, "k", way=Loser)


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_donors_are_not_copied_for_each_slice(spark, monkeypatch):
    monkeypatch.setattr(I, "SLICE", 9)
    monkeypatch.setattr(I, "BLOCK", 16)
    x = gappy(300)
    view = I.numeric_view(frame(spark, x), "k", list("abcd")).localCheckpoint()
    stats = I.scaler_stats(view, list("abcd"))
    before = shuffled(spark)
    assert I.neighbour_fills(view, list("abcd"), stats, 4, "distance").count() == np.isnan(x[~np.isnan(x).all(1)]).sum()
    # each row once to its cell, and the rows with gaps to their slices, in pieces
    assert shuffled(spark) - before < 3 * len(x)


@pytest.mark.parametrize("weights", ["distance", "uniform"])
def test_rows_of_one_key_share_their_donors(spark, monkeypatch, weights):
    monkeypatch.setattr(I, "BLOCK", 16)
    x = gappy(60, 3)
    # two rows of key 1 lack a; each has near donors of its own
    x[1], x[0] = [np.nan, 0.5, 20.0, 1.0], [np.nan, 150.0, -3e3, 2.0]
    keys = [1, 1, *range(2, 60)]
    df = spark.createDataFrame([(k, *(None if v != v else float(v) for v in r)) for k, r in zip(keys, x)], "k long, a double, b double, c double, d double")
    med = np.nanmedian(x, 0)
    full = np.where(np.isnan(x), med, x)
    z = (x - full.mean(0)) / full.std(0)
    near = []
    for i in (0, 1):
        for j in range(2, 60):
            both = ~np.isnan(z[i]) & ~np.isnan(z[j])
            if both.any() and not np.isnan(x[j, 0]):
                near.append((np.sqrt(((z[i, both] - z[j, both]) ** 2).sum() * 4 / both.sum()), j))
    d, j = np.array(sorted(near)[:4]).T
    w = np.ones(4) if weights == "uniform" else 1 / d
    want = (w * x[j.astype(int), 0]).sum() / w.sum()
    got = I.impute(df, "k", ImputationConfig(4, weights), ROLES).frame.where("k = 1").collect()
    assert [r.a for r in got] == pytest.approx([want, want])


def flagged(n, seed=1):
    """Twelve flags, four columns without gaps that one number drives, and one that most rows lack."""
    rng = np.random.default_rng(seed)
    x = np.hstack([rng.random((n, 12)) < 0.5, rng.normal(size=(n, 1)) + rng.normal(size=(n, 4)) / 5, rng.normal(size=(n, 1))]).astype(float)
    x[:, :12][rng.random((n, 12)) < 0.03] = np.nan
    x[rng.random(n) < 0.7, 16] = np.nan
    return x


def test_flags_and_driven_columns_match_brute_force(spark, monkeypatch):
    for at, size in (("SLICE", 40), ("BLOCK", 16), ("LEAF", 12)):
        monkeypatch.setattr(I, at, size)
    x, names = flagged(260), [f"c{i}" for i in range(17)]
    df = spark.createDataFrame([(i, *(None if v != v else float(v) for v in r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in names))
    view = I.numeric_view(df, "k", names).localCheckpoint()
    got = I.neighbour_fills(view, names, I.scaler_stats(view, names), 4, "distance").collect()
    want = brute(x, 4, "distance")
    assert len(got) == np.isnan(x).sum()
    assert [r.value for r in got] == pytest.approx([want[r._key, r.pos] for r in got])


def test_few_pairs_are_compared():
    x = flagged(12_000)
    full = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    scale = I.Scale(full.mean(0), full.std(0), np.ones(17, bool))
    cells = I.Cells.of(x, scale, len(x), 1)
    c = cells.place(x, scale)
    order = np.argsort(c, kind="stable")
    block = I._Block(c[order], order, x[order].T.copy(), scale, cells, I.BLOCK)
    held = I._Receivers(block, scale, cells, 20)
    held.offer(block)
    assert held.compared < 0.5 * len(held.keys) * len(x)
