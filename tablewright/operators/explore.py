"""Plot-ready summaries: every figure is a small table of marks."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.config import ExploreConfig
from tablewright.functions.parse import as_number, name
from tablewright.functions.stats import melt, unpivot_row, wide_row
from tablewright.operators.correlate import pearson
from tablewright.operators.impute import medians
from tablewright.operators.roles import Roles, coerce


def missing_map(coerced: DataFrame, key: str, bands: int = 50) -> DataFrame:
    """(band, column_name, n_rows, missing_fraction): the null mask, rows put into `bands` bands by the range of the key."""
    low, high = coerced.agg(F.min(name(key)), F.max(name(key))).first()
    if low is None:
        return coerced.sparkSession.createDataFrame([], "band int, column_name string, n_rows long, missing_fraction double")
    width = (high - low) // bands + 1
    band = F.floor((name(key) - F.lit(low)) / F.lit(width)).cast("int")
    columns = [c for c in coerced.columns if c != key]
    sums = coerced.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_rows"), *(F.avg(name(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_fraction")) for i, c in enumerate(columns)))
    return sums.select("band", "n_rows", F.explode(cells).alias("c")).select("band", "c.column_name", "n_rows", "c.missing_fraction")


def missing_cells(coerced: DataFrame, key: str) -> DataFrame:
    """(key, column_name) of every missing cell: the null mask itself, for those who want more than the bands of missing_map."""
    columns = [c for c in coerced.columns if c != key]
    lost = F.array_compact(F.array(*(F.when(name(c).isNull(), F.lit(c)) for c in columns)))
    return coerced.select(name(key).alias(key), F.explode(lost).alias("column_name"))


@dataclass(frozen=True)
class NumericFrame:
    """Numeric features as doubles, their medians, and those that vary after the median fill."""

    view: DataFrame
    columns: list[str]
    medians: dict[str, float]
    mean: dict[str, float]
    sd: dict[str, float]
    variance: dict[str, float]

    def filled(self, column: str) -> Column:
        return F.coalesce(name(column), F.lit(self.medians[column]))

    def scaled(self, column: str) -> Column:
        return (self.filled(column) - F.lit(self.mean[column])) / F.lit(self.sd[column])


def numeric_frame(df: DataFrame, roles: Roles, key: str | None = None) -> NumericFrame:
    columns = roles.pick("numeric")
    keep = [name(key).alias("_key")] if key else []
    view = df.select(*keep, *(as_number(name(c), df.schema[c].dataType).alias(c) for c in columns))
    med = medians(view, columns) if columns else {}
    columns = [c for c in columns if med[c] is not None]
    f = lambda c: F.coalesce(name(c), F.lit(med[c]))
    row = wide_row(view, {f"{k}{i}": a(f(c)) for i, c in enumerate(columns) for k, a in (("m", F.avg), ("s", F.stddev_pop), ("v", F.var_samp))}) if columns else {}
    moving = [(i, c) for i, c in enumerate(columns) if row[f"s{i}"]]
    return NumericFrame(view, [c for _, c in moving], med, {c: row[f"m{i}"] for i, c in moving}, {c: row[f"s{i}"] for i, c in moving}, {c: row[f"v{i}"] for i, c in moving})


def top_by_variance(frame: NumericFrame, n: int) -> list[tuple[str, float]]:
    return sorted(((c, frame.variance[c]) for c in frame.columns), key=lambda x: (-x[1], frame.columns.index(x[0])))[:n]


def bin_edges(n: int, low: float, high: float, iqr: float) -> int:
    """Number of bins: the finer of Freedman-Diaconis and Sturges."""
    if n == 0 or high == low:
        return 1
    width = min([w for w in (2 * iqr / n ** (1 / 3), (high - low) / (np.log2(n) + 1)) if w > 0])
    return int(max(1, np.ceil((high - low) / width)))


def histograms(frame: NumericFrame, columns: list[str]) -> DataFrame:
    """(column_name, bin, low, high, n) of the present values; empty bins are left out."""
    from tablewright.operators.columns import quartiles

    spark = frame.view.sparkSession
    if not columns:
        return spark.createDataFrame([], "column_name string, bin long, low double, high double, n long")
    row = wide_row(frame.view, {f"{k}{i}": a(name(c)) for i, c in enumerate(columns) for k, a in (("n", F.count), ("l", F.min), ("h", F.max))})
    cells = melt(frame.view, columns, [name(c) for c in columns], "double").where("value IS NOT NULL")
    counts = cells.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("cnt"))
    q = {r.c: r for r in quartiles(counts.select(F.lit(0).cast("long").alias("load_id"), F.col("pos").alias("c"), (F.col("value") + 0.0).alias("num"), "cnt")).collect()}
    rules = [(i, c, float(row[f"l{i}"]), float(row[f"h{i}"]), bin_edges(row[f"n{i}"], row[f"l{i}"], row[f"h{i}"], q[i].q3 - q[i].q1)) for i, c in enumerate(columns) if row[f"n{i}"]]
    at = spark.createDataFrame(rules, "pos int, column_name string, lo double, hi double, bins long")
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / F.when(step > 0, step)).cast("long"), F.col("bins") - 1)).otherwise(0)
    joined = counts.join(F.broadcast(at), "pos")  # one row per plotted column
    return joined.select("column_name", place.alias("bin"), "lo", step.alias("step"), "cnt").groupBy("column_name", "bin", "lo", "step").agg(F.sum("cnt").alias("n")).select(
        "column_name", "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"), "n"
    )


def densities(bins: DataFrame, points: int = 100) -> DataFrame:
    """(column_name, x, density): Gaussian kernels at the bins' middles, with Scott's bandwidth, on `points` points."""
    middle = bins.withColumn("m", (F.col("low") + F.col("high")) / 2)
    base = middle.groupBy("column_name").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    var = F.greatest(F.col("s2") / F.col("total") - F.pow(F.col("s1") / F.col("total"), 2), F.lit(1e-12))
    base = base.select("column_name", "total", (F.sqrt(var) * F.pow("total", F.lit(-0.2))).alias("h"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("m")) / F.col("h")
    return base.join(middle.select("column_name", "m", "n"), "column_name").groupBy("column_name", "x").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / F.first(F.col("total") * F.col("h") * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))


def seeded_sample(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """At most `limit` rows, the same ones however the rows are partitioned: those with the smallest hashes of key and seed."""
    order = F.md5(F.concat_ws("-", name(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.orderBy(order, name(key)).limit(limit)


def hue_column(coerced: DataFrame, roles: Roles, most: int = 10) -> str | None:
    """The first categorical column with 2 to `most` distinct present values."""
    columns = [c for c in coerced.columns if c in roles.categorical]
    if not columns:
        return None
    rough = wide_row(coerced, {f"d{i}": F.approx_count_distinct(name(c), 0.05) for i, c in enumerate(columns)})
    for i, c in enumerate(columns):
        if rough[f"d{i}"] <= 2 * most + 10:  # a bound on what the exact count holds
            n = coerced.agg(F.count_distinct(name(c))).first()[0]
            if 2 <= n <= most:
                return c
    return None


def pca(frame: NumericFrame, k: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((_key, pc1, pc2), explained shares, loadings); needs three columns. The largest loading of a component is positive.

    The covariance of scaled columns is their correlation, a p x p matrix; projecting is one expression per component.
    """
    p = len(frame.columns)
    if p < 3:
        raise ValueError("PCA needs at least three numeric columns that vary")
    full = frame.view.select(*(frame.filled(c).alias(c) for c in frame.columns))
    r = np.eye(p)
    place = {c: i for i, c in enumerate(frame.columns)}
    for row in pearson(full, frame.columns).collect():
        r[place[row.feature_1], place[row.feature_2]] = r[place[row.feature_2], place[row.feature_1]] = row.correlation
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order]
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    parts = [sum((frame.scaled(c) * F.lit(float(loadings[i, j])) for i, c in enumerate(frame.columns[1:], 1)), frame.scaled(frame.columns[0]) * F.lit(float(loadings[0, j]))).alias(f"pc{j + 1}") for j in range(k)]
    return frame.view.select("_key", *parts), values[order] / values.sum(), loadings


def leaf_order(matrix: np.ndarray) -> list[int]:
    """Order of leaves after average linkage of the rows of a correlation matrix by Euclidean distance."""
    n = len(matrix)
    d = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    trees: list = [[i] for i in range(n)]
    size = np.ones(n)
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[j, :] = d[:, j] = np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        trees[i] = trees[i] + trees[j]
    return trees[0] if n else []


def cluster_map(df: DataFrame, roles: Roles, key: str, config: ExploreConfig = ExploreConfig()) -> DataFrame:
    """(position, column_name): columns in the order of their hierarchical clustering, from a seeded sample of rows."""
    frame = numeric_frame(df, roles, key)
    if len(frame.columns) < 2:
        raise ValueError("a cluster map needs at least two numeric columns")
    sample = seeded_sample(frame.view, "_key", config.max_clustermap_rows, config.random_state)
    x = np.column_stack([np.asarray(c, float) for c in sample.select(*(frame.filled(c).alias(c) for c in frame.columns)).toArrow().columns])
    with np.errstate(all="ignore"):
        r = np.nan_to_num(np.corrcoef(x.T))
    spark = df.sparkSession
    return spark.createDataFrame([(i, frame.columns[j]) for i, j in enumerate(leaf_order(r))], "position int, column_name string")


def tsne(df: DataFrame, roles: Roles, key: str, config: ExploreConfig = ExploreConfig(), steps: int = 300) -> DataFrame:
    """(key, x, y): exact t-SNE of a seeded sample of at most max_tsne_rows rows, which are the operator's bound."""
    frame = numeric_frame(df, roles, key)
    if len(frame.columns) < 3:
        raise ValueError("t-SNE needs at least three numeric columns that vary")
    got = seeded_sample(frame.view, "_key", config.max_tsne_rows, config.random_state).select("_key", *(frame.scaled(c).alias(c) for c in frame.columns)).toArrow().sort_by("_key")
    x = np.column_stack([np.asarray(c, float) for c in got.columns[1:]])
    y = _embed(x, min(config.tsne_perplexity, max(5, len(x) - 1)), steps, config.random_state)
    return df.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(got.column("_key").to_pylist(), y)], "key long, x double, y double")


def _affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n <= 500 else np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    np.fill_diagonal(d, np.inf)
    for _ in range(50):
        p = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
        p /= p.sum(1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        up = h > np.log(perplexity)
        low, high = np.where(up, beta, low), np.where(up, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    return np.maximum((p + p.T) / (2 * n), 1e-12)


def _embed(x: np.ndarray, perplexity: float, steps: int, seed: int) -> np.ndarray:
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    p, y = _affinities(x, perplexity), np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(steps):
        w = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(w, 0)
        g = (p * (12 if t < 100 else 1) - w / w.sum()) * w
        grad = 4 * (g.sum(1)[:, None] * y - g @ y)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if t < 100 else 0.8) * speed - max(n / 48, 50) * gain * grad
        y = y + speed
        y -= y.mean(0)
    return y


def pair_plot(df: DataFrame, roles: Roles, key: str, config: ExploreConfig = ExploreConfig()) -> DataFrame:
    """(key, feature_x, feature_y, x, y, hue): the pairs of the widest columns for a seeded sample of rows."""
    frame = numeric_frame(df, roles, key)
    columns = [c for c, _ in top_by_variance(frame, config.top_n_pairplot)]
    if len(columns) < 2:
        raise ValueError("a pair plot needs at least two numeric columns that vary")
    hue = hue_column(coerce(df, roles), roles, config.max_hue_cardinality)
    clean = coerce(df, roles)
    rows = seeded_sample(clean, key, config.max_pairplot_rows, config.random_state)
    fill = lambda c: F.coalesce(name(c).cast("double"), F.lit(frame.medians[c]))
    cells = F.array(*(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"), fill(a).alias("x"), fill(b).alias("y")) for a, b in combinations(columns, 2)))
    return rows.select(name(key).alias("key"), (name(hue) if hue else F.lit(None).cast("string")).alias("hue"), F.explode(cells).alias("c")).select("key", "c.feature_x", "c.feature_y", "c.x", "c.y", "hue")


@dataclass
class Exploration:
    """figures by stem, and the reasons of stages that gave none."""

    figures: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)


def explore(df: DataFrame, roles: Roles, key: str, config: ExploreConfig = ExploreConfig(), with_tsne: bool = True) -> Exploration:
    """All six figures; a stage that fails is noted and the others go on."""
    clean = coerce(df, roles)

    def distributions() -> DataFrame:
        frame = numeric_frame(df, roles, key)
        return histograms(frame, [c for c, _ in top_by_variance(frame, config.top_n_distributions)])

    stages = {
        "missing_values_heatmap": lambda: missing_map(clean, key),
        "numeric_distributions": distributions,
        "hierarchical_cluster_map": lambda: cluster_map(df, roles, key, config),
        "pca_projection": lambda: pca(numeric_frame(df, roles, key))[0],
        "tsne_projection": lambda: tsne(df, roles, key, config),
        "pairplot_top_features": lambda: pair_plot(df, roles, key, config),
    }
    out = Exploration()
    for stem, make in stages.items():
        if stem == "tsne_projection" and not with_tsne:
            out.skipped[stem] = "not asked for"
            continue
        try:
            out.figures[stem] = make()
        except Exception as e:  # noqa: BLE001
            out.skipped[stem] = f"{type(e).__name__}: {e}"
    return out


def variance_table(frame: NumericFrame, n: int) -> DataFrame:
    return frame.view.sparkSession.createDataFrame(top_by_variance(frame, n), "column_name string, variance double")


def scaled_table(frame: NumericFrame) -> DataFrame:
    """The scaled matrix; fewer than two columns have none."""
    if len(frame.columns) < 2:
        raise ValueError("a scaled matrix needs at least two numeric columns that vary")
    return frame.view.select("_key", *(frame.scaled(c).alias(c) for c in frame.columns))


def missing_by_column(coerced: DataFrame) -> DataFrame:
    return unpivot_row(coerced, coerced.columns, {"n_missing": lambda c: F.sum(name(c).isNull().cast("long"))})
