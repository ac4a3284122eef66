"""Tasks, encodings, splits, boosted trees, metrics and rankings of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.config import ImportanceConfig
from tablewright.functions.parse import as_number, name
from tablewright.operators.roles import Roles, present
from tablewright.plans.shared import fits_broadcast, numbered_in_order, written

CLASSIFICATION, REGRESSION = "classification", "regression"
#: Stands for a missing value in tree input, beside an indicator column.
SENTINEL = -999_999_999.0


def infer_task(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """Regression if more than 0.9 of the present values are numbers and they are not all whole or have more than
    `max_classes` distinct values; else classification, also if none is present."""
    x = as_number(name(target), df.schema[target].dataType)
    whole = F.abs(x - F.rint(x)) <= 1e-8
    row = df.agg(F.count(present(df, target)).alias("n"), F.count(x).alias("p"), F.bool_and(whole).alias("w"), F.approx_count_distinct(x, 0.02).alias("d")).first()
    if not row.n or row.p / row.n <= 0.9:
        return CLASSIFICATION
    if not row.w or row.d > 2 * max_classes + 10:
        return REGRESSION
    return CLASSIFICATION if df.select(x.alias("x")).where("x IS NOT NULL").distinct().limit(max_classes + 1).count() <= max_classes else REGRESSION


def prepare_target(df: DataFrame, target: str, task: str) -> Column:
    """Regression: double. Classification: whole number if all present values are, else text."""
    x = as_number(name(target), df.schema[target].dataType)
    if task == REGRESSION:
        return x
    row = df.agg(F.count(present(df, target)).alias("n"), F.count(x).alias("p"), F.bool_and(x == F.floor(x)).alias("w")).first()
    return x.cast("long") if row.n and row.n == row.p and row.w else present(df, target).cast("string")


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct present values in sorted order, numbered from 0."""
    return numbered_in_order(df.select(present(df, column).alias("value")).where("value IS NOT NULL").distinct(), "value", "code")


def ordinal_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Labels as codes (double) in sorted order; missing stays null; other columns, and their order, as they are.

    The distinct labels of all columns of a type are numbered by one sort; a column's codes begin at its first label.
    """
    out = df
    for kind in dict.fromkeys(df.schema[c].dataType.simpleString() for c in columns):
        own = [i for i, c in enumerate(columns) if df.schema[c].dataType.simpleString() == kind]
        cells = F.array(*(F.struct(F.lit(i).alias("pos"), present(df, columns[i]).alias("value")) for i in own))
        labels = df.select(F.explode(cells).alias("label")).where("label.value IS NOT NULL").distinct()
        numbered = numbered_in_order(labels, "label", "n").select("label.pos", "label.value", "n")
        # one row per column
        first = numbered.groupBy("pos").agg(F.min("n").alias("first"))
        book = written(numbered.join(F.broadcast(first), "pos").select("pos", "value", (F.col("n") - F.col("first")).cast("double").alias("code")), "codes")
        fits = fits_broadcast(book)
        for i in own:
            right = book.where(F.col("pos") == i).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
            out = out.join(F.broadcast(right) if fits else right, present(df, columns[i]).eqNullSafe(F.col(f"_v{i}")), "left").drop(f"_v{i}")
    place = {c: i for i, c in enumerate(columns)}
    return out.select(*((F.col(f"_c{place[c]}").alias(c) if c in place else name(c)) for c in df.columns))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(present(df, target).isNotNull())


def held_out(df: DataFrame, key: str, share: float, seed: int, strata: str | None = None) -> DataFrame:
    """df with `is_test`: ceil(share * n) rows, of every class if strata is given and each class has two rows at least, else
    of all. Rows are chosen by the hash of key and seed: which threshold of the hash that is follows from counts per hash
    prefix, so no class is ever sorted in one task."""
    order = F.md5(F.concat_ws("-", name(key).cast("string"), F.lit(str(seed))).cast("binary"))
    group = F.lit("all")
    if strata is not None:
        sizes = df.groupBy(name(strata).alias("g")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
        if sizes.k > 1 and sizes.least >= 2:
            group = F.coalesce(name(strata).cast("string"), F.lit("(null)"))
    rows = df.withColumns({"_g": group, "_h": order})
    buckets = rows.groupBy("_g", F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumns({"upto": F.sum("n").over(upto), "want": F.ceil(F.lit(share) * F.sum("n").over(Window.partitionBy("_g")))})
    # the bucket in which the wanted number is reached, one per class; its rows alone are ranked
    edge = written(buckets.where("upto >= want AND upto - n < want").select("_g", F.col("_b").alias("_edge"), (F.col("want") - (F.col("upto") - F.col("n"))).alias("_left")), "edges")
    marked = rows.join(F.broadcast(edge) if fits_broadcast(edge) else edge, "_g")
    prefix = F.substring("_h", 1, 4)
    on_edge = marked.where(prefix == F.col("_edge")).select("_g", "_h", name(key).alias("_k"), "_left")
    last = on_edge.withColumn("_rn", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_k"))).where("_rn = _left").select("_g", F.col("_h").alias("_cut"))
    out = marked.join(last, "_g", "left")
    return out.withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))).select(*map(name, df.columns), "is_test")


# metrics ---------------------------------------------------------------------------------------------------------------


def classification_metrics(df: DataFrame, label: str, predicted: str, score: str | None = None) -> DataFrame:
    """(metric, value): accuracy, macro_f1 (0 where precision and recall are), and roc_auc if there are two classes and a
    score. All from counts: of (label, predicted), and of (score, label) for the average ranks."""
    confusion = df.groupBy(name(label).cast("string").alias("y"), name(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = confusion.agg(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    sides = confusion.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).alias("g"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.col("n").alias("g"), F.lit(0).alias("h")))).alias("s"))
    per = sides.groupBy("s.c").agg(F.sum("s.t").alias("t"), F.sum("s.g").alias("g"), F.sum("s.h").alias("h"))
    f1 = per.agg(F.avg(2 * F.col("h") / (F.col("t") + F.col("g"))).alias("f"))
    out = total.select(F.lit("accuracy").alias("metric"), (F.col("hit") / F.col("n")).alias("value")).unionByName(f1.select(F.lit("macro_f1").alias("metric"), F.col("f").alias("value")))
    if score is None:
        return out
    return out.unionByName(auc(df, label, score).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value")).where("value IS NOT NULL"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(auc) by rank sum with average ties; null unless there are exactly two classes. The greater label is the positive one."""
    from tablewright.functions.stats import average_ranks

    low, high = df.agg(F.min(name(label)), F.max(name(label))).first()
    y = name(label)
    marked = df.select(F.lit(0).alias("g"), name(score).cast("double").alias("s"), (y == F.lit(high)).cast("long").alias("pos"), ((y != F.lit(high)) & (y != F.lit(low))).cast("long").alias("other"))
    counts = marked.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"), F.sum("other").alias("other"))
    ranked = counts.join(average_ranks(counts.select("g", "s", "n"), ["g"], "s", "n"), ["g", "s"])
    sums = ranked.agg(F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"), F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("other").alias("o"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0) & (F.col("o") == 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.when(F.col("p") * F.col("q") > 0, F.col("p") * F.col("q"))).alias("auc"))


def regression_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(metric, value): rmse, mae, r2 (null for a constant label)."""
    y, p = name(label).cast("double"), name(predicted).cast("double")
    e = y - p
    row = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("var"))
    r2 = 1 - F.col("mse") / F.when(F.col("var") > 0, F.col("var"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in (("rmse", F.col("rmse")), ("mae", F.col("mae")), ("r2", r2))))).alias("m")).select("m.*")


# models ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Study:
    """task, classes (label by code), model, features, held-out predictions (with `label`, `prediction`), metrics, rankings
    (feature, gain, permutation, shap) and the reasons of rankings that failed."""

    task: str
    classes: list
    features: list[str]
    model: object
    predictions: DataFrame
    metrics: dict[str, float]
    rankings: DataFrame
    failures: dict[str, str] = field(default_factory=dict)

    def top(self, n: int = 15, by: str = "permutation") -> DataFrame:
        column = by if by in self.rankings.columns else self.rankings.columns[1]
        return self.rankings.orderBy(F.desc_nulls_last(column), "feature").limit(n)

    def to_text(self, n: int = 15) -> str:
        lines = [f"{self.task} on {len(self.features)} features", *(f"{k}: {v:.4f}" for k, v in self.metrics.items())]
        return "\n".join(lines + ["  ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) for r in self.top(n).collect()])


def _assembled(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Vectors of every feature, missing as a sentinel, and an indicator for each feature that has gaps."""
    row = df.agg(*(F.count(name(c)).alias(f"n{i}") for i, c in enumerate(features)), F.count(F.lit(1)).alias("n")).first()
    gaps = [c for i, c in enumerate(features) if row[f"n{i}"] < row.n]
    made = [F.coalesce(name(c), F.lit(SENTINEL)).alias(f"f{i}") for i, c in enumerate(features)] + [name(c).isNull().cast("double").alias(f"g{i}") for i, c in enumerate(gaps)]
    cols = [f"f{i}" for i in range(len(features))] + [f"g{i}" for i in range(len(gaps))]
    wide = df.select(*(c for c in df.columns if c not in features), *made)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(wide).drop(*cols), [*features, *gaps]


def _fit(train: DataFrame, task: str, n_classes: int, config: ImportanceConfig):
    settings = {"featuresCol": "features", "labelCol": "label", "maxIter": config.rounds, "maxDepth": config.depth, "stepSize": config.step, "seed": config.random_state}
    if task == REGRESSION:
        return GBTRegressor(**settings).fit(train)
    booster = GBTClassifier(**settings)
    return booster.fit(train) if n_classes <= 2 else OneVsRest(classifier=booster, featuresCol="features", labelCol="label").fit(train)


def _boosters(model) -> list:
    return list(model.models) if hasattr(model, "models") else [model]


def _nodes(node) -> list[tuple]:
    """(feature, gain) of every split, from the JVM tree; a split's gain is its fall of impurity times the rows it divides."""
    if node.subtreeDepth() == 0:
        return []
    return [(node.split().featureIndex(), node.gain() * node.impurityStats().count()), *_nodes(node.leftChild()), *_nodes(node.rightChild())]


def gain_importance(model, names: list[str]) -> dict[str, float]:
    """Average gain per split; 0 for features that no split uses. Indicators count for their feature; indices out of range are ignored."""
    got: dict[str, list[float]] = {n: [] for n in names}
    for booster in _boosters(model):
        for tree in booster.trees:
            for i, g in _nodes(tree._call_java("rootNode")):
                if 0 <= i < len(names):
                    got[names[i]].append(g)
    return {n: float(np.mean(g)) if g else 0.0 for n, g in got.items()}


def permutation_importance(model, test: DataFrame, names: list[str], task: str, repeats: int, seed: int, key: str = "_key") -> dict[str, float]:
    """Mean fall of accuracy or R2 when a feature (with its indicator) is shuffled over all held-out rows.

    Rows are numbered in the order of a hash; in each repeat a row is given the row a random distance behind it, so that
    every row lends its values once. A row travels once per repeat, as a small code for each feature that the trees look at: which
    of their thresholds a value exceeds is all that they ask. The features are exchanged in the Arrow batch, where only the trees
    that use a feature are evaluated again, and sums per feature and repeat are all that is passed on.
    """
    features = list(dict.fromkeys(names))
    boosters, cuts = _on_codes([_tree_table(b) for b in _boosters(model)])
    place = {c: i for i, c in enumerate(cuts)}
    columns = [[place[i] for i, n in enumerate(names) if n == f and i in place] for f in features]
    rows = test.select(key, "label", vector_to_array("features").alias("x"), F.xxhash64(key, F.lit(seed)).alias("_order"))
    coded = rows.mapInArrow(_coded(cuts, key), f"_order long, {key} {rows.schema[key].dataType.simpleString()}, label double, x binary")
    rows = written(numbered_in_order(coded, "_order", "r").select("r", "label", "x"), "held_out")
    n, spread = rows.agg(F.count(F.lit(1)), F.var_pop("label")).first()
    if not n:
        return dict.fromkeys(features, 0.0)
    steps = [int(x) for x in np.random.default_rng(seed).integers(1, max(n, 2), repeats)]
    asked = rows.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("t", "step")).withColumn("from", (F.col("r") + F.col("step")) % F.lit(n))
    given = asked.join(rows.select(F.col("r").alias("from"), F.col("x").alias("donor")), "from").select("t", "label", "x", "donor")
    held = test.sparkSession.sparkContext.broadcast(boosters)
    kind = _code_type(cuts)

    def score(margins: list[np.ndarray], y: np.ndarray) -> float:
        if task == REGRESSION:
            return float(((y - margins[0]) ** 2).sum())
        return float(((margins[0] > 0) == y).sum() if len(margins) == 1 else (np.argmax(margins, 0) == y).sum())

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = [[_used(tree) for _, tree in trees] for trees in held.value]
        sums: dict[tuple[int, int], float] = {}
        for batch in batches:
            if not len(batch):
                continue
            y, repeat = batch.column("label").to_numpy(), batch.column("t").to_numpy()
            # a column's codes lie together
            x, donor = (np.ascontiguousarray(np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(len(batch), len(cuts)).T) for c in ("x", "donor"))
            plain = [[np.broadcast_to(w * _tree_values(tree, x), len(batch)) for w, tree in trees] for trees in held.value]
            whole = [np.sum(p, 0) if p else np.zeros(len(batch)) for p in plain]
            for f in range(-1, len(features)):
                margins = whole
                if f >= 0:
                    own = set(columns[f])
                    changed = [donor[c] if c in own else x[c] for c in range(len(x))]
                    margins = [m + sum((w * _tree_values(tree, changed) - p for (w, tree), p, used in zip(trees, ps, use) if used & own), np.zeros(len(batch))) for m, trees, ps, use in zip(whole, held.value, plain, uses)]
                for t in np.unique(repeat).tolist():
                    at = repeat == t
                    sums[t, f] = sums.get((t, f), 0.0) + score([m[at] for m in margins], y[at])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["t", "f", "s"])

    got = {(r.t, r.f): r.s for r in given.mapInArrow(swapped, "t int, f int, s double").groupBy("t", "f").agg(F.sum("s").alias("s")).collect()}
    # R2 falls by the growth of the squared error over the variance, accuracy by the loss of hits
    unit = (spread or float("inf")) * n if task == REGRESSION else -n
    return {f: float(np.mean([(got[t, i] - got[t, -1]) / unit for t in range(repeats)])) for i, f in enumerate(features)}


def _used(node: tuple) -> set[int]:
    """Columns that a tree's splits look at."""
    return set() if len(node) == 2 else {node[0]} | _used(node[2]) | _used(node[3])


def _tree_values(node: tuple, x: np.ndarray | list[np.ndarray]) -> np.ndarray | float:
    """A tree's value for each row; x: by column."""
    return node[0] if len(node) == 2 else np.where(x[node[0]] <= node[1], _tree_values(node[2], x), _tree_values(node[3], x))


def _on_codes(boosters: list[list[tuple]]) -> tuple[list[list[tuple]], dict[int, np.ndarray]]:
    """Trees whose splits look at places and codes instead of columns and values, and the thresholds of every column used, in
    the order of the places. A value's code is the number of thresholds below it, so it is at most the i-th if the code is at most i."""
    seen: dict[int, set[float]] = {}

    def gathered(node: tuple) -> None:
        if len(node) > 2:
            seen.setdefault(node[0], set()).add(node[1])
            gathered(node[2])
            gathered(node[3])

    for _, tree in (t for trees in boosters for t in trees):
        gathered(tree)
    cuts = {c: np.array(sorted(seen[c])) for c in sorted(seen)}
    place = {c: i for i, c in enumerate(cuts)}

    def changed(node: tuple) -> tuple:
        if len(node) == 2:
            return node
        return (place[node[0]], int(np.searchsorted(cuts[node[0]], node[1])), changed(node[2]), changed(node[3]), node[4])

    return [[(w, changed(t)) for w, t in trees] for trees in boosters], cuts


def _code_type(cuts: dict[int, np.ndarray]) -> type:
    return np.uint8 if max(map(len, cuts.values()), default=0) < 256 else np.int32


def _coded(cuts: dict[int, np.ndarray], key: str):
    kind = _code_type(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            codes = np.empty((len(batch), len(cuts)), kind)
            for i, (c, at) in enumerate(cuts.items()):
                codes[:, i] = np.searchsorted(at, x[:, c])
            yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column(key), batch.column("label").cast(pa.float64()), pa.array([r.tobytes() for r in codes], pa.binary())], names=["_order", key, "label", "x"])

    return run


def _tree_table(booster) -> list[tuple]:
    """Trees as nested tuples (feature, threshold, left, right, cover) or (value, cover)."""

    def walk(node):
        cover = float(node.impurityStats().count())
        if node.subtreeDepth() == 0:
            return (float(node.prediction()), cover)
        s = node.split()
        return (s.featureIndex(), float(s.threshold()), walk(node.leftChild()), walk(node.rightChild()), cover)

    return [(w, walk(t._call_java("rootNode"))) for w, t in zip(booster.treeWeights, booster.trees)]


def _tree_shap(node: tuple, x: np.ndarray, phi: np.ndarray, weight: float) -> None:
    """Path-dependent Shapley values of one tree, added to phi, by permutation weights over the path's distinct features; x: one
    row or many. Which share of the cover goes a way is the same for all rows, whether a row goes it is an array."""
    x = np.atleast_2d(x)
    phi = phi.reshape(x.shape)

    def leaves(n, path):
        if len(n) == 2:
            yield n[0], path
            return
        f, t, left, right, cover = n
        low = x[:, f] <= t
        for child, goes in ((left, low), (right, ~low)):
            share = child[-1] / cover if cover else 0.0
            old = path.get(f, (1.0, 1.0))
            yield from leaves(child, path | {f: (old[0] * share, old[1] * goes)})

    for value, path in leaves(node, {}):
        m = len(path)
        w = np.array([1.0 / (m * _choose(m - 1, k)) for k in range(m)])
        # poly[k]: sum over subsets of size k of the products of one-fractions in and zero-fractions out
        for f, (own, goes) in path.items():
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for g, (zero, one) in path.items():
                if g != f:
                    poly[1:] = poly[1:] * zero + poly[:-1] * one
                    poly[0] *= zero
            phi[:, f] += weight * value * (goes - own) * (w @ poly)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def shap_importance(model, test: DataFrame, names: list[str], max_rows: int, seed: int, key: str = "_key") -> dict[str, float]:
    """Mean magnitude of Shapley values over a seeded sample of at most `max_rows` held-out rows, the operator's bound."""
    from tablewright.operators.explore import seeded_sample

    trees = [t for b in _boosters(model) for t in _tree_table(b)]
    held = test.sparkSession.sparkContext.broadcast(trees)
    p = len(names)

    def values(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            phi = np.zeros((len(x), p))
            for w, t in held.value:
                _tree_shap(t, x, phi, w)
            yield pd.DataFrame({"phi": list(np.abs(phi))})

    rows = seeded_sample(test.select(key, "features"), key, max_rows, seed).select(vector_to_array("features").alias("x"))
    mean = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(values, "phi array<double>").select(F.posexplode("phi").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).collect()
    out = dict.fromkeys(names, 0.0)
    for r in mean:
        out[names[r.i]] += r.v
    return out


#: Classes at most: each is a booster of its own, and their book is held by the driver.
MOST_CLASSES = 10_000
#: A way of ranking: (model, held-out rows, column names of the vectors, task, settings) -> importance of each feature.
Ranking = Callable[[object, DataFrame, list[str], str, ImportanceConfig], dict[str, float]]
RANKINGS: dict[str, Ranking] = {
    "gain": lambda model, test, names, task, c: gain_importance(model, names),
    "permutation": lambda model, test, names, task, c: permutation_importance(model, test, names, task, c.n_permutation_repeats, c.random_state),
    "shap": lambda model, test, names, task, c: shap_importance(model, test, names, c.max_shap_rows, c.random_state),
}


def importance_study(df: DataFrame, key: str, roles: Roles, config: ImportanceConfig, rankings: dict[str, Ranking] | None = None) -> Study:
    """Encode, split, fit, evaluate, rank. Unknown targets, targets without values and more than MOST_CLASSES classes raise
    ValueError. rankings: the ways to rank by, RANKINGS if none are given; one that fails is noted and the others go on."""
    target = config.target_column
    if target not in df.columns:
        raise ValueError(f"no column {target!r}; outcomes are {', '.join(roles.outcomes) or 'none'}")
    rows = drop_missing_target(df, target)
    features = roles.pick(without=(target,))
    features = [c for c in features if c != key]
    task = infer_task(rows, target, config.max_classification_classes)
    y = prepare_target(rows, target, task)
    labels = [c for c in features if c in roles.categorical]
    base = rows.select(name(key).alias("_key"), y.alias("_y"), *(name(c) if c in labels else as_number(name(c), rows.schema[c].dataType).alias(c) for c in features))
    base = ordinal_encode(base, labels) if labels else base
    classes: list = []
    if task == CLASSIFICATION:
        book = codes(base, "_y").limit(MOST_CLASSES + 1).collect()
        if len(book) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        classes = [r.value for r in sorted(book, key=lambda r: r.code)]
        pairs = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(classes)], f"_y {base.schema['_y'].dataType.simpleString()}, label double") if classes else None
        base = base.join(F.broadcast(pairs), "_y") if pairs is not None else base.withColumn("label", F.lit(0.0))
    else:
        base = base.withColumn("label", F.col("_y"))
    split = written(held_out(base.drop("_y"), "_key", config.test_size, config.random_state, "label" if task == CLASSIFICATION else None), "split")
    if split.isEmpty():
        raise ValueError(f"{target!r} has no values")
    vectors, names = _assembled(split, features)
    train, test = vectors.where("NOT is_test"), vectors.where("is_test")
    model = _fit(train, task, len(classes), config)
    predicted = written(model.transform(test).select("_key", "label", "prediction", *((vector_to_array("probability")[1].alias("score"),) if task == CLASSIFICATION and len(classes) == 2 else ())), "predictions")
    table = regression_metrics(predicted, "label", "prediction") if task == REGRESSION else classification_metrics(predicted, "label", "prediction", "score" if "score" in predicted.columns else None)
    metrics = {r.metric: r.value for r in table.collect()}
    got, failures = {}, {}
    for way, rank in (rankings or RANKINGS).items():
        try:
            got[way] = rank(model, test, names, task, config)
        except Exception as e:  # noqa: BLE001
            failures[way] = f"{type(e).__name__}: {e}"
    ranked = [(f, *(float(got[w][f]) for w in got)) for f in features]
    frame = df.sparkSession.createDataFrame(ranked, "feature string" + "".join(f", {w} double" for w in got)) if ranked else df.sparkSession.createDataFrame([], "feature string")
    first = "permutation" if "permutation" in got else next(iter(got), None)
    return Study(task, classes, features, model, predicted, metrics, frame.orderBy(F.desc(first), "feature") if first else frame, failures)


def test_rows(n: int, share: float) -> int:
    return ceil(share * n)
