"""Pairwise-complete correlations of numeric columns.

Pearson: every partition multiplies its masked block of columns with itself and passes on p x p sums; nothing else is
shuffled. Spearman and Kendall start from counts of distinct value pairs. Spearman ranks distinct values in
order-preserving buckets; Kendall counts discordant pairs exactly by cutting the plane into a grid: pairs in different rows
and columns of the grid follow from its counts, the others from its stripes, each a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parse import as_number, name
from tablewright.functions.stats import average_ranks, wide_row
from tablewright.operators.roles import Roles
from tablewright.plans.shared import written

PAIRS = "feature_1 string, feature_2 string, correlation double"
#: Grid lines per axis for Kendall.
GRID = 256


def numeric_view(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(as_number(name(c), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)))


def select_columns(df: DataFrame, roles: Roles, exclude_identifiers: bool = True) -> list[str]:
    """Numeric columns that are present, without identifiers; outcomes stay."""
    out = set(roles.identifiers) if exclude_identifiers else set()
    return [c for c in roles.numeric if c in df.columns and c not in out]


def drop_constants(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with two different values at least; empty ones go too."""
    view = numeric_view(df, columns)
    row = wide_row(view, {f"{f.__name__}{i}": f(f"v{i}") for i in range(len(columns)) for f in (F.min, F.max)}) if columns else {}
    return [c for i, c in enumerate(columns) if row[f"min{i}"] is not None and row[f"min{i}"] != row[f"max{i}"]]


def _pairs_frame(spark, columns: list[str], r: dict[tuple[int, int], float]) -> DataFrame:
    rows = [(columns[i], columns[j], float(v)) for (i, j), v in r.items()]
    return spark.createDataFrame(rows, PAIRS) if rows else spark.createDataFrame([], PAIRS)


def _from_moments(n, sx, sy, sxy, sxx, syy):
    with np.errstate(all="ignore"):
        cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
        r = cov / np.sqrt(vx * vy)
    return np.where((n > 1) & (vx > 1e-12 * np.maximum(sxx, 1e-300)) & (vy > 1e-12 * np.maximum(syy, 1e-300)), np.clip(r, -1, 1), np.nan)


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) of all pairs that vary on their shared rows."""
    p = len(columns)
    view = numeric_view(df, columns)
    row = wide_row(view, {f"{k}{i}": f(f"v{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(p)])
    scale = np.array([row[f"s{i}"] or 1.0 for i in range(p)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for b in batches:
            for s in range(0, len(b), 16384):
                x = np.column_stack([c.slice(s, 16384).to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
                seen = ~np.isnan(x)
                z, m = np.where(seen, (x - centre) / scale, 0.0), seen.astype(np.float64)
                total += np.stack([m.T @ m, z.T @ m, z.T @ z, (z * z).T @ m])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "total"])

    parts = view.mapInArrow(sums, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    t = np.zeros(4 * p * p)
    for r in parts:  # 4 p^2 numbers
        t[r.at] = r.total
    n, sx, sxy, sxx = t.reshape(4, p, p)
    r = _from_moments(n, sx, sx.T, sxy, sxx, sxx.T)
    return _pairs_frame(df.sparkSession, columns, {(i, j): r[i, j] for i, j in combinations(range(p), 2) if not np.isnan(r[i, j])})


def joint_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, x, y, n): counts of the distinct value pairs of every pair of columns, over rows that have both."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y")) for i, j in combinations(range(len(columns)), 2)))
    flat = numeric_view(df, columns).select(F.explode(cells).alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL")
    return flat.groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of average ranks; values are ranked anew on the shared rows of each pair."""
    joint = written(joint_counts(df, columns), "joint")
    ranks = {}
    for side in "xy":
        counts = joint.groupBy("i", "j", side).agg(F.sum("n").alias("n"))
        ranks[side] = average_ranks(counts, ["i", "j"], side, "n").withColumnRenamed("rank", f"r{side}")
    both = joint.join(ranks["x"], ["i", "j", "x"]).join(ranks["y"], ["i", "j", "y"])
    size = joint.groupBy("i", "j").agg(F.sum("n").alias("m"))
    # ranks around their mean, scaled to (-1, 1), keep the sums small
    u, v = ((F.col(c) - (F.col("m") + 1) / 2) / F.col("m") for c in ("rx", "ry"))
    moments = both.join(F.broadcast(size), ["i", "j"]).groupBy("i", "j").agg(*(F.sum(F.col("n") * e).alias(k) for k, e in (("xy", u * v), ("xx", u * u), ("yy", v * v))))
    rows = {(r.i, r.j): r.xy / (r.xx * r.yy) ** 0.5 for r in moments.collect() if r.xx > 0 and r.yy > 0}
    return _pairs_frame(df.sparkSession, columns, {k: max(-1.0, min(1.0, rows[k])) for k in sorted(rows)})


def _discordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Weighted pairs with x1 < x2 and y1 > y2. In the order of x (ties by y) these are the pairs whose y fall; one bit of y's
    rank after the other, from the highest, rows that agree so far lie together, and every falling pair is counted at the
    first bit in which it differs."""
    order = np.lexsort((y, x))
    rank, n = np.unique(y[order], return_inverse=True)[1], n[order].astype(object if float(n.sum()) ** 2 > 2**62 else np.int64)
    total, group = 0, np.zeros(len(n), np.int64)
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        high = (rank >> bit) & 1
        ones = np.cumsum(n * high)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        before = (ones - n * high)[starts]
        behind = ones - np.repeat(before, np.diff(np.append(starts, len(n))))
        total += int((n * (1 - high) * behind).sum())
        group = group * 2 + high
        place = np.argsort(group, kind="stable")
        group, rank, n = group[place], rank[place], n[place]
    return total


def _grid_discordant(gx: np.ndarray, gy: np.ndarray, n: np.ndarray) -> int:
    """Pairs of cells with gx1 < gx2 and gy1 > gy2."""
    grid = np.zeros((gx.max() + 1, gy.max() + 1), object)
    np.add.at(grid, (gx, gy), n.astype(object))
    above = np.cumsum(grid[:, ::-1], 1)[:, ::-1]
    strictly = np.hstack([above[:, 1:], np.zeros((len(grid), 1), object)])
    left = np.cumsum(strictly, 0) - strictly
    return int((left * grid).sum())


def kendall(df: DataFrame, columns: list[str], grid: int = GRID) -> DataFrame:
    """Tau-b on the shared rows of each pair, exact."""
    joint = written(joint_counts(df, columns), "joint")
    cut = joint.groupBy("i", "j").agg(*(F.percentile_approx(s, [k / grid for k in range(1, grid)], 4 * grid).alias(f"c{s}") for s in "xy"))
    at = lambda s: F.size(F.filter(f"c{s}", lambda c: c < F.col(s)))
    placed = written(joint.join(F.broadcast(cut), ["i", "j"]).select("i", "j", "x", "y", "n", at("x").alias("gx"), at("y").alias("gy")), "grid")
    whole = placed.groupBy("i", "j", "gx", "gy").agg(F.sum("n").alias("n"))

    def far(g: pd.DataFrame) -> pd.DataFrame:
        total = _grid_discordant(g.gx.to_numpy(), g.gy.to_numpy(), g.n.to_numpy())
        return pd.DataFrame({"i": g.i[:1], "j": g.j[:1], "d": [total]})

    def column_stripe(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": g.i[:1], "j": g.j[:1], "d": [_discordant(g.x.to_numpy(), g.y.to_numpy(), g.n.to_numpy())]})

    def row_stripe(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": g.i[:1], "j": g.j[:1], "d": [_discordant(g.gx.to_numpy(), g.y.to_numpy(), g.n.to_numpy())]})

    kind = "i int, j int, d decimal(38,0)"
    as_decimal = lambda f: lambda g: f(g).assign(d=lambda x: [Decimal(int(v)) for v in x.d])
    found = whole.groupBy("i", "j").applyInPandas(as_decimal(far), kind)
    # a stripe of one value, however many rows have it, holds no such pairs and isn't brought together
    for side, grid_side, stripe in (("x", "gx", column_stripe), ("y", "gy", row_stripe)):
        wide = placed.groupBy("i", "j", grid_side).agg(F.min(side).alias("_lo"), F.max(side).alias("_hi")).where("_lo < _hi").select("i", "j", grid_side)
        # as many rows as pairs of columns have grid lines
        found = found.unionByName(placed.join(F.broadcast(wide), ["i", "j", grid_side], "left_semi").groupBy("i", "j", grid_side).applyInPandas(as_decimal(stripe), kind))
    discordant = {(r.i, r.j): int(r.d) for r in found.groupBy("i", "j").agg(F.sum("d").alias("d")).collect()}
    big = "decimal(38,0)"
    halves = lambda n: (n.cast(big) * (n.cast(big) - 1) / 2).cast(big)
    ties = {}
    for s, keys in (("x", ["x"]), ("y", ["y"]), ("xy", ["x", "y"]), ("", [])):
        t = joint.groupBy("i", "j", *keys).agg(F.sum("n").alias("n")).groupBy("i", "j").agg(F.sum(halves(F.col("n"))).alias("t"))
        ties[s] = {(r.i, r.j): int(r.t) for r in t.collect()}
    out = {}
    for k in sorted(ties[""]):
        n0, tx, ty, txy, d = ties[""][k], ties["x"][k], ties["y"][k], ties["xy"][k], discordant[k]
        if n0 > tx and n0 > ty:
            # concordant + discordant = all pairs without those tied in x or y
            out[k] = (n0 - tx - ty + txy - 2 * d) / (float(n0 - tx) ** 0.5 * float(n0 - ty) ** 0.5)
    return _pairs_frame(df.sparkSession, columns, out)


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Strongest first, with the magnitude; ties by names."""
    out = pairs.where(F.col("correlation").isNotNull() & ~F.isnan("correlation")).withColumn("abs_correlation", F.abs("correlation"))
    return out.orderBy(F.desc("abs_correlation"), "feature_1", "feature_2")


@dataclass(frozen=True)
class Correlations:
    method: str
    columns: tuple[str, ...]
    pairs: DataFrame

    @property
    def ranked(self) -> DataFrame:
        return rank_pairs(self.pairs)

    def top(self, n: int = 10) -> DataFrame:
        return self.ranked.limit(n)

    def above(self, threshold: float) -> DataFrame:
        return self.ranked.where(F.col("abs_correlation") >= threshold)

    def matrix(self) -> DataFrame:
        """All ordered pairs, the diagonal too, for display."""
        turned = self.pairs.select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "correlation")
        own = self.pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in self.columns], PAIRS)
        return self.pairs.unionByName(turned).unionByName(own)


def correlations(df: DataFrame, roles: Roles, method: str = "pearson", exclude_identifiers: bool = True) -> Correlations:
    """Fewer than two numeric columns, or an unknown method, raise ValueError; constant columns are left out."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    columns = select_columns(df, roles, exclude_identifiers)
    if len(columns) < 2:
        raise ValueError("a correlation needs at least two numeric columns")
    columns = drop_constants(df, columns)
    pairs = METHODS[method](df, columns) if len(columns) > 1 else _pairs_frame(df.sparkSession, columns, {})
    return Correlations(method, tuple(columns), pairs)
