"""Wide aggregates in one pass, ranks without a global sort, and helpers to turn columns into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.parse import name

#: Aggregates in one job; more would leave generated code and be interpreted.
WIDE = 180


def wide_row(df: DataFrame, asked: dict[str, Column]) -> dict:
    """Evaluate many global aggregates, WIDE at a time, as a dict."""
    out: dict = {}
    items = list(asked.items())
    for i in range(0, len(items), WIDE):
        out |= df.agg(*(c.alias(k) for k, c in items[i : i + WIDE])).first().asDict()
    return out


def melt(df: DataFrame, columns: list[str], values: list[Column], kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., pos, column_name, value): one row per row and column."""
    cells = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), v.cast(kind).alias("value")) for i, (c, v) in enumerate(zip(columns, values))))
    return df.select(*map(name, keep), F.explode(cells).alias("cell")).select(*map(name, keep), "cell.pos", "cell.column_name", "cell.value")


def unpivot_row(df: DataFrame, columns: list[str], made: dict[str, callable]) -> DataFrame:
    """(pos, column_name, <made>...): aggregates of many columns as one row per column. made: output name -> column -> aggregate."""
    flat = df.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in made.items()))
    cells = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), *(F.col(f"{k}_{i}").alias(k) for k in made)) for i, c in enumerate(columns)))
    return flat.select(F.explode(cells).alias("cell")).select("cell.*")


def order_bucket(v: Column, per_log: int = 4096) -> Column:
    """A whole number that grows with v: about per_log buckets for each factor e of magnitude."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * per_log)).cast("long")


def average_ranks(counts: DataFrame, group: list[str], value: str, count: str) -> DataFrame:
    """(group..., value, rank): average rank of every distinct value of a group, from a table of distinct values and counts.

    Values are first counted in order-preserving buckets, so that a task orders the values of one bucket only, however
    many values a group has.
    """
    made = counts.withColumn("_b", order_bucket(F.col(value)))
    totals = made.groupBy(*group, "_b").agg(F.sum(count).alias("_own"))
    totals = totals.withColumn("_before", F.sum("_own").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")).drop("_own")
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = made.join(totals, [*group, "_b"]).withColumn("_end", F.sum(count).over(inside) + F.col("_before"))
    return ranked.select(*group, value, (F.col("_end") - (F.col(count) - 1) / 2).alias("rank"))


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness: null below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    raw = F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n > 2, F.when(F.stddev_pop(c) == 0, F.lit(0.0)).otherwise(raw))
