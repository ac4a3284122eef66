"""A table's profile: gaps, skew, dominant labels, strongest correlations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.config import DOMINANCE_THRESHOLD, SKEW_THRESHOLD
from tablewright.functions.parse import name
from tablewright.functions.stats import adjusted_skewness, melt, unpivot_row
from tablewright.operators.correlate import correlations
from tablewright.operators.roles import Roles, coerce


def missing_fractions(coerced: DataFrame) -> DataFrame:
    """(column_name, missing_fraction) over all columns, the emptiest first, ties in column order."""
    out = unpivot_row(coerced, coerced.columns, {"missing_fraction": lambda c: F.coalesce(F.avg(name(c).isNull().cast("double")), F.lit(0.0))})
    return out.orderBy(F.desc("missing_fraction"), "pos").select("column_name", "missing_fraction")


def columns_with_missing(coerced: DataFrame) -> DataFrame:
    return missing_fractions(coerced).where("missing_fraction > 0")


def skewness(coerced: DataFrame, roles: Roles) -> DataFrame:
    """(column_name, skewness) of the numeric features, greatest magnitude first; columns of under three values have none."""
    columns = roles.pick("numeric")
    if not columns:
        return coerced.sparkSession.createDataFrame([], "column_name string, skewness double")
    out = unpivot_row(coerced, columns, {"skewness": lambda c: adjusted_skewness(name(c).cast("double"))})
    return out.orderBy(F.desc_nulls_last(F.abs("skewness")), "pos").select("column_name", "skewness")


def highly_skewed(coerced: DataFrame, roles: Roles, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    return skewness(coerced, roles).where(F.abs("skewness") >= threshold)


def dominant_categories(coerced: DataFrame, roles: Roles, threshold: float = DOMINANCE_THRESHOLD) -> DataFrame:
    """(column_name, value, share) of categorical columns whose most frequent value has at least that share of the present
    ones; ties to the smallest value. One grouping for all columns, combined before the shuffle."""
    columns = list(roles.categorical)
    if not columns:
        return coerced.sparkSession.createDataFrame([], "column_name string, value string, share double")
    counts = melt(coerced, columns, [name(c) for c in columns], "string").where("value IS NOT NULL").groupBy("pos", "column_name", "value").count()
    top = counts.groupBy("pos", "column_name").agg(F.sum("count").alias("n"), F.min(F.struct((-F.col("count")).alias("c"), "value")).alias("best"))
    return top.select("column_name", F.col("best.value").alias("value"), (-F.col("best.c") / F.col("n")).alias("share")).where(F.col("share") >= threshold).orderBy("column_name")


@dataclass(frozen=True)
class Profile:
    """row and column counts, and one lazy table per section."""

    n_rows: int
    n_columns: int
    missing: DataFrame
    skew: DataFrame
    dominant: DataFrame
    top_correlations: DataFrame | None
    skew_threshold: float = SKEW_THRESHOLD

    def to_text(self, top_n: int = 10) -> str:
        def section(title: str, rows: list, show, empty: str) -> list[str]:
            return ["", title, "-" * len(title), *(show(r) for r in rows)] if rows else ["", title, "-" * len(title), empty]

        gaps = self.missing.where("missing_fraction > 0").limit(top_n).collect()
        skewed = self.skew.where(F.abs("skewness") >= self.skew_threshold).limit(top_n).collect()
        pairs = self.top_correlations.limit(top_n).collect() if self.top_correlations is not None else []
        lines = [f"{self.n_rows} rows, {self.n_columns} columns"]
        lines += section("Missing values", gaps, lambda r: f"{r.column_name:<28}{r.missing_fraction:8.2%}", "None")
        lines += section("Skewed columns", skewed, lambda r: f"{r.column_name:<28}{r.skewness:8.2f}", "None")
        lines += section("Dominant values", self.dominant.limit(top_n).collect(), lambda r: f"{r.column_name:<28}{r.value} ({r.share:.1%})", "None")
        lines += section("Strongest correlations", pairs, lambda r: f"{r.feature_1} ~ {r.feature_2}: {r.correlation:+.3f}", "Not enough numeric columns")
        return "\n".join(lines)


def profile(df: DataFrame, roles: Roles) -> Profile:
    """All sections of a raw table. An empty table has no gaps, no skew and no dominant value."""
    clean = coerce(df, roles)
    try:
        top = correlations(clean, roles).ranked
    except ValueError:
        top = None
    return Profile(clean.count(), len(df.columns), missing_fractions(clean), skewness(clean, roles), dominant_categories(clean, roles), top)


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))
