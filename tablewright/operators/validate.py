"""Checks of a repaired table, alone and against its source. Each check yields rows (check_name, column_name, detail)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.config import SATURATION_THRESHOLD
from tablewright.functions.parse import is_blank, name
from tablewright.functions.stats import unpivot_row

ISSUE = "check_name string, column_name string, detail string"


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE)


def _empty_cell(df: DataFrame, c: str):
    kind = df.schema[c].dataType
    out = name(c).isNull()
    if isinstance(kind, T.StringType):
        out = out | is_blank(name(c))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = out | F.isnan(name(c))
    return F.coalesce(out, F.lit(True))


def completeness(df: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Columns with null, NaN or blank cells; skipped columns and copies of originals are exempt."""
    columns = [c for c in df.columns if c not in skipped and not c.endswith("_orig")]
    if not columns:
        return _none(df)
    gaps = unpivot_row(df, columns, {"n": lambda c: F.coalesce(F.sum(_empty_cell(df, c).cast("long")), F.lit(0))})
    return gaps.where("n > 0").select(F.lit("completeness").alias("check_name"), "column_name", F.concat(F.col("n").cast("string"), F.lit(" empty cells")).alias("detail"))


def placeholder_saturation(df: DataFrame, placeholder: str = "MISSING", threshold: float = SATURATION_THRESHOLD) -> DataFrame:
    """Text columns in which the placeholder makes up at least that share of all rows."""
    columns = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not columns:
        return _none(df)
    share = unpivot_row(df, columns, {"share": lambda c: F.avg(name(c).eqNullSafe(F.lit(placeholder)).cast("double"))})
    return share.where(F.col("share") >= threshold).select(F.lit("placeholder").alias("check_name"), "column_name", F.concat(F.round(F.col("share") * 100).cast("int").cast("string"), F.lit(f" % {placeholder}")).alias("detail"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value; copies of originals are exempt. Minimum and maximum decide, no distinct count."""
    columns = [c for c in df.columns if not c.endswith("_orig")]
    if not columns:
        return _none(df)
    value = lambda c: F.when(~F.isnan(name(c)), name(c)) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else name(c)
    same = unpivot_row(df, columns, {"same": lambda c: F.min(value(c)).eqNullSafe(F.max(value(c)))})
    return same.where("same").select(F.lit("constant").alias("check_name"), "column_name", F.lit("at most one distinct value").alias("detail"))


def row_count(df: DataFrame, original: DataFrame) -> DataFrame:
    sides = df.agg(F.count(F.lit(1)).alias("now"), F.lit(None).cast("long").alias("was")).unionByName(original.agg(F.lit(None).cast("long").alias("now"), F.count(F.lit(1)).alias("was")))
    counts = sides.agg(F.max("now").alias("now"), F.max("was").alias("was"))
    return counts.where("now <> was").select(F.lit("row_count").alias("check_name"), F.lit(None).cast("string").alias("column_name"), F.concat(F.col("was").cast("string"), F.lit(" rows became "), F.col("now").cast("string")).alias("detail"))


def columns_kept(df: DataFrame, original: DataFrame) -> DataFrame:
    lost = sorted(set(original.columns) - set(df.columns))
    return df.sparkSession.createDataFrame([("columns", None, "lost: " + ", ".join(lost))], ISSUE) if lost else _none(df)


def skipped_unchanged(df: DataFrame, original: DataFrame, skipped: tuple[str, ...], key: str | None = None) -> DataFrame:
    """Skipped columns with cells that differ, or whose type does. With a key the rows are matched by it; without one the
    multisets of values are compared, by counts and not by order."""
    both = [c for c in skipped if c in df.columns and c in original.columns]
    retyped = [c for c in both if df.schema[c].dataType != original.schema[c].dataType]
    out = [df.sparkSession.createDataFrame([("skipped", c, "type changed") for c in retyped], ISSUE)] if retyped else []
    same = [c for c in both if c not in retyped]
    if key is not None and same:
        left = df.select(name(key).alias("_k"), *(name(c).alias(f"_a{i}") for i, c in enumerate(same)))
        right = original.select(name(key).alias("_k"), *(name(c).alias(f"_b{i}") for i, c in enumerate(same)))
        joined = left.join(right, "_k")
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), (~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).alias("moved")) for i, c in enumerate(same)))
        moved = joined.select(F.explode(F.filter(cells, lambda x: x["moved"])).alias("c")).groupBy("c.column_name").agg(F.count(F.lit(1)).alias("n"))
        out.append(moved.select(F.lit("skipped").alias("check_name"), "column_name", F.concat(F.col("n").cast("string"), F.lit(" cells changed")).alias("detail")))
    for c in same if key is None else ():
        signed = df.select(name(c).alias("v"), F.lit(1).alias("s")).unionByName(original.select(name(c).alias("v"), F.lit(-1).alias("s")))
        moved = signed.groupBy("v").agg(F.sum("s").alias("s")).where("s <> 0").agg(F.sum(F.greatest("s", F.lit(0))).alias("n")).where("n IS NOT NULL")
        out.append(moved.select(F.lit("skipped").alias("check_name"), F.lit(c).alias("column_name"), F.concat(F.col("n").cast("string"), F.lit(" values changed")).alias("detail")))
    return reduce(DataFrame.unionByName, out) if out else _none(df)


@dataclass(frozen=True)
class Validation:
    issues: DataFrame
    checks_run: int

    @property
    def passed(self) -> bool:
        return self.issues.isEmpty()

    def to_text(self) -> str:
        rows = self.issues.orderBy("check_name", "column_name").collect()
        if not rows:
            return f"PASSED: {self.checks_run} checks"
        return "\n".join([f"FAILED: {len(rows)} issues in {self.checks_run} checks", *(f"[{r.check_name}] {(r.column_name + ': ') if r.column_name else ''}{r.detail}" for r in rows)])


def validate(df: DataFrame, original: DataFrame | None = None, skipped: tuple[str, ...] = (), placeholder: str = "MISSING", key: str | None = None) -> Validation:
    """Three checks, six with the original. All are lazy; the issues are one small table."""
    parts = [completeness(df, skipped), placeholder_saturation(df, placeholder), constant_columns(df)]
    if original is not None:
        parts += [row_count(df, original), columns_kept(df, original), skipped_unchanged(df, original, skipped, key)]
    return Validation(reduce(DataFrame.unionByName, parts), len(parts))
