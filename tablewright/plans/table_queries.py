"""Roles, profiles and correlations of the encounters, each over the whole table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.parse import name, null_if_token
from tablewright.operators import correlate as R
from tablewright.operators import profile as P
from tablewright.operators.roles import Roles, classify, coerce, numeric_fractions
from tablewright.plans import sqltext as S
from tablewright.plans.tables import table

VITALS = ["X20_heart_rate", "X21_systolic", "X22_diastolic", "X25_weight_lb", "X30", "X31"]
FEW = ["X21_systolic", "X22_diastolic", "X24_oxygen_sat"]


def encounters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "encounters").select(*map(name, S.FIELDS))


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, Roles, DataFrame]:
    raw = encounters(spark, sf)
    roles = classify(raw)
    return raw, roles, coerce(raw, roles)


def null_token_normalize(spark: SparkSession, sf: str) -> DataFrame:
    texts = [*S.NUMBER_TEXTS, *S.LABELS]
    return table(spark, sf, "encounters").select("row_id", *(null_if_token(name(c)).alias(c) for c in texts))


def numeric_fraction(spark: SparkSession, sf: str) -> DataFrame:
    share = numeric_fractions(encounters(spark, sf))
    return spark.createDataFrame([(c, round(v, 9)) for c, v in share.items()], "column_name string, fraction double")


def classify_columns(spark: SparkSession, sf: str) -> DataFrame:
    roles = classify(encounters(spark, sf))
    rows = [(c, "numeric" if c in roles.numeric else "categorical", c in roles.identifiers, c in roles.outcomes) for c in S.FIELDS]
    return spark.createDataFrame(rows, "column_name string, role string, is_identifier boolean, is_outcome boolean")


def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(classify(encounters(spark, sf)).counts().items()), "role string, n long")


def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "encounters").select("row_id", *S.FIELDS)
    clean = coerce(raw, classify(raw))
    return clean.select("row_id", *((F.col(c).cast("double") if c in S.NUMERIC else name(c)).alias(c) for c in S.FIELDS))


def _rounded(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.withColumn(column, F.round(column, digits) + F.lit(0.0))


def missing_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(P.missing_fractions(prepared(spark, sf)[2]), "missing_fraction", 9)


def columns_with_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(P.columns_with_missing(prepared(spark, sf)[2]), "missing_fraction", 9)


def skewness_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    _, roles, clean = prepared(spark, sf)
    return _rounded(P.skewness(clean, roles), "skewness", 4)


def highly_skewed(spark: SparkSession, sf: str) -> DataFrame:
    _, roles, clean = prepared(spark, sf)
    return _rounded(P.highly_skewed(clean, roles), "skewness", 4)


def dominant_category(spark: SparkSession, sf: str) -> DataFrame:
    _, roles, clean = prepared(spark, sf)
    return _rounded(P.dominant_categories(clean, roles), "share", 9)


def dominant_at_half(spark: SparkSession, sf: str) -> DataFrame:
    _, roles, clean = prepared(spark, sf)
    return _rounded(P.dominant_categories(clean, roles, 0.5), "share", 9)


def profile_dims(spark: SparkSession, sf: str) -> DataFrame:
    return P.dimensions(encounters(spark, sf))


def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = encounters(spark, sf)
    lines = P.profile(raw, classify(raw)).to_text().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("feature_1", "feature_2", (F.round("correlation", 6) + F.lit(0.0)).alias("correlation"))


def pearson_pairs_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles, _ = prepared(spark, sf)
    return _pairs(R.correlations(raw, roles).pairs)


def pearson_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Columns without gaps."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _pairs(R.pearson(table(spark, sf, "lineitem").select(*columns), columns))


def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(R.spearman(table(spark, sf, "encounters").select(*VITALS), VITALS))


def kendall_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(R.kendall(table(spark, sf, "encounters").select(*FEW), FEW))


def corr_top_n(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles, _ = prepared(spark, sf)
    return _pairs(R.correlations(raw, roles).top(10))


def corr_above(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles, _ = prepared(spark, sf)
    return _pairs(R.correlations(raw, roles).above(0.8))


def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "encounters").select(*VITALS)
    return _pairs(R.correlations(raw, Roles(tuple(VITALS), ())).matrix())


def drop_constants(spark: SparkSession, sf: str) -> DataFrame:
    raw = encounters(spark, sf).withColumns({"flat": F.lit(7.0), "hollow": F.lit(None).cast("double")})
    kept = R.drop_constants(raw, [*S.NUMERIC, "flat", "hollow"])
    return spark.createDataFrame([(c,) for c in kept], "column_name string")


QUERIES = {
    f.__name__: f
    for f in (
        null_token_normalize, numeric_fraction, classify_columns, role_counts, coerce_numeric, missing_fraction, columns_with_missing, skewness_adjusted,
        highly_skewed, dominant_category, dominant_at_half, profile_dims, profile_text, pearson_pairs, pearson_pairs_with_gaps, spearman_pairs, kendall_pairs,
        corr_top_n, corr_above, corr_matrix, drop_constants,
    )
}


def _fraction_sql() -> str:
    parts = []
    for c in S.FIELDS:
        if c in (*S.LABELS, *S.NUMBER_TEXTS):
            parts.append(f"select '{c}' as column_name, count({S.number(c)}) as parsed, count({S.present(c)}) as seen from encounters")
        else:
            parts.append(f"select '{c}' as column_name, count({S.present(c)}) as parsed, count({S.present(c)}) as seen from encounters")
    return f"select column_name, round(case when seen > 0 then parsed / seen else 0 end, 9) as fraction from ({S.union(parts)})"


def _classify_sql() -> str:
    ids, outs = "('PAT_ID')", "('Y1', 'Y2', 'Y3', 'Y4', 'Y5')"
    return f"select column_name, case when fraction >= 0.9 then 'numeric' else 'categorical' end as role, column_name in {ids} as is_identifier, column_name in {outs} as is_outcome from ({_fraction_sql()})"


def _missing_sql() -> str:
    return f"with {S.CLEAN} select column_name, missing_fraction from (" + S.union([f"select '{c}' as column_name, round(avg(case when {c} is null then 1e0 else 0e0 end), 9) as missing_fraction from clean" for c in S.FIELDS]) + ")"


def _skew_sql() -> str:
    one = "select '{0}' as column_name, round(case when count({0}) < 3 then null when stddev_pop({0}) = 0 then 0e0 else skewness({0}) end, 4) + 0e0 as skewness from clean"
    return f"with {S.CLEAN} select * from (" + S.union([one.format(c) for c in S.NUMERIC_FEATURES]) + ")"


def _dominant_sql(threshold: float) -> str:
    cells = S.union([f"select '{c}' as column_name, {c} as value from clean" for c in S.LABELS])
    return f"""
with {S.CLEAN}, cells as ({cells}),
counts as (select column_name, value, count(*) as n from cells where value is not null group by 1, 2),
ranked as (select *, row_number() over (partition by column_name order by n desc, value) as rn, sum(n) over (partition by column_name) as total from counts)
select column_name, value, round(n / total, 9) as share from ranked where rn = 1 and n / total >= {threshold}"""


def _pearson_sql(columns: list[str], source: str, prefix: str = "") -> str:
    parts = [
        f"select '{a}' as feature_1, '{b}' as feature_2, count({a} + {b}) as n, corr({a}, {b}) as r, stddev_pop(case when {b} is not null then {a} end) as sa, stddev_pop(case when {a} is not null then {b} end) as sb from {source}"
        for a, b in combinations(columns, 2)
    ]
    return f"{prefix} select feature_1, feature_2, round(r, 6) + 0e0 as correlation from ({S.union(parts)}) where n > 1 and sa > 0 and sb > 0 and not isnan(r)"


def _spearman_sql(columns: list[str]) -> str:
    parts = [f"select '{a}' as feature_1, '{b}' as feature_2, {a} as x, {b} as y from clean where {a} is not null and {b} is not null" for a, b in combinations(columns, 2)]
    rank = "rank() over (partition by feature_1, feature_2 order by {0}) + (count(*) over (partition by feature_1, feature_2, {0}) - 1) / 2e0"
    return f"""
with {S.CLEAN}, pairs as ({S.union(parts)}),
ranked as (select feature_1, feature_2, {rank.format("x")} as rx, {rank.format("y")} as ry from pairs)
select feature_1, feature_2, round(corr(rx, ry), 6) + 0e0 as correlation from ranked group by 1, 2"""


def _kendall_sql(columns: list[str]) -> str:
    parts = [f"select '{a}' as feature_1, '{b}' as feature_2, {a} as x, {b} as y, count(*)::double as n from clean where {a} is not null and {b} is not null group by {a}, {b}" for a, b in combinations(columns, 2)]
    return f"""
with {S.CLEAN}, joint as ({S.union(parts)}),
signs as (
  select a.feature_1, a.feature_2, sum(case when a.x < b.x and a.y < b.y then a.n * b.n when a.x < b.x and a.y > b.y then -a.n * b.n else 0 end) as s
  from joint a join joint b on a.feature_1 = b.feature_1 and a.feature_2 = b.feature_2 and a.x < b.x group by 1, 2),
total as (select feature_1, feature_2, sum(n) * (sum(n) - 1) / 2 as n0 from joint group by 1, 2),
tx as (select feature_1, feature_2, sum(m * (m - 1) / 2) as t from (select feature_1, feature_2, x, sum(n) as m from joint group by 1, 2, 3) group by 1, 2),
ty as (select feature_1, feature_2, sum(m * (m - 1) / 2) as t from (select feature_1, feature_2, y, sum(n) as m from joint group by 1, 2, 3) group by 1, 2)
select feature_1, feature_2, round(s / (sqrt(n0 - tx.t) * sqrt(n0 - ty.t)), 6) + 0e0 as correlation
from signs join total using (feature_1, feature_2) join tx using (feature_1, feature_2) join ty using (feature_1, feature_2)"""


_NUMERIC_NO_ID = [c for c in S.NUMERIC if c != "PAT_ID"]
_GAPS = _pearson_sql(_NUMERIC_NO_ID, "clean", f"with {S.CLEAN}")
_FRACTION = _fraction_sql()
VITAL_PAIRS = _pearson_sql(VITALS, "clean", f"with {S.CLEAN}")

SQL = {
    "null_token_normalize": "select row_id, " + ", ".join(f"{S.present(c)} as {c}" for c in [*S.NUMBER_TEXTS, *S.LABELS]) + " from encounters",
    "numeric_fraction": _FRACTION,
    "classify_columns": _classify_sql(),
    "role_counts": f"""with r as ({_classify_sql()})
select 'numeric' as role, count(*) filter (role = 'numeric') as n from r union all select 'categorical', count(*) filter (role = 'categorical') from r
union all select 'identifiers', count(*) filter (is_identifier) from r union all select 'outcomes', count(*) filter (is_outcome) from r""",
    "coerce_numeric": f"with {S.CLEAN} select row_id, " + ", ".join(f"{c}::double as {c}" if c in S.NUMERIC else c for c in S.FIELDS) + " from clean",
    "missing_fraction": _missing_sql(),
    "columns_with_missing": f"select * from ({_missing_sql()}) where missing_fraction > 0",
    "skewness_adjusted": _skew_sql(),
    "highly_skewed": f"select * from ({_skew_sql()}) where abs(skewness) >= 1",
    "dominant_category": _dominant_sql(0.9),
    "dominant_at_half": _dominant_sql(0.5),
    "profile_dims": f"select count(*) as n_rows, {len(S.FIELDS)}::bigint as n_columns from encounters",
    "pearson_pairs": _pearson_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"),
    "pearson_pairs_with_gaps": _GAPS,
    "spearman_pairs": _spearman_sql(VITALS),
    "kendall_pairs": _kendall_sql(FEW),
    "corr_top_n": f"select * from ({_GAPS}) order by abs(correlation) desc, feature_1, feature_2 limit 10",
    "corr_above": f"select * from ({_GAPS}) where abs(correlation) >= 0.8",
    "corr_matrix": f"""with c as ({VITAL_PAIRS})
select feature_1, feature_2, correlation from c union all select feature_2, feature_1, correlation from c
union all select v, v, 1e0 from (values {", ".join(f"('{v}')" for v in VITALS)}) t(v)""",
    "drop_constants": f"with {S.CLEAN} " + S.union([f"select '{c}' as column_name from clean having min({c}) <> max({c})" for c in S.NUMERIC]),
}
