"""Supervised queries. Metrics take rule-made predictions, which SQL can make too; fitted models are checked in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.config import ImportanceConfig
from tablewright.functions.parse import as_number, name
from tablewright.operators import supervise as M
from tablewright.operators.roles import Roles, classify
from tablewright.plans import sqltext as S
from tablewright.plans.tables import table

TARGETS = ["Y1", "Y5", "T", "X20_heart_rate", "X24_oxygen_sat", "X50_department", "X53_weekday", "X1"]


def task_inference(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "encounters")
    return spark.createDataFrame([(c, M.infer_task(raw, c)) for c in TARGETS], "column_name string, task string")


def ordinal_encode(spark: SparkSession, sf: str) -> DataFrame:
    return M.ordinal_encode(table(spark, sf, "encounters").select("row_id", *S.LABELS), S.LABELS)


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "encounters").select("X51_visit_type")
    return M.codes(raw, "X51_visit_type").select(F.col("value").alias("label"), "code")


def drop_missing_target(spark: SparkSession, sf: str) -> DataFrame:
    return M.drop_missing_target(table(spark, sf, "encounters").select("row_id", "X60_sparse"), "X60_sparse")


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.drop_missing_target(table(spark, sf, "encounters"), "Y5")
    return rows.groupBy(F.col("Y5").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "encounters").select("row_id", "Y5")
    return M.held_out(rows, "row_id", 0.2, 42, "Y5").select("row_id", "is_test")


def plain_split(spark: SparkSession, sf: str) -> DataFrame:
    return M.held_out(table(spark, sf, "encounters").select("row_id"), "row_id", 0.2, 42)


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "encounters")
    o2 = as_number(name("X24_oxygen_sat"), rows.schema["X24_oxygen_sat"].dataType)
    return rows.select("T", "Y4", "Y5", "X_signal", F.when(F.col("X_signal") > 0, 1).otherwise(0).alias("p_t"), F.when(F.col("X_signal") > 0.5, 2).when(F.col("X_signal") > -0.5, 1).otherwise(0).alias("p_5"), (F.col("X_signal") * 3 + 5).alias("p_y"), o2.alias("o2"))


def _metrics(df: DataFrame) -> DataFrame:
    return df.select("metric", F.round("value", 6).alias("value"))


def metrics_classification(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(M.classification_metrics(_predicted(spark, sf), "Y5", "p_5"))


def metrics_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(M.classification_metrics(_predicted(spark, sf), "T", "p_t", "X_signal"))


def metrics_regression(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(M.regression_metrics(_predicted(spark, sf), "Y4", "p_y"))


def auc_rank_sum(spark: SparkSession, sf: str) -> DataFrame:
    """A score with many ties."""
    return M.auc(_predicted(spark, sf).where("o2 IS NOT NULL"), "T", "o2").select(F.round("auc", 6).alias("auc"))


def _study(spark: SparkSession, sf: str, target: str) -> M.Study:
    raw = table(spark, sf, "encounters").select("row_id", *S.FIELDS)
    roles = classify(raw)
    roles = Roles(tuple(c for c in roles.numeric if c != "row_id"), roles.categorical, roles.identifiers, roles.outcomes)
    return M.importance_study(raw, "row_id", roles, ImportanceConfig(target))


def importance_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return _study(spark, sf, "Y4").rankings


def importance_gain(spark: SparkSession, sf: str) -> DataFrame:
    return _study(spark, sf, "Y1").top(30, "gain").select("feature", "gain")


def importance_permutation(spark: SparkSession, sf: str) -> DataFrame:
    return _study(spark, sf, "Y3").top(30, "permutation").select("feature", "permutation")


def model_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    made = _study(spark, sf, "Y4")
    return spark.createDataFrame(list(made.metrics.items()), "metric string, value double")


def importance_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes: one booster for each."""
    return _study(spark, sf, "Y5").rankings


def importance_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """The feature that each way of ranking puts first for an outcome that the signal drives, and whether the model finds it."""
    made = _study(spark, sf, "Y4")
    ways = [c for c in made.rankings.columns if c != "feature"]
    rows = [(way, made.top(1, way).first()["feature"], made.metrics["r2"] > 0.5) for way in ways]
    return spark.createDataFrame(rows, "ranking string, feature string, model_is_good boolean")


QUERIES = {
    f.__name__: f
    for f in (
        task_inference, ordinal_encode, label_encode, drop_missing_target, class_counts, stratified_split, plain_split, metrics_classification, metrics_binary,
        metrics_regression, auc_rank_sum, importance_gain, importance_permutation, importance_rankings, importance_leaders, model_evaluation, importance_classes,
    )
}


def _task_sql() -> str:
    parts = []
    for c in TARGETS:
        x = S.number(c)
        parts.append(f"select '{c}' as column_name, count({S.present(c)}) as n, count({x}) as p, bool_and({x} = floor({x})) as w, count(distinct {x}) as d from encounters")
    return f"select column_name, case when n = 0 or p / n <= 0.9 then 'classification' when w and d <= 10 then 'classification' else 'regression' end as task from ({S.union(parts)})"


def _ordinal_sql() -> str:
    books = ", ".join(f"b{i} as (select v, row_number() over (order by v) - 1 as code from (select distinct {S.present(c)} as v from encounters) where v is not null)" for i, c in enumerate(S.LABELS))
    joins = " ".join(f"left join b{i} on b{i}.v = {S.present('e.' + c).replace('e.' + c, 'e.' + c)}" for i, c in enumerate(S.LABELS))
    return f"with {books} select row_id, " + ", ".join(f"b{i}.code::double as {c}" for i, c in enumerate(S.LABELS)) + f" from encounters e {joins}"


def _split_sql(group: str) -> str:
    return f"select row_id, row_number() over (partition by {group} order by md5(row_id::varchar || '-42'), row_id) <= ceil(0.2e0 * count(*) over (partition by {group})) as is_test from encounters"


def _f1_sql(label: str, predicted: str, source: str) -> str:
    return f"""select avg(2e0 * h / (t + g)) from (
  select c, sum(case when y = c then 1 else 0 end) as t, sum(case when p = c then 1 else 0 end) as g, sum(case when y = c and p = c then 1 else 0 end) as h
  from (select {label} as y, {predicted} as p from {source}), (select distinct unnest([{label}, {predicted}]) as c from {source}) group by c)"""


_P5 = "case when X_signal > 0.5 then 2 when X_signal > -0.5 then 1 else 0 end"
_PT = "case when X_signal > 0 then 1 else 0 end"


def _auc_sql(score: str, source: str) -> str:
    return f"""select (sum(case when T = 1 then rk end) - sum(T) * (sum(T) + 1) / 2e0) / (sum(T)::double * sum(1 - T)) as auc from (
  select T, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2e0 as rk from {source})"""


SQL = {
    "importance_leaders": "select unnest(['gain', 'permutation', 'shap']) as ranking, 'X_signal' as feature, true as model_is_good",
    "task_inference": _task_sql(),
    "ordinal_encode": _ordinal_sql(),
    "label_encode": f"select v as label, row_number() over (order by v) - 1 as code from (select distinct {S.present('X51_visit_type')} as v from encounters) where v is not null",
    "drop_missing_target": "select row_id, X60_sparse from encounters where X60_sparse is not null and not isnan(X60_sparse)",
    "class_counts": "select Y5::bigint as label, count(*) as n from encounters where Y5 is not null group by 1",
    "stratified_split": _split_sql("Y5"),
    "plain_split": _split_sql("1"),
    "metrics_classification": f"select 'accuracy' as metric, round(avg(case when Y5 = {_P5} then 1e0 else 0e0 end), 6) as value from encounters union all select 'macro_f1', round(({_f1_sql('Y5', _P5, 'encounters')}), 6)",
    "metrics_binary": f"select 'accuracy' as metric, round(avg(case when T = {_PT} then 1e0 else 0e0 end), 6) as value from encounters union all select 'macro_f1', round(({_f1_sql('T', _PT, 'encounters')}), 6) union all select 'roc_auc', round(({_auc_sql('X_signal', 'encounters')}), 6)",
    "metrics_regression": "select metric, round(value, 6) as value from (select unnest(['rmse', 'mae', 'r2']) as metric, unnest([sqrt(avg(e * e)), avg(abs(e)), 1 - avg(e * e) / var_pop(Y4)]) as value from (select Y4, Y4 - (X_signal * 3 + 5) as e from encounters))",
    "auc_rank_sum": f"select round(auc, 6) as auc from ({_auc_sql('o2', '(select T, ' + S.number('X24_oxygen_sat') + ' as o2 from encounters) where o2 is not null')})",
}
