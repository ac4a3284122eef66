"""Imputation, validation and exploration queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.config import ExploreConfig, ImputationConfig
from tablewright.functions.parse import name
from tablewright.operators import explore as X
from tablewright.operators import validate as V
from tablewright.operators.impute import Imputer, impute, modes, numeric_view, scaler_stats
from tablewright.operators.roles import Roles, classify, coerce
from tablewright.plans import sqltext as S
from tablewright.plans.table_queries import encounters, prepared
from tablewright.plans.tables import table

#: A table with gaps made from one without, the same text for both engines.
MESSY = """select c_custkey, case when c_custkey % 33 <> 5 then c_acctbal end as bal, case when c_custkey % 41 <> 7 then c_nationkey::double end as nat,
 case when c_custkey % 29 <> 3 then c_acctbal * 2 + (c_custkey % 13) * 100 end as bal2,
 case when c_custkey % 37 = 2 then null when c_custkey % 53 = 6 then '  ' when c_custkey % 59 = 8 then '--' else c_mktsegment end as segment,
 c_name as untouched from customer"""
MESSY_ROLES = Roles(("c_custkey", "bal", "nat", "bal2"), ("segment", "untouched"), ("c_custkey",))
MESSY_NUMBERS = ["c_custkey", "bal", "nat", "bal2"]
K = 5


def messy(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql(MESSY)


def _r(c: str, digits: int = 4):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def _imputed(spark: SparkSession, sf: str, **settings):
    settings = {"n_neighbors": K, "skip_columns": ("untouched",)} | settings
    return impute(messy(spark, sf), "c_custkey", ImputationConfig(**settings), MESSY_ROLES)


def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf).frame.select("c_custkey", _r("bal"), F.col("nat").cast("double").alias("nat"), _r("bal2"))


def impute_knn_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, weights="uniform").frame.select("c_custkey", _r("bal"), F.col("nat").cast("double").alias("nat"), _r("bal2"))


def impute_text_key(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows under a text as their key."""
    keyed = messy(spark, sf).withColumn("label", F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")))
    roles = Roles(MESSY_ROLES.numeric, (*MESSY_ROLES.categorical, "label"), ("c_custkey", "label"))
    made = impute(keyed, "label", ImputationConfig(n_neighbors=K, skip_columns=("untouched", "label")), roles).frame
    return made.select("c_custkey", _r("bal"), F.col("nat").cast("double").alias("nat"), _r("bal2"))


def impute_capped(spark: SparkSession, sf: str) -> DataFrame:
    """More neighbours are asked for than there are rows; the report says how many there were."""
    rows = table(spark, sf, "region").select("r_regionkey", F.when(F.col("r_regionkey") != 2, F.col("r_regionkey") * 1.5).alias("v"))
    return impute(rows, "r_regionkey", ImputationConfig(n_neighbors=50), Roles(("r_regionkey", "v"), ())).report


def impute_encounters(spark: SparkSession, sf: str) -> DataFrame:
    """All encounters with the default settings: 20 neighbours for every gap of a number, the mode for labels."""
    raw = table(spark, sf, "encounters").select("row_id", *S.FIELDS)
    return impute(raw, "row_id", ImputationConfig(), Roles(tuple(c for c in S.NUMERIC if c != "PAT_ID"), tuple(S.LABELS), ("row_id", "PAT_ID"))).frame


def impute_skip(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, skip_columns=("untouched", "segment")).frame.select("c_custkey", "segment", "untouched")


def impute_keep_originals(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, keep_original_columns=True).frame.select("c_custkey", "segment", "segment_orig", "bal_orig")


def impute_report(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf).report


def scaler_statistics(spark: SparkSession, sf: str) -> DataFrame:
    columns = [c for c in S.NUMERIC if c != "PAT_ID"]
    stats = scaler_stats(numeric_view(table(spark, sf, "encounters").select("row_id", *S.NUMERIC), "row_id", columns), columns)
    # a mean of decimals may end in a 5: digits beyond those that a mean of this many rows can have are stable
    rows = [(c, s.median, round(s.mean, 7) + 0.0, round(s.sd, 6), s.whole) for c, s in stats.items()]
    return spark.createDataFrame(rows, "column_name string, median double, mean double, sd double, whole boolean")


def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    """The median fill that scaling starts from."""
    frame = X.numeric_frame(encounters(spark, sf).withColumn("row_id", F.lit(0)), Roles(tuple(S.NUMERIC), (), ("PAT_ID",), ("Y1", "Y2", "Y3", "Y4", "Y5")))
    rows = table(spark, sf, "encounters")
    view = numeric_view(rows.select("row_id", *frame.columns), "row_id", frame.columns)
    return view.select(F.col("_key").alias("row_id"), *(frame.filled(c).alias(c) for c in frame.columns))


def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    clean = prepared(spark, sf)[2]
    found = modes(clean, S.LABELS)
    return spark.createDataFrame(list(found.items()), "column_name string, mode string")


def blank_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all encounters, missing and blank ones filled by the mode."""
    raw = table(spark, sf, "encounters").select("row_id", *S.LABELS)
    roles = Roles(("row_id",), tuple(S.LABELS), ("row_id",))
    return Imputer.fit(raw, "row_id", ImputationConfig(), roles).transform(raw).frame.select("row_id", *S.LABELS)


def restore_integrality(spark: SparkSession, sf: str) -> DataFrame:
    """Which numeric columns hold whole numbers only."""
    return scaler_statistics(spark, sf).select("column_name", "whole")


# validation: the first delivery of each encounter, without two columns and with implausible readings taken out, against all rows


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    original = table(spark, sf, "encounters")
    firsts = original.groupBy("enc_id").agg(F.min("row_id").alias("row_id")).select("row_id")
    kept = original.join(firsts, "row_id", "left_semi").drop("X58_language", "X60_sparse")
    bmi = F.when(F.col("X26_bmi").between(10, 60), F.col("X26_bmi"))
    return kept.withColumns({"X26_bmi": bmi, "X55_weather": F.coalesce("X55_weather", F.lit("MISSING")), "X57_payment": F.lit("MISSING")}), original


def check_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return V.completeness(_pair(spark, sf)[0], ("X26_bmi",))


def check_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    return V.placeholder_saturation(_pair(spark, sf)[0])


def check_constant(spark: SparkSession, sf: str) -> DataFrame:
    return V.constant_columns(_pair(spark, sf)[0])


def check_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return V.row_count(*_pair(spark, sf)).select("check_name", "detail")


def check_columns(spark: SparkSession, sf: str) -> DataFrame:
    return V.columns_kept(*_pair(spark, sf)).select("check_name", "detail")


def check_skipped_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return V.skipped_unchanged(*_pair(spark, sf), ("X26_bmi", "X25_weight_lb"), "row_id")


def validation_issues(spark: SparkSession, sf: str) -> DataFrame:
    made, original = _pair(spark, sf)
    return V.validate(made, original, ("X26_bmi", "X25_weight_lb"), key="row_id").issues.withColumn("column_name", F.coalesce("column_name", F.lit("")))


# exploration


def _raw(spark: SparkSession, sf: str) -> tuple[DataFrame, Roles]:
    raw = table(spark, sf, "encounters").select("row_id", *S.FIELDS)
    roles = classify(raw)
    return raw, Roles(tuple(c for c in roles.numeric if c != "row_id"), roles.categorical, roles.identifiers, roles.outcomes)


def _frame(spark: SparkSession, sf: str) -> X.NumericFrame:
    return X.numeric_frame(*_raw(spark, sf), "row_id")


def missing_map(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles = _raw(spark, sf)
    return X.missing_map(coerce(raw, roles), "row_id").withColumn("missing_fraction", F.round("missing_fraction", 9) + F.lit(0.0))


def missing_cells(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles = _raw(spark, sf)
    return X.missing_cells(coerce(raw, roles), "row_id")


def top_by_variance(spark: SparkSession, sf: str) -> DataFrame:
    return X.variance_table(_frame(spark, sf), 12).withColumn("variance", F.round("variance", 2))


def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    frame = _frame(spark, sf)
    return X.histograms(frame, ["X21_systolic", "X26_bmi", "X30", "X25_weight_lb"]).select("column_name", "bin", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def density_curves(spark: SparkSession, sf: str) -> DataFrame:
    frame = _frame(spark, sf)
    return X.densities(X.histograms(frame, ["X21_systolic", "X26_bmi"])).select("column_name", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def standardized_matrix(spark: SparkSession, sf: str) -> DataFrame:
    frame = _frame(spark, sf)
    return X.scaled_table(frame).select(F.col("_key").alias("row_id"), *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in frame.columns))


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return X.seeded_sample(table(spark, sf, "encounters").select("row_id", "PAT_ID"), "row_id", 1000, 42)


def hue_column(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles = _raw(spark, sf)
    return spark.createDataFrame([(X.hue_column(coerce(raw, roles), roles, 10),)], "column_name string")


def pair_plot_marks(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles = _raw(spark, sf)
    return X.pair_plot(raw, roles, "row_id")


def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    return X.pca(_frame(spark, sf))[0].withColumnRenamed("_key", "row_id")


def pca_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: rows projected, and whether the components are centred, uncorrelated and in the order of their variance."""
    made = X.pca(_frame(spark, sf))[0]
    row = made.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{c}") for c in ("pc1", "pc2") for k, f in (("m", F.avg), ("v", F.var_pop))), F.corr("pc1", "pc2").alias("r"))
    return row.select(F.col("n").alias("n_rows"), ((F.abs("mpc1") < 1e-6) & (F.abs("mpc2") < 1e-6)).alias("centred"), (F.abs("r") < 1e-6).alias("uncorrelated"), (F.col("vpc1") >= F.col("vpc2")).alias("first_is_widest"))


def exploration_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Each of the six figures of a run, and whether it has marks."""
    return exploration_stages(spark, sf).select("figure", (F.col("marks") > 0).alias("has_marks"))


def cluster_order(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles = _raw(spark, sf)
    return X.cluster_map(raw, roles, "row_id")


def tsne_projection(spark: SparkSession, sf: str) -> DataFrame:
    raw, roles = _raw(spark, sf)
    return X.tsne(raw, roles, "row_id", ExploreConfig())


def exploration_stages(spark: SparkSession, sf: str) -> DataFrame:
    """All figures of one run, with their numbers of marks."""
    raw, roles = _raw(spark, sf)
    made = X.explore(raw, roles, "row_id")
    return spark.createDataFrame([(stem, marks.count()) for stem, marks in made.figures.items()], "figure string, marks long")


def repaired_is_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the imputed customers against their source: none."""
    source = messy(spark, sf)
    made = impute(source, "c_custkey", ImputationConfig(K, skip_columns=("untouched",)), MESSY_ROLES).frame
    return V.validate(made, source, ("untouched",), key="c_custkey").issues


QUERIES = {
    f.__name__: f
    for f in (
        exploration_stages, repaired_is_valid, impute_mode, impute_median, impute_knn, impute_knn_uniform, impute_text_key, impute_capped, impute_encounters, restore_integrality, blank_fallback, impute_skip, impute_keep_originals, impute_report, scaler_statistics,
        check_completeness, check_placeholder, check_constant, check_row_count, check_columns, check_skipped_unchanged, validation_issues,
        missing_map, missing_cells, top_by_variance, histogram_bins, density_curves, standardized_matrix, seeded_sample, hue_column, pair_plot_marks, pca_projection, pca_checked, exploration_whole, cluster_order, tsne_projection,
    )
}


@cache
def _modes_sql() -> str:
    cells = S.union([f"select '{c}' as column_name, {S.present(c)} as value from encounters" for c in S.LABELS])
    return f"""select column_name, value as mode from (
  select column_name, value, row_number() over (partition by column_name order by count(*) desc, value) as rn from ({cells}) where value is not null and not {S.blank('value')} group by 1, 2) where rn = 1"""


def _fallback_sql() -> str:
    out = ", ".join(f"case when {S.present(c)} is null or {S.blank(c)} then (select mode from modes where column_name = '{c}') else {c} end as {c}" for c in S.LABELS)
    return f"with modes as ({_modes_sql()}) select row_id, {out} from encounters"


def _stats_sql() -> str:
    cols = [c for c in S.NUMERIC if c != "PAT_ID"]
    return f"with {S.CLEAN}, med as (select " + ", ".join(f"quantile_cont({c}::double, 0.5) as {c}" for c in cols) + " from clean) " + S.union(
        [f"select '{c}' as column_name, max(m.{c}) as median, round(avg(coalesce(clean.{c}::double, m.{c})), 7) + 0e0 as mean, round(stddev_pop(coalesce(clean.{c}::double, m.{c})), 6) as sd, coalesce(bool_and(clean.{c} = floor(clean.{c}::double)), false) as whole from clean, med m" for c in cols]
    )


def _median_fill_sql() -> str:
    cols = S.NUMERIC_FEATURES
    return f"with {S.CLEAN} select row_id, " + ", ".join(f"coalesce({c}::double, (select quantile_cont({c}::double, 0.5) from clean)) as {c}" for c in cols) + " from clean"


def _knn_sql(weights: str) -> str:
    cols = MESSY_NUMBERS
    z = ", ".join(f"(m.{c}::double - s.{c}_m) / s.{c}_s as z_{c}" for c in cols)
    stats = ", ".join(f"avg(coalesce(m.{c}::double, d.{c})) as {c}_m, stddev_pop(coalesce(m.{c}::double, d.{c})) as {c}_s" for c in cols)
    shared = " + ".join(f"case when r.{c} is not null and t.{c} is not null then 1 else 0 end" for c in cols)
    d2 = " + ".join(f"coalesce((r.z_{c} - t.z_{c}) * (r.z_{c} - t.z_{c}), 0)" for c in cols)
    parts = []
    for c in cols[1:]:
        value = "avg(v)" if weights == "uniform" else "coalesce(avg(case when d = 0 then v end), sum(case when d > 0 then v / d end) / sum(case when d > 0 then 1 / d end))"
        parts.append(f"""select c_custkey, '{c}' as col, {value} as v from (
  select r.c_custkey, t.{c} as v, round(sqrt(({d2}) * {len(cols)}e0 / nullif({shared}, 0)), 9) as d,
    row_number() over (partition by r.c_custkey order by round(sqrt(({d2}) * {len(cols)}e0 / nullif({shared}, 0)), 9), t.c_custkey) as rn
  from scaled r join scaled t on r.{c} is null and t.{c} is not null) where rn <= {K} group by 1""")
    return f"""
with messy as ({MESSY}), med as (select {", ".join(f"quantile_cont({c}::double, 0.5) as {c}" for c in cols)} from messy),
stats as (select {stats} from messy m, med d), scaled as (select m.*, {z} from messy m, stats s), fills as ({S.union(parts)})
select m.c_custkey, round(coalesce(bal, (select v from fills f where f.c_custkey = m.c_custkey and col = 'bal')), 4) + 0e0 as bal,
  coalesce(nat, (select round_even(v, 0) from fills f where f.c_custkey = m.c_custkey and col = 'nat')) as nat,
  round(coalesce(bal2, (select v from fills f where f.c_custkey = m.c_custkey and col = 'bal2')), 4) + 0e0 as bal2 from messy m"""


_SEGMENT_MODE = f"(select segment from messy where segment not in {S.TOKENS} and not {S.blank('segment')} group by 1 order by count(*) desc, segment limit 1)"
_SEGMENT = f"case when segment is null or segment in {S.TOKENS} or {S.blank('segment')} then {_SEGMENT_MODE} else segment end"
_FIRSTS = "firsts as (select * exclude (X58_language, X60_sparse) replace (case when X26_bmi between 10 and 60 then X26_bmi end as X26_bmi, coalesce(X55_weather, 'MISSING') as X55_weather, 'MISSING' as X57_payment) from encounters where row_id in (select min(row_id) from encounters group by enc_id))"
_KEPT = ["row_id", "enc_id", "load_id", "clinic_id", "appt_ts", "checkin_ts", *(c for c in S.FIELDS if c not in ("X58_language", "X60_sparse"))]


def _gap(c: str) -> str:
    if c in S.DOUBLES:
        return f"({c} is null or isnan({c}))"
    return f"({c} is null or {S.blank(c)})" if c in (*S.LABELS, *S.NUMBER_TEXTS, "clinic_id") else f"{c} is null"


_COMPLETE = S.union([f"select 'completeness' as check_name, '{c}' as column_name, n || ' empty cells' as detail from (select count(*) filter ({_gap(c)}) as n from firsts) where n > 0" for c in _KEPT if c != "X26_bmi"])
_PLACEHOLDER = S.union([f"select 'placeholder' as check_name, '{c}' as column_name, cast(round(s * 100) as int) || ' % MISSING' as detail from (select avg(case when {c} = 'MISSING' then 1e0 else 0e0 end) as s from firsts) where s >= 0.5" for c in (*S.LABELS, *S.NUMBER_TEXTS, "clinic_id") if c != "X58_language"])
_CONSTANT = S.union([f"select 'constant' as check_name, '{c}' as column_name, 'at most one distinct value' as detail from firsts having min({S.present(c) if c in S.DOUBLES else c}) is not distinct from max({S.present(c) if c in S.DOUBLES else c})" for c in _KEPT])
_ROWS = "select 'row_count' as check_name, was || ' rows became ' || now as detail from (select (select count(*) from firsts) as now, (select count(*) from encounters) as was) where now <> was"
_COLUMNS = "select 'columns' as check_name, 'lost: X58_language, X60_sparse' as detail"
_MOVED = S.union([f"select 'skipped' as check_name, '{c}' as column_name, n || ' cells changed' as detail from (select count(*) filter (f.{c} is distinct from e.{c}) as n from firsts f join encounters e using (row_id)) where n > 0" for c in ("X26_bmi", "X25_weight_lb")])


def _map_sql() -> str:
    cells = ", ".join(f"avg(case when {c} is null then 1e0 else 0e0 end) as {c}" for c in S.FIELDS)
    return f"""
with {S.CLEAN}, ends as (select min(row_id) as lo, max(row_id) as hi from encounters),
banded as (select cast((row_id - lo) // ((hi - lo) // 50 + 1) as int) as band, count(*) as n_rows, {cells} from clean, ends group by 1)
{S.union([f"select band, '{c}' as column_name, n_rows, round({c}, 9) + 0e0 as missing_fraction from banded" for c in S.FIELDS])}"""


def _variance_sql() -> str:
    parts = [f"select {i} as pos, '{c}' as column_name, var_samp(coalesce({c}::double, (select quantile_cont({c}::double, 0.5) from clean))) as variance from clean" for i, c in enumerate(S.NUMERIC_FEATURES)]
    return f"with {S.CLEAN} select column_name, round(variance, 2) as variance from ({S.union(parts)}) where variance > 0 order by variance desc, pos limit 12"


def _hist_sql(columns: list[str], digits: int = 6) -> str:
    cells = S.union([f"select '{c}' as column_name, {c}::double as v from clean where {c} is not null" for c in columns])
    return f"""
with {S.CLEAN}, cells as ({cells}),
rule as (
  select column_name, count(*) as n, min(v) as lo, max(v) as hi, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / power(count(*), 1 / 3e0) as fd, (max(v) - min(v)) / (log2(count(*)) + 1) as st from cells group by 1),
bins as (select column_name, lo, hi, greatest(1, ceil((hi - lo) / case when fd > 0 then least(fd, st) else st end))::bigint as k from rule),
placed as (select column_name, least(floor((v - lo) / ((hi - lo) / k))::bigint, k - 1) as bin, lo, (hi - lo) / k as step from cells join bins using (column_name))
select column_name, bin, count(*) as n, round(any_value(lo) + bin * any_value(step), {digits}) as low, round(any_value(lo) + (bin + 1) * any_value(step), {digits}) as high from placed group by 1, 2"""


def _density_sql(columns: list[str], points: int = 100) -> str:
    return f"""
with bins as ({_hist_sql(columns, 14)}),
total as (select column_name, sum(n) as t, sum(n * (low + high) / 2) as s1, sum(n * ((low + high) / 2) * ((low + high) / 2)) as s2, min(low) as lo, max(high) as hi from bins group by 1),
width as (select *, sqrt(greatest(s2 / t - (s1 / t) * (s1 / t), 1e-12)) * power(t, -0.2) as h from total),
spots as (select *, lo + (hi - lo) * i / {points - 1} as x from width, range({points}) r(i))
select column_name, round(x, 6) as x, round(sum(n * exp(-power((x - (low + high) / 2) / h, 2) / 2)) / (any_value(t) * any_value(h) * sqrt(2 * pi())), 9) as density
from spots join bins using (column_name) group by column_name, i, x"""


def _pair_plot_sql() -> str:
    """The four widest columns for the sampled rows, each pair once, the wider one as x."""
    wide = S.union([f"select {i} as pos, '{c}' as col, var_samp(coalesce({c}::double, (select quantile_cont({c}::double, 0.5) from clean))) as variance from clean" for i, c in enumerate(S.NUMERIC_FEATURES)])
    cells = S.union([f"select row_id, '{c}' as col, coalesce({c}::double, (select quantile_cont({c}::double, 0.5) from clean)) as v from clean where row_id in (from chosen)" for c in S.NUMERIC_FEATURES])
    hues = S.union([f"select row_id, '{c}' as column_name, {c} as hue from clean where row_id in (from chosen)" for c in S.LABELS])
    return f"""
with {S.CLEAN}, chosen as (select row_id from encounters order by md5(row_id::varchar || '-42'), row_id limit 1000),
widest as (select col, row_number() over (order by variance desc, pos) as place from ({wide}) qualify place <= 4),
cells as (select * from ({cells}) join widest using (col)),
hued as (select row_id, hue from ({hues}) join (select column_name from ({S.union([f"select {i} as pos, '{c}' as column_name, count(distinct {c}) as n from clean" for i, c in enumerate(S.LABELS)])}) where n between 2 and 10 order by pos limit 1) using (column_name))
select a.row_id as key, a.col as feature_x, b.col as feature_y, a.v as x, b.v as y, hue from cells a join cells b on a.row_id = b.row_id and a.place < b.place join hued on hued.row_id = a.row_id"""


def _scaled_sql() -> str:
    cols = S.NUMERIC_FEATURES
    med = "med as (select " + ", ".join(f"quantile_cont({c}::double, 0.5) as {c}" for c in cols) + " from clean)"
    filled = "filled as (select row_id, " + ", ".join(f"coalesce(clean.{c}::double, m.{c}) as {c}" for c in cols) + " from clean, med m)"
    stats = "stats as (select " + ", ".join(f"avg({c}) as {c}_m, stddev_pop({c}) as {c}_s" for c in cols) + " from filled)"
    return f"with {S.CLEAN}, {med}, {filled}, {stats} select row_id, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 4) + 0e0 as {c}" for c in cols) + " from filled, stats"


def _hue_sql() -> str:
    return f"with {S.CLEAN} select column_name from (" + S.union([f"select {i} as pos, '{c}' as column_name, count(distinct {c}) as n from clean" for i, c in enumerate(S.LABELS)]) + ") where n between 2 and 10 order by pos limit 1"


SQL = {
    "impute_mode": _modes_sql(),
    "impute_median": _median_fill_sql(),
    "impute_knn": _knn_sql("distance"),
    "impute_text_key": _knn_sql("distance"),
    "impute_capped": "select 'v' as column_name, 'knn(k=' || (count(*) - 1) || ')' as strategy, count(*) filter (r_regionkey = 2) as filled from region",
    "impute_knn_uniform": _knn_sql("uniform"),
    "restore_integrality": f"select column_name, whole from ({_stats_sql()})",
    "blank_fallback": _fallback_sql(),
    "impute_skip": f"with messy as ({MESSY}) select c_custkey, segment, untouched from messy",
    "impute_keep_originals": f"with messy as ({MESSY}) select c_custkey, {_SEGMENT} as segment, segment as segment_orig, bal as bal_orig from messy",
    "impute_report": f"""with messy as ({MESSY})
select column_name, strategy, n as filled from (
  {S.union([f"select '{c}' as column_name, 'knn(k={K})' as strategy, count(*) filter ({c} is null) as n from messy" for c in MESSY_NUMBERS])}
  union all select 'segment', 'mode', count(*) filter (segment is null or segment in {S.TOKENS}) from messy
  union all select 'segment', 'mode-fallback', count(*) filter ({S.blank('segment')} and segment not in {S.TOKENS}) from messy) where n > 0""",
    "scaler_statistics": _stats_sql(),
    "check_completeness": f"with {_FIRSTS} {_COMPLETE}",
    "check_placeholder": f"with {_FIRSTS} {_PLACEHOLDER}",
    "check_constant": f"with {_FIRSTS} {_CONSTANT}",
    "check_row_count": f"with {_FIRSTS} {_ROWS}",
    "check_columns": _COLUMNS,
    "check_skipped_unchanged": f"with {_FIRSTS} {_MOVED}",
    "validation_issues": f"with {_FIRSTS} select check_name, coalesce(column_name, '') as column_name, detail from ({S.union([_COMPLETE, 'select * from (' + _PLACEHOLDER + ')', _CONSTANT, _MOVED, 'select check_name, null as column_name, detail from (' + _ROWS + ')', 'select check_name, null as column_name, detail from (' + _COLUMNS + ')'])}) where not (check_name = 'completeness' and column_name = 'X25_weight_lb')",
    "repaired_is_valid": "select null::varchar as check_name, null::varchar as column_name, null::varchar as detail where false",
    "missing_map": _map_sql(),
    "top_by_variance": _variance_sql(),
    "histogram_bins": _hist_sql(["X21_systolic", "X26_bmi", "X30", "X25_weight_lb"]),
    "missing_cells": f"with {S.CLEAN} {S.union([f"select row_id, '{c}' as column_name from clean where {c} is null" for c in S.FIELDS])}",
    "density_curves": _density_sql(["X21_systolic", "X26_bmi"]),
    "pair_plot_marks": _pair_plot_sql(),
    "pca_checked": "select count(*) as n_rows, true as centred, true as uncorrelated, true as first_is_widest from encounters",
    "exploration_whole": "select unnest(['hierarchical_cluster_map', 'missing_values_heatmap', 'numeric_distributions', 'pairplot_top_features', 'pca_projection', 'tsne_projection']) as figure, true as has_marks",
    "repaired_is_valid": "select null::varchar as check_name, null::varchar as column_name, null::varchar as detail where false",
    "standardized_matrix": _scaled_sql(),
    "seeded_sample": "select row_id, PAT_ID from encounters order by md5(row_id::varchar || '-42'), row_id limit 1000",
    "hue_column": _hue_sql(),
}
