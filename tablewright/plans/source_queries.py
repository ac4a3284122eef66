"""Readers, writers, the generator, figures and streams over whole tables."""

from __future__ import annotations

import contextlib
import io
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import figures as G
from tablewright.operators import columns as C
from tablewright.operators.correlate import correlations
from tablewright.operators.roles import Roles, classify
from tablewright.plans import sqltext as S
from tablewright.plans.data_queries import column_specs
from tablewright.plans.shared import shared_dir
from tablewright.plans import table_queries as T
from tablewright.plans.table_queries import VITALS, encounters
from tablewright.plans.tables import table
from tablewright.sources.generator import generate
from tablewright.sources.io import CsvSource, describe_columns, load, source_for, with_row_key, write_frame
from tablewright.streaming.quality import follow_counts, windowed_gaps


def _place(spark: SparkSession, ending: str) -> str:
    return f"{shared_dir(spark).removeprefix('file://')}/tablewright/{uuid.uuid4().hex}/table{ending}"


def _round_trip(ending: str, **options):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = write_frame(table(spark, sf, "clinics").coalesce(2), _place(spark, ending))
        back = source_for(path, **options).read(spark)
        return back.select("clinic_id", "clinic_name", "district", F.col("beds").cast("double").alias("beds"), F.col("opened_on").cast("string").alias("opened_on"))

    return query


def csv_text(spark: SparkSession, sf: str) -> DataFrame:
    """Encounters through CSV as text: quoting, blanks and missing-value spellings."""
    path = write_frame(table(spark, sf, "encounters").select("row_id", *S.LABELS), _place(spark, ".csv"))
    return CsvSource(path).read(spark, as_text=True).select(F.col("row_id").cast("long").alias("row_id"), "X51_visit_type", "X57_payment")


def tsv_source(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, ".tsv")
    table(spark, sf, "nation").write.csv(path, header=True, sep="\t")
    return source_for(path).read(spark).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def load_with_roles(spark: SparkSession, sf: str) -> DataFrame:
    df, roles = load(spark, f"{sf}/encounters.parquet")
    return describe_columns(df.select(*S.FIELDS), roles).select("column_name", "role")


def row_keys(spark: SparkSession, sf: str) -> DataFrame:
    """How often each row number occurs: once."""
    keyed = with_row_key(table(spark, sf, "encounters").select("row_id"))
    return keyed.agg(F.count(F.lit(1)).alias("n"), F.min("_row_id").alias("low"), F.max("_row_id").alias("high"), F.count_distinct("_row_id").alias("n_keys"))


def generated_sample(spark: SparkSession, sf: str) -> DataFrame:
    """As many made-up rows as the table has, judged by their roles."""
    made = generate(spark, table(spark, sf, "encounters").count())
    roles = classify(made)
    return spark.createDataFrame([(c, "numeric" if c in roles.numeric else "categorical") for c in made.columns], "column_name string, role string")


def heatmap_marks(spark: SparkSession, sf: str) -> DataFrame:
    made = correlations(encounters(spark, sf), Roles(tuple(VITALS), ()))
    return G.heatmap_marks(made.pairs, list(made.columns)).withColumn("correlation", F.round("correlation", 6) + F.lit(0.0)).drop("text")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path, schema = f"{sf}/{name}.parquet", table(spark, sf, name).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts kept by a stream over the encounters, then the profile of each load from them."""
    specs = column_specs(spark, sf)
    names = [s.column for s in specs]
    root = _place(spark, "")
    store = C.CountStore(spark, f"{root}/counts", names)
    follow_counts(_stream(spark, sf, "encounters"), "load_id", store, f"{root}/checkpoint").awaitTermination()
    out = C.profile(store.counts(), names, specs)
    return out.select("load_id", C.column_names(F.col("c"), names).alias("column_name"), "row_count", "missing", "distinct_values", "broken")


def stream_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Missing vitals per day of check-in, from a stream without late rows dropped."""
    rows = _stream(spark, sf, "encounters").where("checkin_ts IS NOT NULL").withColumn("at", F.col("checkin_ts").cast("timestamp"))
    view = "gaps_" + uuid.uuid4().hex
    sums = windowed_gaps(rows, "at", ["X20_heart_rate", "X60_sparse"], late="3650 days")
    sums.writeStream.outputMode("complete").format("memory").queryName(view).option("checkpointLocation", _place(spark, "/checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(view).select(F.col("window_start").cast("date").cast("string").alias("day"), "column_name", "rows", "missing")


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """The exit codes of the commands, each over a table with gaps, and of two that must fail."""
    from tablewright import cli
    from tablewright.plans.repair_queries import messy

    source = write_frame(messy(spark, sf).drop("untouched").withColumn("T", (F.col("bal") > 5000).cast("int")), _place(spark, ".parquet"))
    out = _place(spark, "").removesuffix("/table")
    runs = {
        "profile": ["profile", "--save"], "correlate": ["correlate"], "impute": ["impute", "--output", f"{out}/filled.parquet", "--neighbors", "3"], "eda": ["eda", "--skip-tsne"],
        "importance": ["importance", "--target", "T", "--permutation-repeats", "1"], "validate with gaps": ["validate"], "importance without a target": ["importance", "--target", "none"],
    }
    with contextlib.redirect_stdout(io.StringIO()):
        made = [(what, cli.main([*line, "--input", source, "--output-dir", out], spark)) for what, line in runs.items()]
        made.append(("validate", cli.main(["validate", "--input", f"{out}/filled.parquet"], spark)))
    return spark.createDataFrame(made, "command string, code int")


QUERIES = {
    "commands": commands,
    "csv_source": _round_trip(".csv"), "parquet_source": _round_trip(".parquet"), "orc_source": _round_trip(".orc"), "json_source": _round_trip(".json"),
    "csv_text": csv_text, "tsv_source": tsv_source, "load_with_roles": load_with_roles, "row_keys": row_keys, "generated_sample": generated_sample,
    "heatmap_marks": heatmap_marks, "stream_profile": stream_profile, "stream_gaps": stream_gaps,
}

_CLINICS = "select clinic_id, clinic_name, district, beds::double as beds, opened_on::varchar as opened_on from clinics"
_CSV_LOST = "('#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'n/a')"


def _profile_sql() -> str:
    from tablewright.plans.data_queries import _P3_COLUMNS, _lost

    parts = []
    for c, kind in _P3_COLUMNS.items():
        keep = f"case when not {_lost(c, kind)} then {c} end"
        num, lab = (keep, "null::varchar") if kind == "number" else ("null::double", keep)
        parts.append(f"select load_id, '{c}' as column_name, {num} as num, {lab} as lab from encounters")
    return f"""with cells as ({S.union(parts)})
select c.load_id, c.column_name, count(*) as row_count, count(*) - count(num) - count(lab) as missing, count(distinct num) + count(distinct lab) as distinct_values,
  cast(sum(case when num < s.min_value or num > s.max_value or (lab is not null and not list_contains(s.allowed, lab)) then 1 else 0 end) as bigint) as broken
from cells c join column_specs s using (column_name) group by 1, 2"""


SQL = {
    "commands": "select unnest(['profile', 'correlate', 'impute', 'eda', 'importance', 'validate', 'validate with gaps', 'importance without a target']) as command, unnest([0, 0, 0, 0, 0, 0, 1, 2]) as code",
    **dict.fromkeys(("csv_source", "parquet_source", "orc_source", "json_source"), _CLINICS),
    "csv_text": "select row_id, " + ", ".join(f"case when {c} not in {S.TOKENS} and {c} not in {_CSV_LOST} then {c} end as {c}" for c in ("X51_visit_type", "X57_payment")) + " from encounters",
    "tsv_source": "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation",
    "load_with_roles": f"select column_name, role from ({T.SQL['classify_columns']})",
    "generated_sample": f"select column_name, role from ({T.SQL['classify_columns']})",
    "heatmap_marks": f"select feature_2 as row_feature, feature_1 as column_feature, correlation, true as named from ({T.VITAL_PAIRS})",
    "row_keys": "select count(*) as n, 0::bigint as low, count(*) - 1 as high, count(*) as n_keys from encounters",
    "stream_profile": _profile_sql(),
    "stream_gaps": S.union([f"select checkin_ts::date::varchar as day, '{c}' as column_name, count(*) as rows, cast(sum(case when {c} is null or isnan({c}) then 1 else 0 end) as bigint) as missing from encounters where checkin_ts is not null group by 1" for c in ("X20_heart_rate", "X60_sparse")]),
}
