"""Queries p1, p3 and p5 over their whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.parse import EDGE_SPACE, MISSING_TOKENS, label_missing, name, value_missing
from tablewright.operators import columns as C
from tablewright.operators.propagate import Edge, Filled, fill_missing, near
from tablewright.operators.rejects import Field, LoadedLines, load_lines
from tablewright.plans import sqltext
from tablewright.plans.shared import sized_join, spread, written
from tablewright.plans.tables import table

_CHECKED = {"X20_heart_rate": (20.0, 300.0), "X23_temperature": (30.0, 45.0), "X24_oxygen_sat": (50.0, 100.0)}
_NAMES = (
    "PAT_ID Y1 Y2 Y3 Y4 Y5 T X_signal X1 X2 X3 X4 X5 X6 X7 X8 X9 X10 X11 X12 X20_heart_rate X21_systolic X22_diastolic "
    "X23_temperature X24_oxygen_sat X25_weight_lb X26_bmi X27_cost X30 X31 X40_skewed X50_department X51_visit_type X52_referral "
    "X53_weekday X54_season X55_weather X56_reminder X57_payment X58_language chk_hour x13 X60_sparse"
).split()


def _kind(column: str) -> str:
    if column == "PAT_ID":
        return "long"
    if column in ("Y5", "T") or column in {f"X{i}" for i in range(1, 13)}:
        return "int"
    return "string" if column[:3] in {f"X5{i}" for i in range(9)} else "double"


def encounter_fields() -> list[Field]:
    return [Field(c, _kind(c), *_CHECKED.get(c, (None, None))) for c in _NAMES]


def loaded_lines(spark: SparkSession, sf: str) -> LoadedLines:
    return load_lines(spread(table(spark, sf, "raw_lines")), "line", encounter_fields())


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return loaded_lines(spark, sf).rejects.select("line_id", "reason")


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers as doubles here, which every client shows alike where there are gaps."""
    shown = [name(c).cast("double").alias(c) if _kind(c) in ("int", "long") else name(c) for c in _NAMES]
    return loaded_lines(spark, sf).records.select("line_id", *shown, F.concat_ws(",", F.map_keys("unparsed")).alias("unparsed_columns"))


def column_specs(spark: SparkSession, sf: str) -> list[C.ColumnSpec]:
    """The rules, one row per column, are a parameter and small by their nature."""
    clean = lambda v: None if v is None or v != v else v
    return [C.ColumnSpec(r.column_name, clean(r.min_value), clean(r.max_value), None if r.allowed is None else tuple(r.allowed)) for r in table(spark, sf, "column_specs").orderBy("column_name").collect()]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    specs = column_specs(spark, sf)
    store = C.temporary_store(spark, [s.column for s in specs])
    counts = store.commit(C.delta(spread(table(spark, sf, "encounters"), "load_id"), "load_id", store.columns))
    return C.load_findings(counts, store.columns, specs, table(spark, sf, "loads"))


def _shown_profile(counts: DataFrame, names: list[str], specs: list[C.ColumnSpec]) -> DataFrame:
    return C.profile(counts, names, specs).select(
        "load_id", C.column_names(F.col("c"), names).alias("column_name"), "row_count", "missing", F.round("missing_share", 9).alias("missing_share"), "distinct_values",
        "min_number", "max_number", "min_label", "max_label", "broken", F.round("entropy", 6).alias("entropy"), *(F.round(q, 9).alias(q) for q in ("q1", "median", "q3")),
    )


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of every column of every load."""
    rows = table(spark, sf, "encounters")
    store = C.temporary_store(spark, [c for c in rows.columns if c != "load_id"])
    return _shown_profile(store.commit(C.delta(spread(rows, "load_id"), "load_id", store.columns)), store.columns, column_specs(spark, sf))


def p3_after_correction(spark: SparkSession, sf: str) -> DataFrame:
    """The profile after a correction: all rows have entered the store, then those of an encounter that was sent again leave by a
    delta of -1, all but the one of the greatest row_id. Only the rows that leave are counted for it."""
    rows = table(spark, sf, "encounters")
    store = C.temporary_store(spark, [c for c in rows.columns if c != "load_id"])
    store.commit(C.delta(spread(rows, "load_id"), "load_id", store.columns))
    ids = rows.where("enc_id IS NOT NULL").groupBy("enc_id").agg(F.max("row_id").alias("last"), F.collect_list("row_id").alias("sent"))  # sendings of one encounter are few
    gone = written(ids.select("last", F.explode("sent").alias("row_id")).where("row_id < last").select("row_id"), "replaced")
    replaced = sized_join(rows, gone, ["row_id"], "left_semi", ["row_id"])
    return _shown_profile(store.commit(C.delta(replaced, "load_id", store.columns, sign=-1)), store.columns, column_specs(spark, sf))


#: Times and numbers kept as text: loads are compared by their medians.
_AS_NUMBERS = ("appt_ts", "checkin_ts", "X23_temperature", "X24_oxygen_sat")


def p3_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of p3_found for every column: the loads in which a column differs from the load before."""
    rows = table(spark, sf, "encounters")
    names = [c for c in rows.columns if c != "load_id"]
    return C.change_findings(spread(rows, "load_id"), "load_id", names, column_specs(spark, sf), table(spark, sf, "loads"), _AS_NUMBERS)


P5_NUMBERS, P5_LABELS = ["X20_heart_rate", "X21_systolic", "X60_sparse"], ["X50_department"]


#: Readings beyond these are a device's and have no vote.
P5_BOUNDS = {"X20_heart_rate": (20.0, 300.0), "X21_systolic": (40.0, 300.0), "X60_sparse": (0.0, 100.0)}


def filled_encounters(spark: SparkSession, sf: str) -> Filled:
    """Votes of the same patient, of records of the same department that are alike in two further readings, of the same
    department in the same week, and of the same week."""
    department, week = F.when(~label_missing(F.col("X50_department")), F.upper(F.regexp_replace("X50_department", EDGE_SPACE, ""))), F.date_trunc("week", F.col("appt_ts")).cast("date")
    alike = (department, near("X22_diastolic", 5.0), near("X25_weight_lb", 10.0))
    edges = [Edge("patient", (F.col("PAT_ID"),), 8.0), Edge("alike", alike, 4.0), Edge("department_week", (department, week), 2.0), Edge("week", (week,), 1.0)]
    return fill_missing(table(spark, sf, "encounters"), "row_id", P5_NUMBERS, P5_LABELS, edges, P5_BOUNDS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return filled_encounters(spark, sf).fills.where("source = 'patient'").select("row_id", "column_name")


def p5_settled(spark: SparkSession, sf: str) -> DataFrame:
    """The filled numbers all of whose groups have observed values: plain weighted averages of their groups'."""
    return filled_encounters(spark, sf).fills.where("settled AND source <> 'all' AND number IS NOT NULL").select("row_id", "column_name", F.round("number", 6).alias("number"), "source")


def p5_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per column: rows, missing ones, those with a fill and a flag, and whether observed values stayed as they were."""
    made, raw = filled_encounters(spark, sf).rows, table(spark, sf, "encounters")
    both = raw.select("row_id", *(F.col(c).alias(f"raw_{c}") for c in (*P5_NUMBERS, *P5_LABELS))).join(made, "row_id")
    parts = []
    for c in (*P5_NUMBERS, *P5_LABELS):
        lost = value_missing(F.col(f"raw_{c}"), raw.schema[c].dataType)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count(F.when(lost, 1)).alias("missing"), F.count(F.when(lost & F.col(c).isNotNull() & F.col(f"{c}_fill").isNotNull(), 1)).alias("filled"),
                              F.bool_and(lost | ((F.col(c) == F.col(f"raw_{c}")) & F.col(f"{c}_fill").isNull())).alias("observed_kept")))
    return both.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def p5_filled(spark: SparkSession, sf: str) -> DataFrame:
    return filled_encounters(spark, sf).rows


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p3_found": p3_found, "p3_profile": p3_profile, "p3_after_correction": p3_after_correction, "p3_changes": p3_changes, "p5_found": p5_found, "p5_settled": p5_settled, "p5_checked": p5_checked, "p5_filled": p5_filled}

_TOKENS = "(" + ", ".join(f"'{t}'" for t in MISSING_TOKENS) + ")"
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_UNQUOTE = "case when starts_with({0}, '\"') then replace(substr({0}, 2, length({0}) - 2), '\"\"', '\"') else {0} end"
_BLANK = r"[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+"
_LABEL_LOST = "({0} is null or lower(regexp_replace(regexp_replace({0}, '^" + _BLANK + "', ''), '" + _BLANK + "$', '')) in ('', 'nan', 'na', 'n/a', 'null', 'none', '-', '--'))"


def _lost(column: str, kind: str) -> str:
    return _LABEL_LOST.format(column) if kind == "label" else f"({column} is null or isnan({column}))"


def _p1_sql() -> str:
    bad = []
    for c, (low, high) in _CHECKED.items():
        v = f"trim({_UNQUOTE.format(f'f[{_NAMES.index(c) + 1}]')}, ' ' || chr(9))"
        bad.append(
            f"({v} not in {_TOKENS} and case when regexp_full_match({v}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then coalesce(try_cast({v} as double), 1e999::double) not between {low} and {high} else true end)"
        )
    return f"""
with checked as (
  select line_id, line, regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') as sound from raw_lines),
parsed as (
  select line_id, line, sound, case when sound then regexp_extract_all(',' || line, '(?s),({_FIELD})', 1) end as f from checked),
judged as (
  select line_id, case when line is null then 'column_count' when not sound then 'quoting' when len(f) <> {len(_NAMES)} then 'column_count'
    when {" or ".join(bad)} then 'value' end as reason from parsed)
select line_id, reason from judged where reason is not null"""


_FINITE = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


def _records_sql() -> str:
    """The same reading of the fields, without a dictionary."""
    raw, typed, lost = [], [], []
    for i, c in enumerate(_NAMES):
        raw.append(f"{_UNQUOTE.format(f'f[{i + 1}]')} as t{i}")
        bare, kind = f"trim(t{i}, ' ' || chr(9) || chr(10) || chr(13))", _kind(c)
        number = f"case when {bare} not in {_TOKENS} and regexp_full_match({bare}, '{_FINITE}') then try_cast({bare} as double) end"
        if kind == "string":
            value = f"case when {bare} not in {_TOKENS} then t{i} end"
        elif kind == "double":
            value = number
        else:
            value = f"try_cast(case when {number} = floor({number}) then {number} end as {'bigint' if kind == 'long' else 'integer'})::double"
        typed.append(f"{value} as {c}")
        if kind != "string":
            lost.append(f"case when {bare} not in {_TOKENS} and ({value}) is null then '{c}' end")
    return f"""
with bad as ({_p1_sql()}),
good as (select line_id, regexp_extract_all(',' || line, '(?s),({_FIELD})', 1) as f from raw_lines where line_id not in (select line_id from bad)),
texts as (select line_id, {", ".join(raw)} from good)
select line_id, {", ".join(typed)}, array_to_string(list_filter([{", ".join(lost)}], lambda x: x is not null), ',') as unparsed_columns from texts"""


def _profile_sql(rows: str = "encounters") -> str:
    """Every column of encounters but load_id, from its values and not from counts."""
    own = {"row_id": "number", "enc_id": "number", "clinic_id": "label", "appt_ts": "time", "checkin_ts": "time"}
    kinds = own | {c: "label" if _kind(c) == "string" or c in ("X23_temperature", "X24_oxygen_sat") else "int" if _kind(c) != "double" else "number" for c in _NAMES}
    parts = []
    for c, kind in kinds.items():
        num, lab = "null::double", "null::varchar"
        if kind == "label":
            lab = f"case when not {_lost(c, 'label')} then {c} end"
        elif kind == "time":
            lab = f"{c}::varchar"
        else:
            num = f"case when not isnan({c}::double) then {c}::double end"
        parts.append(f"select load_id, '{c}' as column_name, {num} as num, {lab} as lab from {rows}")
    return f"""
with cells as ({" union all ".join(parts)}),
counts as (select load_id, column_name, num, lab, count(*) as n from cells group by 1, 2, 3, 4),
spread as (
  select load_id, column_name, sum(n)::double as t, sum(n * ln(n::double)) as s from counts where num is not null or lab is not null group by 1, 2),
prof as (
  select load_id, column_name, count(*) as row_count, count(*) - count(num) - count(lab) as missing, round((count(*) - count(num) - count(lab)) / count(*), 9) as missing_share,
    count(distinct num) + count(distinct lab) as distinct_values, min(num) as min_number, max(num) as max_number, min(lab) as min_label, max(lab) as max_label,
    round(quantile_cont(num, 0.25), 9) as q1, round(quantile_cont(num, 0.5), 9) as median, round(quantile_cont(num, 0.75), 9) as q3 from cells group by 1, 2),
broken as (
  select load_id, column_name, cast(sum(case when num < s.min_value or num > s.max_value or (lab is not null and not list_contains(s.allowed, lab)) then 1 else 0 end) as bigint) as broken
  from cells join column_specs s using (column_name) group by 1, 2)
select p.*, coalesce(b.broken, 0) as broken, coalesce(round(greatest(ln(t) - s / t, 0), 6), 0) as entropy
from prof p left join spread e on e.load_id = p.load_id and e.column_name = p.column_name left join broken b on b.load_id = p.load_id and b.column_name = p.column_name"""


_P3_COLUMNS = {"X60_sparse": "number", "X40_skewed": "number", "x13": "number", "X56_reminder": "label"}


def _p3_sql(columns: dict[str, str], numbers: dict[str, str] | None = None) -> str:
    """columns: kind of each; numbers: how times and texts are read as numbers. A text shifts as a label, all its numbers being one."""
    parts = []
    for c, kind in columns.items():
        num = lab = word = "null"
        if kind == "number":
            num = f"case when not isnan({c}::double) then {c}::double end"
        elif kind == "time":
            num = numbers[c]
        elif kind == "text":
            num = f"case when not {_lost(c, 'label')} then {numbers[c]} end"
            lab = f"case when not {_lost(c, 'label')} and ({num}) is null then {c} end"
            word = f"case when ({num}) is not null then '0' else {lab} end"
        else:
            lab = word = f"case when not {_lost(c, 'label')} then {c} end"
        parts.append(f"select load_id, '{c}' as column_name, ({num})::double as num, ({lab})::varchar as lab, ({word})::varchar as word from encounters")
    return f"""
with cells as ({" union all ".join(parts)}),
prof as (
  select e.load_id, e.column_name, count(*)::double as n_rows, count(num) + count(lab) as n,
    sum(case when num < s.min_value or num > s.max_value or (lab is not null and not list_contains(s.allowed, lab)) then 1 else 0 end)::double as broken,
    quantile_cont(num, 0.25) as q1, quantile_cont(num, 0.5) as med, quantile_cont(num, 0.75) as q3
  from cells e left join column_specs s using (column_name) where e.load_id is not null group by 1, 2),
nxt as (select a.load_id as prev_id, b.load_id from loads a join loads b on a.feed_id = b.feed_id and b.seq_no = a.seq_no + 1),
shares as (select c.load_id, c.column_name, word, count(*) / max(p.n)::double as share from cells c join prof p using (load_id, column_name) where word is not null group by 1, 2, 3),
diffs as (
  select load_id, column_name, word, sum(share) as d from (
    select load_id, column_name, word, share from shares
    union all select nxt.load_id, column_name, word, -share from shares join nxt on nxt.prev_id = shares.load_id) group by 1, 2, 3),
shift as (select load_id, column_name, sum(abs(d)) / 2 as shift from diffs group by 1, 2),
both_ as (
  select a.*, b.n as p_n, b.n_rows as p_rows, b.med as p_med, b.q3 - b.q1 as p_iqr, (b.load_id is not null) as has_prev, shift
  from prof a left join nxt on nxt.load_id = a.load_id left join prof b on b.load_id = nxt.prev_id and b.column_name = a.column_name
  left join shift on shift.load_id = a.load_id and shift.column_name = a.column_name)
select load_id, column_name, 'pattern' as finding from both_ where n > 0 and broken / n > 0.03
union all select load_id, column_name, 'null_rate' from both_ where has_prev and abs((n_rows - n) / n_rows - (p_rows - p_n) / p_rows) > 0.15
union all select load_id, column_name, 'distribution' from both_ where has_prev and n > 0 and p_n > 0 and (abs(med - p_med) > 0.6 * p_iqr or shift > 0.2)"""


def _changes_sql() -> str:
    kinds = {"row_id": "number", "enc_id": "number", "clinic_id": "label", "appt_ts": "time", "checkin_ts": "time"} | {c: "text" if c in _AS_NUMBERS else "label" if _kind(c) == "string" else "number" for c in _NAMES}
    numbers = {c: f"epoch_us({c}) / 1e6" for c in ("appt_ts", "checkin_ts")} | {c: sqltext.number(c) for c in ("X23_temperature", "X24_oxygen_sat")}
    return _p3_sql(kinds, numbers)


def _p5_sql() -> str:
    return " union all ".join(
        f"select row_id, '{c}' as column_name from (select row_id, {_lost(c, kind)} as lost, PAT_ID, count(case when not {_lost(c, kind)} then 1 end) over (partition by PAT_ID) as seen from encounters) where lost and seen > 0 and PAT_ID is not null"
        for c, kind in (*((c, "number") for c in P5_NUMBERS), *((c, "label") for c in P5_LABELS))
    )


def _p5_settled_sql() -> str:
    """Averages of the groups from the rows; a fill counts if every group that it is in has votes."""
    bare = f"regexp_replace(regexp_replace(X50_department, '^{_BLANK}', ''), '{_BLANK}$', '')".format()
    keys = {"patient": ("p", 8.0), "alike": ("case when d is not null and a is not null and b is not null then (d, a, b) end", 4.0), "department_week": ("case when d is not null and w is not null then (d, w) end", 2.0), "week": ("w", 1.0)}
    parts = []
    for c in P5_NUMBERS:
        low, high = P5_BOUNDS[c]
        vote = f"case when {c} between {low} and {high} and not isnan({c}) then {c} end"
        seen = f"case when {c} is not null and not isnan({c}) then 1 end"
        hubs = ", ".join(f"{k} as k{j}, avg({vote}) over (partition by {k}) as m{j}, count({seen}) over (partition by {k}) as o{j}" for j, (k, _) in enumerate(keys.values()))
        fine = " and ".join(f"(k{j} is null or m{j} is not null)" for j in range(len(keys)))
        total = " + ".join(f"case when k{j} is not null then m{j} * {w} else 0 end" for j, (_, w) in enumerate(keys.values()))
        mass = " + ".join(f"case when k{j} is not null then {w} else 0 end" for j, (_, w) in enumerate(keys.values()))
        source = " ".join(f"when k{j} is not null and o{j} > 0 then '{n}'" for j, n in enumerate(keys))
        parts.append(f"select row_id, '{c}' as column_name, round(({total}) / nullif({mass}, 0), 6) as number, case {source} end as source from (select row_id, {seen} as s, {hubs} from keyed) where s is null and {fine} and ({mass}) > 0")
    return f"""
with keyed as (
  select row_id, {", ".join(P5_NUMBERS)}, PAT_ID as p, case when not {_lost("X50_department", "label")} then upper({bare}) end as d, date_trunc('week', appt_ts)::date as w,
    case when not isnan(X22_diastolic) then floor(X22_diastolic / 5) end as a, case when not isnan(X25_weight_lb) then floor(X25_weight_lb / 10) end as b from encounters)
{" union all ".join(parts)}"""


def _p5_checked_sql() -> str:
    kinds = (*((c, "number") for c in P5_NUMBERS), *((c, "label") for c in P5_LABELS))
    return " union all ".join(f"select '{c}' as column_name, count(*) as rows, count(*) filter ({_lost(c, k)}) as missing, count(*) filter ({_lost(c, k)}) as filled, true as observed_kept from encounters" for c, k in kinds)


SQL = {"p1_found": _p1_sql(), "p1_records": _records_sql(), "p3_profile": _profile_sql(), "p3_after_correction": _profile_sql("(from encounters qualify enc_id is null or row_id = max(row_id) over (partition by enc_id))"), "p3_found": _p3_sql(_P3_COLUMNS), "p3_changes": _changes_sql(), "p5_found": _p5_sql(), "p5_settled": _p5_settled_sql(), "p5_checked": _p5_checked_sql()}
