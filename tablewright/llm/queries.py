"""Queries p2, p4, p6, p7, p8 and p9 over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.parse import EDGE_SPACE, MISSING_TOKENS, label_missing
from tablewright.llm import quantiles as Q
from tablewright.llm import vectors as V
from tablewright.llm.clusters import Clustering, cluster_rows, linked_groups
from tablewright.llm.packing import pack_items
from tablewright.llm.splitting import split_documents
from tablewright.llm.tokenizer import count_tokens, default_vocabulary, encode_documents
from tablewright.plans.shared import sized_join, written
from tablewright.plans.tables import table

CONTAINER, PIECE, OVERLAP = 4096, 1024, 64


P2_COLUMNS, PER_MILLE = ["X21_systolic", "X20_heart_rate"], [50, 250, 500, 750, 950]


def department_rows(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """Departments (without edge spaces and letter case, missing ones null), load or day, and the columns."""
    department = F.when(~label_missing(F.col("X50_department")), F.upper(F.regexp_replace("X50_department", EDGE_SPACE, "")))
    keys = {"load": F.col("load_id").alias("load_id"), "day": F.to_date("appt_ts").cast("string").alias("day")}
    return table(spark, sf, "encounters").select(department.alias("department"), keys[unit], *P2_COLUMNS)


def department_summaries(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    return Q.summarise(department_rows(spark, sf, unit), ["department", "load_id" if unit == "load" else "day"], P2_COLUMNS)


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return Q.percentiles(department_summaries(spark, sf, "load"), ["department", "load_id"], PER_MILLE)


def p2_days(spark: SparkSession, sf: str) -> DataFrame:
    return Q.percentiles(department_summaries(spark, sf, "day"), ["department", "day"], PER_MILLE)


def p2_months(spark: SparkSession, sf: str) -> DataFrame:
    """From the summaries of the days, without a look at the rows."""
    days = department_summaries(spark, sf, "day")
    months = Q.merge_summaries(days.withColumn("month", F.substring("day", 1, 7)), ["department", "month"], spread=31)
    return Q.percentiles(months, ["department", "month"], PER_MILLE)


P4_FIELDS, P4_RADIUS, P4_PARTNERS = ["X20_heart_rate", "X22_diastolic", "X25_weight_lb"], 0.35, 5
P6_FIELDS, P6_RADIUS, P6_LEAST = ["X21_systolic", "X23_temperature", "X40_skewed"], 0.5, 5
READINGS, EVERY, NEIGHBOURS = 8, 20, 10


def profile_vectors(spark: SparkSession, sf: str, fields: list[str]) -> DataFrame:
    """The scales, one row per field, are a parameter and small by their nature."""
    scales = {r.field_name: (r.field_name, r.centre, r.spread) for r in table(spark, sf, "vital_scales").where(F.col("field_name").isin(fields)).collect()}
    return V.scaled_vectors(table(spark, sf, "vital_profiles"), "vec_id", [scales[f] for f in fields], READINGS)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    near = V.similar_rows(profile_vectors(spark, sf, P4_FIELDS), P4_PARTNERS, P4_RADIUS)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20, among all rows."""
    rows = profile_vectors(spark, sf, P4_FIELDS)
    near = V.search(rows.where(F.col("id") % EVERY == 0), rows, NEIGHBOURS)
    return near.select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbour"), F.round("distance", 9).alias("distance"))


def clustered_profiles(spark: SparkSession, sf: str) -> Clustering | None:
    return cluster_rows(profile_vectors(spark, sf, P6_FIELDS), limit=(READINGS * len(P6_FIELDS)) ** 0.5)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return linked_groups(profile_vectors(spark, sf, P6_FIELDS), P6_RADIUS, P6_LEAST).select("group_id", F.col("id").alias("vec_id"))


def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every complete row with its cluster, the cluster's size and, for the most typical members, their rank. The readings of a
    cluster of several leaves differ from its centre by one spread in the root mean square at most."""
    made = clustered_profiles(spark, sf)
    if made is None:
        return spark.createDataFrame([], "cluster int, size long, mean_distance double, rank int, vec_id long, distance double")
    return made.divided().withColumnRenamed("id", "vec_id")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"), "doc_id", "text", default_vocabulary())


def packed_documents(spark: SparkSession, sf: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf, "documents"), "doc_id", "text", default_vocabulary())
    return pack_items(sizes, "doc_id", "n_tokens", CONTAINER)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were divided: they alone have a second piece."""
    return packed_documents(spark, sf).where("piece = 1").select("doc_id")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(spark, sf)


def split_posts(spark: SparkSession, sf: str) -> DataFrame:
    return split_documents(table(spark, sf, "documents"), "doc_id", "text", default_vocabulary(), PIECE, OVERLAP)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_posts(spark, sf).where("piece = 0").select("doc_id")


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_posts(spark, sf)


CHECK_SIZES = (64, Q.SIZE)


def p2_departments(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each department from the summaries of its loads, and whether each one's true rank, counted over all rows, is
    within the stated error; with buffers of the usual size, and small ones, which collapse on tables of any size."""
    rows = department_rows(spark, sf, "load")
    parts = []
    for size in CHECK_SIZES:
        loads = Q.summarise(rows, ["department", "load_id"], P2_COLUMNS, size)
        merged = Q.merge_summaries(loads, ["department"], size, spread=int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts.append(Q.percentiles(merged, ["department"], PER_MILLE, size).withColumn("size", F.lit(size)))
    figures = [f"p{p:03d}" for p in PER_MILLE]
    found = written(parts[0].unionByName(parts[1]), "departments")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    held = found.groupBy(key(F.col("department")).alias("_d"), "column_name").agg(*(F.max(F.when(F.col("size") == s, F.struct("n", "rank_error", *figures))).alias(f"s{s}") for s in CHECK_SIZES))
    cells = rows.select(key(F.col("department")).alias("_d"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in P2_COLUMNS))).alias("x")).select("_d", "x.column_name", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    met = sized_join(cells, written(held, "figures"), ["_d", "column_name"], "inner", ["v"])
    out = []
    for s in CHECK_SIZES:
        within = F.lit(True)
        for p in PER_MILLE:
            wanted = F.greatest(F.lit(1), F.floor((F.lit(p) * F.max(f"s{s}.n") + 999) / 1000))
            upto, below = (F.count(F.when(op, 1)) for op in (F.col("v") <= F.col(f"s{s}.p{p:03d}"), F.col("v") < F.col(f"s{s}.p{p:03d}")))
            within = within & (wanted - upto <= F.max(f"s{s}.rank_error")) & (below + 1 - wanted <= F.max(f"s{s}.rank_error"))
        out.append(F.struct(F.lit(s).alias("size"), F.max(f"s{s}.n").alias("n"), (F.max(f"s{s}.rank_error") > 0).alias("collapsed"), within.alias("within")))
    made = met.groupBy("_d", "column_name").agg(F.array(*out).alias("x")).select("_d", "column_name", F.explode("x").alias("x"))
    return made.select(F.when(F.col("_d") != "", F.substring("_d", 2, 1 << 30)).alias("department"), "column_name", "x.size", "x.n", "x.collapsed", "x.within")


def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: the complete rows of p6_clusters, and whether its sizes add up, each row is in the cluster of its nearest leaf, and
    the ranked members are those nearest to the centre."""
    made = clustered_profiles(spark, sf)
    if made is None:
        return spark.createDataFrame([(0, True, True, True)], "n_rows long, sizes_add_up boolean, leaves_are_nearest boolean, typical_are_nearest boolean")
    held = spark.sparkContext.broadcast((made.cells.centres, made.cluster))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, cluster = held.value
        for b in batches:
            x, own = V.matrix(b.column("v")), b.column("cluster").to_numpy()
            fine = np.zeros(len(x), bool)
            for i in range(len(x)):
                d = ((centres - x[i]) ** 2).sum(1)
                fine[i] = d[cluster == own[i]].min() <= d.min() * (1 + 1e-9) + 1e-9
            yield pa.RecordBatch.from_arrays([pa.array([int((~fine).sum())])], names=["wrong"])

    wrong = made.rows.select("v", "cluster").mapInArrow(nearest, "wrong long").agg(F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"))
    per = made.divided().groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("size").alias("least"), F.count("rank").alias("ranked"),
        F.max(F.when(F.col("rank").isNotNull(), F.col("distance"))).alias("far"), F.min(F.when(F.col("rank").isNull(), F.col("distance"))).alias("near"),
    )
    sums = per.agg(
        F.sum("n").alias("n_rows"), F.bool_and((F.col("n") == F.col("size")) & (F.col("n") == F.col("least"))).alias("sizes_add_up"),
        F.bool_and((F.col("ranked") >= F.least(F.col("n"), F.lit(3))) & F.coalesce(F.col("far") <= F.col("near"), F.lit(True))).alias("typical_are_nearest"),
    )
    # two tables of one row
    return sums.join(F.broadcast(wrong)).select("n_rows", "sizes_add_up", (F.col("wrong") == 0).alias("leaves_are_nearest"), "typical_are_nearest")


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every text again from its ids; a null text comes back empty."""
    held = spark.sparkContext.broadcast(default_vocabulary())

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = held.value.tokens
        for batch in batches:
            yield pa.array([b"".join(tokens[i] for i in ids).decode() for ids in batch.to_pylist()], pa.string())

    return p7_ids(spark, sf).select("doc_id", F.arrow_udf(decode, "string")("ids").alias("text"))


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, those with tokens, and whether every token has a place, no container holds more than it can, no document
    is divided that fits, and less than 1 % of the room is left over where there is more than one container."""
    placed = written(p8_containers(spark, sf), "placed")
    sizes = count_tokens(table(spark, sf, "documents"), "doc_id", "text", default_vocabulary())
    per_doc = placed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"), F.max("item_size").alias("item_size"))
    docs = sizes.join(per_doc, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("with_tokens"),
        F.bool_and(F.coalesce((F.col("size") == F.col("n_tokens")) & (F.col("item_size") == F.col("n_tokens")), F.lit(False))).alias("every_token_placed"),
        F.bool_and(F.coalesce((F.col("pieces") == 1) | (F.col("n_tokens") > CONTAINER), F.lit(False))).alias("none_divided_that_fits"),
    )
    per_bin = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("held"), F.max("fill").alias("fill"))
    bins = per_bin.agg(
        F.bool_and((F.col("held") <= CONTAINER) & (F.col("held") == F.col("fill"))).alias("within_capacity"),
        (F.count(F.lit(1)) <= F.ceil(F.sum("held") / (0.99 * CONTAINER)) + 1).alias("little_room_left"),
    )
    return docs.join(F.broadcast(bins))


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, and whether just those above the limit are cut, no piece is above it, neighbours share 64 tokens (up to
    67 inside a character), and the pieces of a document without what they share are its text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pieces = split_posts(spark, sf)
    order = F.array_sort(F.collect_list(F.struct("piece", "start_token", "end_token", "start_char", "end_char", "n_tokens", F.col("text").alias("t"))))
    # the pieces of one document
    per = pieces.groupBy("doc_id").agg(order.alias("x"), F.max("doc_tokens").alias("doc_tokens"))
    shared = F.transform(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), lambda p, i: F.get("x", i)["end_token"] - p["start_token"])
    again = F.array_join(F.transform("x", lambda p, i: F.when(i == 0, p["t"]).otherwise(F.substring(p["t"], F.get("x", i - 1)["end_char"] - p["start_char"] + 1, 1 << 30))), "")
    judged = per.select(
        "doc_id", F.forall("x", lambda p: (p["n_tokens"] <= PIECE) & (p["n_tokens"] == p["end_token"] - p["start_token"])).alias("limit"),
        F.forall(shared, lambda s: (s >= OVERLAP) & (s <= OVERLAP + 3)).alias("share"), again.alias("again"), (F.element_at("x", -1)["end_token"] == F.col("doc_tokens")).alias("ends"),
    )
    sizes = count_tokens(table(spark, sf, "documents"), "doc_id", "text", default_vocabulary())
    all_of = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    return docs.join(sizes, "doc_id").join(judged, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), all_of(F.col("limit").isNotNull() == (F.col("n_tokens") > PIECE)).alias("only_long_ones_cut"),
        all_of(F.col("limit")).alias("within_limit"), all_of(F.col("share")).alias("overlap_kept"), all_of((F.col("again") == F.col("text")) & F.col("ends")).alias("text_covered"),
    )


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_days": p2_days, "p2_months": p2_months, "p2_departments": p2_departments, "p4_found": p4_found, "p4_nearest": p4_nearest, "p6_found": p6_found,
    "p6_clusters": p6_clusters, "p6_checked": p6_checked, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_found": p8_found, "p8_containers": p8_containers, "p8_checked": p8_checked,
    "p9_found": p9_found, "p9_pieces": p9_pieces, "p9_checked": p9_checked,
}

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_BARE = f"regexp_replace(regexp_replace(X50_department, '^{_BLANK}', ''), '{_BLANK}$', '')"
_LOST = ", ".join(sorted({f"'{t.lower()}'" for t in MISSING_TOKENS}))


def _p2_sql(unit: str, name: str) -> str:
    """Exact percentiles; the summaries are exact for groups below their buffer size."""
    picks = ", ".join(f"max(case when rn = greatest(1, ({p} * n + 999) // 1000) then v end) as p{p:03d}" for p in PER_MILLE)
    cells = " union all ".join(f"select case when lower({_BARE}) not in ({_LOST}) then upper({_BARE}) end as department, {unit} as {name}, '{c}' as column_name, {c} as v from encounters where {c} is not null and not isnan({c})" for c in P2_COLUMNS)
    return f"""
with cells as ({cells}),
ranked as (select *, row_number() over (partition by department, {name}, column_name order by v) as rn, count(*) over (partition by department, {name}, column_name) as n from cells)
select department, {name}, column_name, max(n) as n, 0::bigint as rank_error, {picks} from ranked group by 1, 2, 3"""


def _vectors_sql(fields: list[str]) -> str:
    """Complete rows and their scaled readings."""
    fine = " and ".join(f"len({f}) = {READINGS} and list_count({f}) = {READINGS} and len(list_filter({f}, lambda x: isnan(x))) = 0" for f in fields)
    one = ", ".join(f"max(case when field_name = '{f}' then centre end) as c{i}, max(case when field_name = '{f}' then spread end) as s{i}" for i, f in enumerate(fields))
    scaled = " || ".join(f"list_transform({f}, lambda x: (x - c{i}) / s{i})" for i, f in enumerate(fields))
    return f"scales as (select {one} from vital_scales), vecs as materialized (select vec_id, ({scaled})::double[{READINGS * len(fields)}] as v from vital_profiles, scales where {fine})"


def _close_sql(fields: list[str], radius: float) -> str:
    return f"{_vectors_sql(fields)}, close as (select a.vec_id as vec_id_a, b.vec_id as vec_id_b from vecs a join vecs b on a.vec_id < b.vec_id where array_distance(a.v, b.v) <= {radius})"


SQL: dict[str, str] = {
    "p2_percentiles": _p2_sql("load_id", "load_id"),
    "p2_days": _p2_sql("appt_ts::date::varchar", "day"),
    "p2_months": _p2_sql("substr(appt_ts::date::varchar, 1, 7)", "month"),
    "p2_departments": f"""
with cells as ({" union all ".join(f"select case when lower({_BARE}) not in ({_LOST}) then upper({_BARE}) end as department, '{c}' as column_name, {c} as v from encounters where {c} is not null and not isnan({c})" for c in P2_COLUMNS)}),
counted as (select department, column_name, count(*) as n from cells group by 1, 2)
{" union all ".join(f"select department, column_name, {size} as size, n, n // {size} >= {Q.FAN_IN} as collapsed, true as within from counted" for size in CHECK_SIZES)}""",
    "p6_checked": f"with {_vectors_sql(P6_FIELDS)} select count(*) as n_rows, true as sizes_add_up, true as leaves_are_nearest, true as typical_are_nearest from vecs",
    "p7_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    "p8_checked": "select count(*) as documents, count(nullif(text, '')) as with_tokens, true as every_token_placed, true as none_divided_that_fits, true as within_capacity, true as little_room_left from documents",
    "p9_checked": "select count(*) as documents, true as only_long_ones_cut, true as within_limit, true as overlap_kept, true as text_covered from documents",
    "p4_found": f"with {_close_sql(P4_FIELDS, P4_RADIUS)} select * from close",
    "p4_nearest": f"""with {_vectors_sql(P4_FIELDS)},
pairs as (select a.vec_id, b.vec_id as neighbour, array_distance(a.v, b.v) as d from vecs a join vecs b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
ranked as (select *, row_number() over (partition by vec_id order by d, neighbour) as rn from pairs)
select vec_id, rn::int as rank, neighbour, round(d, 9) as distance from ranked where rn <= {NEIGHBOURS}""",
    "p6_found": f"""with recursive {_close_sql(P6_FIELDS, P6_RADIUS)},
links as (select vec_id_a as a, vec_id_b as b from close union all select vec_id_b, vec_id_a from close),
reach(a, b) as (select a, a from links union select r.a, l.b from reach r join links l on r.b = l.a),
grouped as (select a as vec_id, min(b) as group_id, count(*) as n from reach group by 1)
select group_id, vec_id from grouped where n >= {P6_LEAST}""",
}
