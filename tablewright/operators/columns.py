"""Column profiles from maintained value counts.

A count table holds, for each load and column, the distinct values with the number of rows that have them. Loads enter and
leave it as signed deltas, each appended as it comes; missing shares, distinct counts, ranges, quartiles, entropy, rule
violations and changes between loads all come from the counts and never from the rows again.

Counts are kept as sorted arrays, one row per load, column and batch of rows: forming a delta needs no shuffle, and a value
travels as its eight bytes and not as a row of its own.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.parse import as_number, name, value_missing
from tablewright.plans.shared import fresh_path, over_groups, written

#: n: rows; missing: those without a value; nums and labels: distinct values with their counts. Merged, a value is in
#: one row, values ascend; in deltas it may be in several, and counts may be negative.
COUNTS = "load_id long, c int, n long, missing long, nums array<double>, num_cnts array<long>, labels array<string>, label_cnts array<long>"
#: Order-preserving buckets per natural logarithm of the magnitude, for quartiles.
BUCKETS_PER_LOG = 4096
QUARTILES = ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
#: The values of a column of a load with more rows are merged in several slices, by a hash of the value.
SLICE_ROWS = 1_000_000
#: Values in one row of a slice's counts at most.
CHUNK = 10_000
#: So many segments of a store are merged into one that is as much wider.
SEGMENTS = 16


@dataclass(frozen=True)
class ColumnSpec:
    """What a column may hold: a number within bounds, or one of the allowed labels. None leaves a side open."""

    column: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Thresholds:
    """A finding needs more than these."""

    pattern: float = 0.03
    null_rate: float = 0.15
    median_shift: float = 0.6
    label_shift: float = 0.2


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _read_as_number(c: str, kind: T.DataType) -> Column:
    """Text as the number it spells, dates and times as seconds since 1970; null where that can't be."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), name(c).cast("timestamp_ntz")) / 1e6
    return as_number(name(c), kind)


def delta(df: DataFrame, load: str, columns: list[str], sign: int = 1, as_numbers: tuple[str, ...] = ()) -> DataFrame:
    """Signed value counts (COUNTS) of some rows: +1 to add them, -1 to take them back.

    Numbers keep their value in `nums`; labels, dates and times their text in `labels` (as stored). `c` is the column's place
    in `columns`. Rows without a load count under the null load. Texts and times of `as_numbers` are read as numbers; a text
    that spells none keeps its text, so it isn't missing. Counts are formed per Arrow batch, without a shuffle.
    """
    parts, numbers, labels = [], [], []
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        lost = value_missing(name(c), kind)
        if _is_number(kind):
            parts.append(F.when(~lost, name(c).cast("double")).alias(f"n{i}"))
            numbers.append(i)
            continue
        label = F.when(~lost, name(c).cast("string"))
        if c in as_numbers:
            number = F.when(~lost, _read_as_number(c, kind))
            parts.append(number.alias(f"n{i}"))
            numbers.append(i)
            label = F.when(number.isNull(), label)
        if c not in as_numbers or isinstance(kind, T.StringType):
            parts.append(label.alias(f"l{i}"))
            labels.append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column("load_id").dictionary_encode("encode")
            at, loads = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            rows = np.bincount(at, minlength=len(loads))
            for i in range(len(columns)):
                missing = rows.copy()
                nums, num_cnts = _lists(None, None, None, len(loads), pa.float64())
                texts, text_cnts = _lists(None, None, None, len(loads), pa.string())
                if i in numbers:
                    v = batch.column(f"n{i}").to_numpy(zero_copy_only=False)
                    own, v, cnt = _counted(at[~np.isnan(v)], v[~np.isnan(v)] + 0.0)  # -0.0 and 0.0 are one value
                    np.subtract.at(missing, own, cnt)
                    nums, num_cnts = _lists(own, pa.array(v), cnt * sign, len(loads), pa.float64())
                if i in labels:
                    text = batch.column(f"l{i}").dictionary_encode()
                    code = text.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    own, code, cnt = _counted(at[code >= 0], code[code >= 0])
                    np.subtract.at(missing, own, cnt)
                    texts, text_cnts = _lists(own, text.dictionary.take(pa.array(code)), cnt * sign, len(loads), pa.string())
                yield pa.RecordBatch.from_arrays([loads, pa.array(np.full(len(loads), i, np.int32)), pa.array(rows * sign), pa.array(missing * sign), nums, num_cnts, texts, text_cnts], names=_NAMES)

    return df.select(name(load).cast("long").alias("load_id"), *parts).mapInArrow(run, COUNTS)


_NAMES = ["load_id", "c", "n", "missing", "nums", "num_cnts", "labels", "label_cnts"]


def _counted(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, value, count) of the distinct values of each group, in this order."""
    groups = int(group.max()) + 1 if len(group) else 0
    if groups * 64 < len(group):  # few groups are sorted one after another, which is faster
        order = np.argsort(group, kind="stable")
        group, value = group[order], value[order]
        cuts = np.searchsorted(group, np.arange(1, groups))
        for part in np.split(value, cuts):
            part.sort()
    else:
        order = np.lexsort((value, group))
        group, value = group[order], value[order]
    starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    return group[starts], value[starts], np.diff(np.append(starts, len(value)))


def _lists(group: np.ndarray | None, values: pa.Array | None, counts: np.ndarray | None, groups: int, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """Values and counts as one list per group."""
    if group is None:
        group, values, counts = np.zeros(0, np.int64), pa.array([], kind), np.zeros(0, np.int64)
    offsets = pa.array(np.searchsorted(group, np.arange(groups + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))


@dataclass
class _Merged:
    """The counts of one load and column (or a slice of them) after all deltas."""

    n: int
    missing: int
    v: np.ndarray
    w: np.ndarray
    labels: pa.Array
    lw: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> _Merged:
        v, w, labels, lw = (rows.column(c).combine_chunks().flatten() for c in _NAMES[4:])
        v, w, lw = (a.to_numpy(zero_copy_only=False) for a in (v, w, lw))
        if len(rows) > 1:
            v, w = cls._united(v, w)
        if len(w) and not w.all():
            v, w = v[w != 0], w[w != 0]
        if len(labels):
            coded = labels.dictionary_encode()
            at, lw = cls._united(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lw)
            labels = coded.dictionary.take(pa.array(at[lw != 0]))
            order = pc.array_sort_indices(labels)
            labels, lw = labels.take(order), lw[lw != 0][order.to_numpy()]
        return cls(int(rows.column("n").to_numpy().sum()), int(rows.column("missing").to_numpy().sum()), v, w, labels, lw)

    @staticmethod
    def _united(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(v):
            return v, w
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        return v[starts], np.add.reduceat(w, starts)


_KEYS = ("_load", "c", "slice")


def _grouped(counts: DataFrame) -> tuple[DataFrame, dict[int | None, int]]:
    """(rows, slices of the loads that are sliced). With integer keys without nulls: the null load is 0 with slices below 0. Columns of a load with more than SLICE_ROWS
    rows are cut into slices by a hash of the value; of such loads there is at most one per SLICE_ROWS rows."""
    sizes = counts.groupBy("load_id", "c").agg(F.sum("n").alias("n")).groupBy("load_id").agg(F.max("n").alias("n")).where(F.col("n") > SLICE_ROWS).collect()
    slices = {r.load_id: -(-r.n // SLICE_ROWS) for r in sizes}
    slice_of = lambda s: F.when(F.col("load_id").isNull(), -1 - s).otherwise(s).cast("int").alias("slice")
    key = [F.coalesce("load_id", F.lit(0)).alias("_load"), "c"]
    if not slices:
        return counts.select(*key, slice_of(F.lit(0)), *_NAMES[:1], *_NAMES[2:]), slices

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f: [] for f in ("s", *_NAMES)}
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                load = row.column("load_id")[0].as_py()
                k = slices.get(load, 1)
                made = _Merged.of(pa.Table.from_batches([row]))
                side = _hashed(made.v.view(np.int64)) % k
                lside = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % k for t in made.labels.to_pylist()], np.int64)
                for s in range(k):
                    own, lown = np.flatnonzero(side == s), np.flatnonzero(lside == s)
                    first = s == 0
                    for f, x in zip(out, (s, load, row.column("c")[0].as_py(), made.n if first else 0, made.missing if first else 0, made.v[own], made.w[own], made.labels.take(pa.array(lown)).to_pylist(), made.lw[lown])):
                        out[f].append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))

    hot = F.when(F.col("load_id").isNull(), F.lit(None in slices)).otherwise(F.col("load_id").isin([k for k in slices if k is not None]))
    spread = counts.where(hot).mapInArrow(cut, f"s int, {COUNTS}")
    rest = counts.where(~hot).select(F.lit(0).alias("s"), *_NAMES)
    return rest.unionByName(spread).select(*key, slice_of(F.col("s")), *_NAMES[:1], *_NAMES[2:]), slices


def _hashed(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def merged(counts: DataFrame) -> DataFrame:
    """COUNTS with every value of a load and column in one row only; values whose count returns to zero leave, and so do
    loads without rows."""

    def use(rows: pa.Table) -> pa.RecordBatch:
        m, first = _Merged.of(rows), rows.slice(0, 1)
        gone = m.n == 0 and not len(m.v) and not len(m.labels)
        lists = [_lists(np.zeros(len(a), np.int64), pa.array(a), w, 1, k) for a, w, k in ((m.v, m.w, pa.float64()), (m.labels, m.lw, pa.string()))]
        made = pa.RecordBatch.from_arrays([first.column("load_id").combine_chunks(), first.column("c").combine_chunks(), pa.array([m.n]), pa.array([m.missing]), *lists[0], *lists[1]], names=_NAMES)
        return made.slice(0, 0) if gone else made

    return over_groups(_grouped(counts)[0], _KEYS, COUNTS, use)


@dataclass(frozen=True)
class CountStore:
    """Count tables kept under a path as segments, one per commit: a commit appends the delta and touches nothing else, so its
    cost doesn't depend on the loads before it. SEGMENTS neighbours of one width are merged into one, so that a delta is
    rewritten a logarithmic number of times; segments that a wider one has replaced are removed at the merge after that, when
    nobody reads them any more. Only complete segments count: a commit that is cut short leaves the state before it in force,
    and a new store at the same path goes on from there."""

    spark: SparkSession
    path: str
    columns: list[str]

    def _segments(self) -> list[tuple[int, int]]:
        """(first, last version) of the complete segments."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        done = [n for n in names if n[:1] == "s" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(tuple(map(int, n[1:].split("-"))) for n in done)

    def _live(self) -> list[tuple[int, int]]:
        """The widest segments that cover all versions one after another."""
        every, out, at = self._segments(), [], 1
        while ends := [b for a, b in every if a == at]:
            out.append((at, max(ends)))
            at = max(ends) + 1
        return out

    def version(self) -> int:
        """The number of commits so far."""
        live = self._live()
        return live[-1][1] if live else 0

    def counts(self) -> DataFrame | None:
        """All deltas so far, as they were appended or merged; None before the first."""
        live = self._live()
        return self.spark.read.schema(COUNTS).parquet(*(f"{self.path}/s{a}-{b}" for a, b in live)) if live else None

    def commit(self, *deltas: DataFrame, version: int | None = None) -> DataFrame | None:
        """Append deltas. With a version that is there already (a replayed batch) nothing happens."""
        now = self.version()
        if (now + 1 if version is None else version) > now:
            every = deltas[0]
            for d in deltas[1:]:
                every = every.unionByName(d)
            every.write.mode("overwrite").parquet(f"{self.path}/s{now + 1}-{now + 1 if version is None else version}")
            self._merge()
        return self.counts()

    def _merge(self) -> None:
        live = self._live()
        while len(live) >= SEGMENTS:
            tail = live[-SEGMENTS:]
            widths = [b - a for a, b in tail]
            if max(widths) >= SEGMENTS * (min(widths) + 1):
                return
            replaced = [s for s in self._segments() if s not in live]
            counts = self.spark.read.schema(COUNTS).parquet(*(f"{self.path}/s{a}-{b}" for a, b in tail))
            merged(counts).write.mode("overwrite").parquet(f"{self.path}/s{tail[0][0]}-{tail[-1][1]}")
            for a, b in replaced:
                with contextlib.suppress(Exception):
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/s{a}-{b}")
                    p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            live = self._live()


def temporary_store(spark: SparkSession, columns: list[str]) -> CountStore:
    """A store in the shared folder that goes when the driver ends."""
    return CountStore(spark, fresh_path(spark, "counts"), columns)


def _bucket(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * BUCKETS_PER_LOG)).cast("long")


def quartiles(counts: DataFrame) -> DataFrame:
    """Linearly interpolated quartiles (load_id, c, q1, median, q3) of numeric counts.

    Values are first counted in order-preserving buckets; only buckets that hold a wanted rank are ordered by value, so
    no task ever orders all values of a load that holds a third of the rows.
    """
    key = ["load_id", "c"]
    values = counts.where("num IS NOT NULL").select(*key, _bucket(F.col("num")).alias("b"), "num", "cnt")
    totals = values.groupBy(*key, "b").agg(F.sum("cnt").alias("own"))
    load = Window.partitionBy(*key)
    totals = totals.withColumn("upto", F.sum("own").over(load.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("own").over(load))
    wanted = []
    for i, (q, _) in enumerate(QUARTILES):
        place = (F.col("n") - 1) * F.lit(q)
        wanted += [(f"lo{i}", F.floor(place)), (f"hi{i}", F.ceil(place))]
    totals = totals.withColumns(dict(wanted)).withColumn("before", F.col("upto") - F.col("own"))
    holds = F.lit(False)
    for w, _ in wanted:
        holds = holds | ((F.col(w) >= F.col("before")) & (F.col(w) < F.col("upto")))
    held = totals.where(holds).select(F.col("load_id").alias("_load_id"), F.col("c").alias("_c"), F.col("b").alias("_b"), "n", "before", *(w for w, _ in wanted))
    # the null load has quartiles as well
    near = values.join(held, F.col("load_id").eqNullSafe(F.col("_load_id")) & (F.col("c") == F.col("_c")) & (F.col("b") == F.col("_b"))).drop("_load_id", "_c", "_b")
    inside = Window.partitionBy(*key, "b").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("end", F.col("before") + F.sum("cnt").over(inside))
    at = [F.max(F.when((F.col(w) >= F.col("end") - F.col("cnt")) & (F.col(w) < F.col("end")), F.col("num"))).alias(w) for w, _ in wanted]
    picked = near.groupBy(*key).agg(F.max("n").alias("n"), *at)
    return picked.select(*key, *(_interpolated(i, q).alias(to) for i, (q, to) in enumerate(QUARTILES)))


def _interpolated(i: int, q: float) -> Column:
    place = (F.col("n") - 1) * F.lit(q)
    return F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place - F.floor(place))


_FIGURES = (
    "load_id long, c int, sliced boolean, row_count long, missing long, distinct_values long, numbers long, min_number double, max_number double, min_label string, max_label string, "
    "broken long, clogc double, q1 double, median double, q3 double, nums array<double>, num_cnts array<long>, labels array<string>, label_cnts array<long>"
)
_FIGURE_KINDS = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4, pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
_SHARES = np.array([q for q, _ in QUARTILES])
_FIGURE_NAMES = [f.split()[0] for f in _FIGURES.split(", ")]


def _figures(counts: DataFrame, columns: list[str], specs: list[ColumnSpec] = (), labels: bool = False) -> tuple[DataFrame, bool]:
    """(figures, whether any load is sliced): what a profile needs of each load, column and slice, from one merge of the counts. labels: keep the counts of labels.
    Quartiles are given where a column of a load isn't sliced; where it is, the counts of its numbers are kept for `quartiles`."""
    rules = {columns.index(s.column): s for s in specs}
    rows, slices = _grouped(counts)

    def use(rows: pa.Table) -> list[tuple]:
        m = _Merged.of(rows)
        load, c = rows.column("load_id")[0].as_py(), rows.column("c")[0].as_py()
        sliced = slices.get(load, 1) > 1
        rule, w, broken = rules.get(c), np.concatenate([m.w, m.lw]), 0
        if rule is not None:
            out = np.zeros(len(m.v), bool)
            out |= m.v < rule.low if rule.low is not None else False
            out |= m.v > rule.high if rule.high is not None else False
            broken = int(m.w[out].sum())
            if rule.allowed is not None and len(m.labels):
                broken += int(m.lw[~pc.is_in(m.labels, value_set=pa.array(rule.allowed, pa.string())).to_numpy(zero_copy_only=False)].sum())
        quarts = (None, None, None)
        if len(m.v) and not sliced:
            ends = np.cumsum(m.w)
            at = (ends[-1] - 1) * _SHARES
            down = np.floor(at)
            lo, hi = m.v[np.searchsorted(ends, down, side="right")], m.v[np.searchsorted(ends, np.ceil(at), side="right")]
            quarts = (lo + (hi - lo) * (at - down)).tolist()
        own = [
            load, c, sliced, m.n, m.missing, len(m.v) + len(m.labels), int(m.w.sum()), float(m.v[0]) if len(m.v) else None, float(m.v[-1]) if len(m.v) else None,
            m.labels[0].as_py() if len(m.labels) else None, m.labels[-1].as_py() if len(m.labels) else None, broken, float(w @ np.log(w)) if len(w) else 0.0, *quarts,
        ]
        rows_out = [(*own, m.v[:CHUNK] if sliced else None, m.w[:CHUNK] if sliced else None, m.labels.to_pylist() if labels else None, m.lw if labels else None)]
        # further rows of a slice hold nothing but counts
        for s in range(CHUNK, len(m.v) if sliced else 0, CHUNK):
            rows_out.append((load, c, sliced, 0, 0, 0, 0, None, None, None, None, 0, 0.0, None, None, None, m.v[s : s + CHUNK], m.w[s : s + CHUNK], None, None))
        return rows_out

    return over_groups(rows, _KEYS, _FIGURES, use, pa.schema(list(zip(_FIGURE_NAMES, _FIGURE_KINDS)))), bool(slices)


def _combined(figures: DataFrame, sliced: bool) -> DataFrame:
    """Figures of loads and columns from those of their slices; a sliced column takes its quartiles from all its counts."""
    sums = ("row_count", "missing", "distinct_values", "broken", "numbers", "clogc")
    agg = figures.groupBy("load_id", "c").agg(*(F.sum(f).alias(f) for f in sums), *(f(c).alias(c) for f, c in ((F.min, "min_number"), (F.max, "max_number"), (F.min, "min_label"), (F.max, "max_label"), (F.max, "q1"), (F.max, "median"), (F.max, "q3"))))
    if sliced:
        flat = figures.where("sliced").select("load_id", "c", F.explode(F.arrays_zip("nums", "num_cnts")).alias("x")).select("load_id", "c", F.col("x.nums").alias("num"), F.col("x.num_cnts").alias("cnt"))
        given = quartiles(flat).withColumnsRenamed({"load_id": "_l", "c": "_c"} | {q: f"_{q}" for _, q in QUARTILES})
        agg = agg.join(given, F.col("load_id").eqNullSafe(F.col("_l")) & (F.col("c") == F.col("_c")), "left").withColumns({q: F.coalesce(f"_{q}", q) for _, q in QUARTILES})
    n = (F.col("row_count") - F.col("missing")).cast("double")
    return agg.where("row_count > 0").select(
        "load_id", "c", "row_count", "missing", (F.col("missing") / F.col("row_count")).alias("missing_share"), "distinct_values", "numbers",
        "min_number", "max_number", "min_label", "max_label", "broken",
        F.when(n > 0, F.greatest(F.ln(n) - F.col("clogc") / n, F.lit(0.0))).otherwise(F.lit(0.0)).alias("entropy"), "q1", "median", "q3",
    )


def profile(counts: DataFrame, columns: list[str], specs: list[ColumnSpec] = ()) -> DataFrame:
    """One row per load and column: row_count, missing, missing_share, distinct_values, numbers (rows with one), min and max
    (numbers and labels apart), broken, entropy (in nats, of the present values), q1, median and q3. A column without present
    values has null ranges and quartiles and entropy 0."""
    made, sliced = _figures(counts, columns, specs)
    return _combined(written(made, "figures") if sliced else made, sliced)


def profile_loads(df: DataFrame, load: str, columns: list[str], specs: list[ColumnSpec] = (), as_numbers: tuple[str, ...] = ()) -> DataFrame:
    """profile of a table's loads, through a store of its own."""
    store = temporary_store(df.sparkSession, columns)
    return profile(store.commit(delta(df, load, columns, as_numbers=as_numbers)), columns, specs)


def column_names(c: Column, columns: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, columns)), c + 1)


def label_shift(counts: DataFrame, sizes: DataFrame, successors: DataFrame) -> DataFrame:
    """(load_id, c, shift): half the sum of absolute differences of label shares against the load before. A load's shares
    go to itself as positive and to its successor as negative deltas, so one grouping makes all differences."""
    shares = counts.join(sizes, ["load_id", "c"]).select("load_id", "c", "label", (F.col("cnt") / F.col("n")).alias("share"))
    own = shares.join(successors.select(F.col("next_id").alias("load_id")), "load_id", "left_semi")
    passed = shares.join(successors, "load_id").select(F.col("next_id").alias("load_id"), "c", "label", (-F.col("share")).alias("share"))
    per = own.unionByName(passed).groupBy("load_id", "c", "label").agg(F.sum("share").alias("d"))
    return per.groupBy("load_id", "c").agg((F.sum(F.abs("d")) / 2).alias("shift"))


def load_findings(counts: DataFrame, columns: list[str], specs: list[ColumnSpec], loads: DataFrame, limits: Thresholds = Thresholds(), texts: tuple[str, ...] = ()) -> DataFrame:
    """(load_id, column_name, finding) with finding one of pattern, null_rate, distribution.

    counts are those of a store; loads has load_id, feed_id and seq_no. A load follows the load of its feed whose
    seq_no is one less; where there is none, only `pattern` can be found. Loads or sides without present values have no
    pattern and no distribution finding. Rows under the null load, and loads missing from `loads`, have no predecessor;
    the null load is left out. Repeated rows of loads count once. A text column that was read as numbers (`texts`) shifts by
    its median and, as a label, by its words against all numbers together.
    """
    made, sliced = _figures(counts.where("load_id IS NOT NULL"), columns, specs, labels=True)
    made = written(made, "figures")
    profiles = written(_combined(made, sliced), "profiles")
    labels = made.select("load_id", "c", F.explode(F.arrays_zip("labels", "label_cnts")).alias("x")).select("load_id", "c", F.col("x.labels").alias("label"), F.col("x.label_cnts").alias("cnt"))
    if texts:
        # every number is the label 0, which no text that spells none can be
        spelt = made.where(F.col("c").isin([columns.index(c) for c in texts]) & (F.col("numbers") > 0))
        labels = labels.unionByName(spelt.select("load_id", "c", F.lit("0").alias("label"), F.col("numbers").alias("cnt")))
    return _compared(profiles, labels, columns, successors(loads), limits)


def change_findings(df: DataFrame, load: str, columns: list[str], specs: list[ColumnSpec], loads: DataFrame, as_numbers: tuple[str, ...] = (), limits: Thresholds = Thresholds()) -> DataFrame:
    """The findings of load_findings for the rows of a table, through a store of its own. Texts and times of `as_numbers` are
    compared as numbers."""
    store = temporary_store(df.sparkSession, columns)
    texts = tuple(c for c in columns if c in as_numbers and isinstance(df.schema[c].dataType, T.StringType))
    return load_findings(store.commit(delta(df, load, columns, as_numbers=as_numbers)), columns, specs, loads, limits, texts)


def successors(loads: DataFrame) -> DataFrame:
    """(load_id, next_id): each load and the load of its feed whose seq_no is one more. Repeated rows count once."""
    ids = loads.select(F.col("load_id").cast("long").alias("load_id"), "feed_id", F.col("seq_no").cast("long").alias("seq_no")).dropna().distinct()
    return ids.select("load_id", "feed_id", (F.col("seq_no") + 1).alias("seq_no")).join(ids.select(F.col("load_id").alias("next_id"), "feed_id", "seq_no"), ["feed_id", "seq_no"]).select("load_id", "next_id")


def _compared(profiles: DataFrame, counts: DataFrame, columns: list[str], after: DataFrame, limits: Thresholds) -> DataFrame:
    n = F.col("row_count") - F.col("missing")
    now = profiles.select("load_id", "c", n.alias("n"), "missing_share", "broken", "median")
    before = profiles.join(after, "load_id").select(F.col("next_id").alias("load_id"), "c", n.alias("p_n"), F.col("missing_share").alias("p_share"), F.col("median").alias("p_median"), (F.col("q3") - F.col("q1")).alias("p_iqr"))
    shift = label_shift(counts, profiles.select("load_id", "c", n.alias("n")).where("n > 0"), after)
    both = now.join(before, ["load_id", "c"], "left").join(shift, ["load_id", "c"], "left")
    alive = (F.col("n") > 0) & (F.col("p_n") > 0)
    found = F.array(
        F.when((F.col("n") > 0) & (F.col("broken") / F.greatest("n", F.lit(1)) > limits.pattern), "pattern"),
        F.when(F.abs(F.col("missing_share") - F.col("p_share")) > limits.null_rate, "null_rate"),
        F.when(alive & ((F.abs(F.col("median") - F.col("p_median")) > limits.median_shift * F.col("p_iqr")) | (F.col("shift") > limits.label_shift)), "distribution"),
    )
    return both.select("load_id", column_names(F.col("c"), columns).alias("column_name"), F.explode(F.array_compact(found)).alias("finding"))
