"""Filling missing values by label propagation over shared groups and over similarity.

Records are joined to hubs, one for each value of an edge's key: the same patient, the same department in the same week, or
the same cell of similar readings (`near`), whose records differ by no more than the cell is wide. A hub has the average of
its records' numbers and the distribution of their labels, and a missing value becomes the weighted average of its hubs.
Observed values are clamped: a hub that has any keeps their average. A hub that has none takes the average of what its
records got from their other hubs, at a lower weight, and so on, round by round, until the largest change falls below a bound;
so values reach records whose own groups hold none. The table is prepared and written once; rounds touch nothing but the records of hubs
without observed values, and exchange hubs only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.parse import as_number, label_missing, name
from tablewright.plans import shared
from tablewright.plans.shared import fits_broadcast, sized_join, written

#: The largest change, in deviations of the column or in shares of a label, at which the rounds end; rounds at most.
TOLERANCE, ROUNDS = 0.05, 30
#: What a hub without observed values says is second-hand and has this part of its edge's weight: changes then fade quickly.
SECOND_HAND = 0.1


@dataclass(frozen=True)
class Edge:
    """Records that agree on all `keys` (expressions over the input) vote for one another with this weight."""

    name: str
    keys: tuple[Column, ...]
    weight: float


@dataclass(frozen=True)
class Filled:
    """rows: key, each column filled, `<column>_fill` (null where observed, else the strongest edge with observed values that
    gave the value, `propagated` or `all`). fills: one row per filled value: key, column_name, number, label, source, and
    whether it is `settled`, that is, none of its hubs was without observed values."""

    rows: DataFrame
    fills: DataFrame


def near(column: str, width: float) -> Column:
    """A key for similar readings: records that agree on it are less than `width` apart; null where there is no reading."""
    c = name(column)
    return F.when(~F.isnan(c) & (F.abs(c) < 1e15), F.floor(c / width))


def _hub(df: DataFrame, e: Edge) -> Column:
    """The hub's id; null when a key is missing, so that missing keys bind nobody. A single whole number or date stands for
    itself, other keys for their 64-bit hash."""
    kinds = [f.dataType for f in df.select(*(k.alias(f"k{i}") for i, k in enumerate(e.keys))).schema]
    whole = reduce(lambda a, b: a & b, (k.isNotNull() for k in e.keys))
    if len(kinds) == 1 and isinstance(kinds[0], T.IntegralType):
        return e.keys[0].cast("long")
    if len(kinds) == 1 and isinstance(kinds[0], T.DateType):
        return F.unix_date(e.keys[0]).cast("long")
    return F.when(whole, F.xxhash64(*e.keys))


def fill_missing(
    df: DataFrame, key: str, numbers: list[str], labels: list[str], edges: list[Edge], bounds: dict[str, tuple[float, float]] | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS
) -> Filled:
    """Fill the missing numbers and labels of df; null and NaN numbers and blank or token labels are missing.

    An observed number outside its `bounds` stays as it is but has no vote, so that a broken device can't pull its group away.
    A label fill is the value of the greatest mass, ties to the smallest. If no edge reaches a value, the
    column's mean vote or most frequent label stands in, with source `all`; a column without observed values stays
    missing and unflagged. Rows with equal keys are rows of their own; a null key is a key. Other columns are left out. Empty
    input gives empty results.
    """
    base = df.select(
        F.monotonically_increasing_id().alias("_row"), name(key).alias("_key"),
        *(as_number(name(c), df.schema[c].dataType).alias(f"_n{i}") for i, c in enumerate(numbers)),
        *(F.when(~label_missing(name(c)), name(c)).alias(f"_l{i}") for i, c in enumerate(labels)),
        *(_hub(df, e).alias(f"_h{i}") for i, e in enumerate(edges)),
    )
    base = written(base, "base")
    rows, fills = base, []
    if numbers:
        part = _Numbers(base, numbers, edges, bounds or {}, tolerance, rounds)
        each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_e{i}").alias("number"), F.col(f"_s{i}").alias("source"), F.col(f"_z{i}").alias("settled")) for i, c in enumerate(numbers)))
        fills.append(part.filled.select("_key", F.explode(each).alias("f")).where("f.source IS NOT NULL").select("_key", "f.column_name", "f.number", F.lit(None).cast("string").alias("label"), "f.source", "f.settled"))
        shown = ["_row", "_key", *(f"_l{i}" for i in range(len(labels)))]
        whole = base.where(~part.gap).select(*shown, *(f"_n{i}" for i in part.k), *(F.lit(None).cast("string").alias(f"_s{i}") for i in part.k))
        rows = whole.unionByName(part.filled.select(*shown, *(F.coalesce(f"_n{i}", f"_e{i}").alias(f"_n{i}") for i in part.k), *(f"_s{i}" for i in part.k)))
    for i, c in enumerate(labels):
        part = written(_labels(base, i, edges, tolerance, rounds), "labels")
        fills.append(part.select("_key", F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("number"), "label", "source", "settled"))
        rows = sized_join(rows, part.select("_row", F.col("label").alias(f"_le{i}"), F.col("source").alias(f"_ls{i}")), ["_row"], "left", ["_row"])
    out = [F.col("_key").alias(key)]
    for i, c in enumerate(numbers):
        out += [F.col(f"_n{i}").alias(c), F.col(f"_s{i}").alias(f"{c}_fill")]
    for i, c in enumerate(labels):
        out += [F.coalesce(f"_l{i}", f"_le{i}").alias(c), F.col(f"_ls{i}").alias(f"{c}_fill")]
    return Filled(rows.select(*out), reduce(DataFrame.unionByName, fills).withColumnRenamed("_key", key))


def _met(rows: DataFrame, hubs: DataFrame, on: str | list[str], fits: bool) -> DataFrame:
    """Rows with what their hubs have; fits: whether the hub table may be broadcast. A large hub table is joined by shuffle; adaptive execution splits the tasks of frequent
    hubs, of which the table has one row (or one per label), so that no copies of it are needed."""
    return rows.join(F.broadcast(hubs) if fits else hubs.hint("merge"), on, "left")


def _links(edges: range) -> Column:
    """A row's hubs, (j, h) each. It is exploded whole and then filtered: of a filtered array the size would be asked for first,
    in a filter of its own."""
    return F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"_h{j}").alias("h")) for j in edges))


def _fitting(counts: list, columns: int) -> set[int]:
    """The edges whose hubs, so many rows of numbers, are below the limits of a broadcast."""
    return {r.j for r in counts if r.hubs <= min(shared.MAX_BROADCAST_ROWS, shared.MAX_BROADCAST_BYTES // (8 * columns))}


class _Numbers:
    """filled: the rows with a missing number, with _e (value), _s (source) and _z (settled) of each column that is missing."""

    def __init__(self, base: DataFrame, numbers: list[str], edges: list[Edge], bounds: dict[str, tuple[float, float]], tolerance: float, rounds: int):
        self.edges, self.k = edges, range(len(numbers))
        self.gap = reduce(lambda a, b: a | b, (F.col(f"_n{i}").isNull() for i in self.k))
        limits = [bounds.get(c, (float("-inf"), float("inf"))) for c in numbers]
        self.votes = [F.when(F.col(f"_n{i}").between(*limits[i]), F.col(f"_n{i}")) for i in self.k]
        stats = base.agg(*(f(self.votes[i]).alias(f"{f.__name__}{i}") for i in self.k for f in (F.avg, F.stddev_pop))).first()
        self.mean, self.spread = ([stats[f"{s}{i}"] for i in self.k] for s in ("avg", "stddev_pop"))
        rows = self._anchored(base)
        held = [j for j, n in enumerate(rows.agg(*(F.count(f"_x{j}") for j in range(len(edges)))).first()) if n]
        given = self._propagated(rows, held, tolerance, rounds) if held else {}
        self.filled = self._valued(rows, given)

    def _anchored(self, base: DataFrame) -> DataFrame:
        """Rows with a gap, with the weighted sum (_a) and the weight (_w) of their hubs' averages, the strongest edge with
        observed values (_s), and per edge a hub without votes (_x) with the columns that it lacks as bits (_b)."""
        each = base.select(*(v.alias(f"v{i}") for i, v in enumerate(self.votes)), *(F.col(f"_n{i}").alias(f"n{i}") for i in self.k), F.explode(_links(range(len(self.edges)))).alias("x")).where("x.h IS NOT NULL")
        # combined before the shuffle: a hub of a third of the rows is one row per task there
        hubs = written(each.groupBy("x.j", "x.h").agg(*(F.avg(f"v{i}").alias(f"m{i}") for i in self.k), *(F.count(f"n{i}").alias(f"o{i}") for i in self.k)), "hubs")
        fits = _fitting(hubs.groupBy("j").agg(F.count(F.lit(1)).alias("hubs")).collect(), len(hubs.columns))
        rows = base.where(self.gap)
        for j in range(len(self.edges)):
            own = hubs.where(F.col("j") == j).select(F.col("h").alias(f"_h{j}"), *(F.col(f"m{i}").alias(f"_m{j}_{i}") for i in self.k), *(F.col(f"o{i}").alias(f"_o{j}_{i}") for i in self.k))
            rows = _met(rows, own, f"_h{j}", j in fits)
        out, ranked = {}, sorted(range(len(self.edges)), key=lambda j: -self.edges[j].weight)
        for i in self.k:
            means = [(F.col(f"_m{j}_{i}"), e.weight) for j, e in enumerate(self.edges)]
            out[f"_a{i}"] = reduce(lambda a, b: a + b, (F.coalesce(m * w, F.lit(0.0)) for m, w in means))
            out[f"_w{i}"] = reduce(lambda a, b: a + b, (F.when(m.isNotNull(), F.lit(float(w))).otherwise(0.0) for m, w in means))
            out[f"_s{i}"] = F.when(F.col(f"_n{i}").isNull(), F.coalesce(*(F.when(F.col(f"_o{j}_{i}") > 0, self.edges[j].name) for j in ranked)))
        for j in range(len(self.edges)):
            bits = reduce(lambda a, b: a + b, (F.when(F.col(f"_n{i}").isNull() & F.col(f"_m{j}_{i}").isNull(), F.lit(1 << i)).otherwise(0) for i in self.k))
            lacks = F.col(f"_h{j}").isNotNull() & (bits > 0)
            out[f"_x{j}"], out[f"_b{j}"] = F.when(lacks, F.col(f"_h{j}")), F.when(lacks, bits).otherwise(0)
        kept = [c for c in base.columns if not c.startswith("_h")]
        return written(rows.select(*kept, *(v.alias(c) for c, v in out.items())), "anchored")

    def _estimates(self, rows: DataFrame, given: dict[int, tuple[DataFrame, bool]]) -> tuple[DataFrame, list[Column]]:
        """The value of each column, null where no hub gives one."""
        for j, (hubs, fits) in given.items():
            rows = _met(rows, hubs.select(F.col("h").alias(f"_x{j}"), *(F.col(f"u{i}").alias(f"_u{j}_{i}") for i in self.k)), f"_x{j}", fits)
        out = []
        for i in self.k:
            total, mass = F.col(f"_a{i}"), F.col(f"_w{i}")
            for j in given:
                u = F.when(F.col(f"_b{j}").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"_u{j}_{i}"))
                weight = SECOND_HAND * self.edges[j].weight
                total, mass = total + F.coalesce(u * weight, F.lit(0.0)), mass + F.when(u.isNotNull(), F.lit(weight)).otherwise(0.0)
            out.append(F.when(F.col(f"_n{i}").isNull() & (mass > 0), total / F.when(mass > 0, mass)))
        return rows, out

    def _propagated(self, rows: DataFrame, held: list[int], tolerance: float, rounds: int) -> dict[int, tuple[DataFrame, bool]]:
        """Per edge the values (h, u0, u1, ...) of hubs without votes, and whether they may be broadcast."""
        rows = rows.where(reduce(lambda a, b: a | b, (F.col(f"_x{j}").isNotNull() for j in held)))
        given: dict[int, tuple[DataFrame, bool]] = {}
        bit = lambda i: F.col("x.b").bitwiseAND(F.lit(1 << i)) > 0
        for _ in range(rounds):
            met, value = self._estimates(rows, given)
            before = lambda j, i: F.col(f"_u{j}_{i}") if given else F.lit(None).cast("double")  # noqa: B023, E731
            links = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"_x{j}").alias("h"), F.col(f"_b{j}").alias("b"), *(before(j, i).alias(f"p{i}") for i in self.k)) for j in held))
            each = met.select(*(v.alias(f"v{i}") for i, v in enumerate(value)), F.explode(links).alias("x")).where("x.h IS NOT NULL")
            now = written(each.groupBy("x.j", "x.h").agg(*(F.avg(F.when(bit(i), F.col(f"v{i}"))).alias(f"u{i}") for i in self.k), *(F.max(f"x.p{i}").alias(f"p{i}") for i in self.k)), "empty_hubs")
            change = (F.when(F.col(f"u{i}").isNotNull(), F.coalesce(F.abs(F.col(f"u{i}") - F.col(f"p{i}")) / F.lit(self.spread[i] or 1.0), F.lit(float("inf")))) for i in self.k)
            per_edge = now.groupBy("j").agg(F.count(F.lit(1)).alias("hubs"), F.max(F.greatest(F.lit(0.0), *change)).alias("moved")).collect()
            fits = _fitting(per_edge, len(now.columns))
            given = {j: (now.where(F.col("j") == j), j in fits) for j in held}
            if max(r.moved for r in per_edge) <= tolerance:
                break
        return given

    def _valued(self, rows: DataFrame, given: dict[int, tuple[DataFrame, bool]]) -> DataFrame:
        rows, value = self._estimates(rows, given)
        out = {}
        for i in self.k:
            out[f"_e{i}"] = F.when(F.col(f"_n{i}").isNull(), F.coalesce(value[i], F.lit(self.mean[i]).cast("double")))
            out[f"_z{i}"] = reduce(lambda a, b: a & b, (F.col(f"_b{j}").bitwiseAND(F.lit(1 << i)) == 0 for j in range(len(self.edges))))
            source = F.coalesce(f"_s{i}", F.when(value[i].isNotNull(), F.lit("propagated")).otherwise(F.lit("all")))
            out[f"_s{i}"] = F.when(F.col(f"_n{i}").isNull() & F.lit(self.mean[i] is not None), source)
        kept = [c for c in rows.columns if c[:2] in ("_r", "_k", "_n", "_l")]
        return rows.select(*kept, *(v.alias(c) for c, v in out.items()))


def _labels(base: DataFrame, i: int, edges: list[Edge], tolerance: float, rounds: int) -> DataFrame:
    """(_row, _key, label, source, settled) of the rows whose label i is missing; shares travel as (hub, label, share) rows."""
    links = _links(range(len(edges)))
    weight = F.element_at(F.array(*(F.lit(float(e.weight)) for e in edges)), F.col("j") + 1)
    label, hub = F.col(f"_l{i}"), ["j", "h"]
    counts = base.where(label.isNotNull()).select(F.explode(links).alias("x"), label.alias("label")).where("x.h IS NOT NULL").groupBy("x.j", "x.h", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # a hub's labels, each once
    shares = written(counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*hub))).drop("n"), "shares")
    gaps = base.where(label.isNull())
    spokes = gaps.select("_row", F.explode(links).alias("x")).where("x.h IS NOT NULL").select("_row", "x.j", "x.h")
    met = written(_met(spokes, shares, hub, fits_broadcast(shares)), "spokes")
    anchored = met.where("label IS NOT NULL").select("_row", "label", (weight * F.col("p")).alias("p"), weight.alias("w"))
    empty = met.where("label IS NULL").select("_row", *hub)
    every = anchored
    if not empty.isEmpty():
        given = None
        for _ in range(rounds):
            parts = anchored.select("_row", "label", "p") if given is None else anchored.select("_row", "label", "p").unionByName(empty.join(given, hub).select("_row", "label", (SECOND_HAND * weight * F.col("u")).alias("p")))
            mass = parts.groupBy("_row", "label").agg(F.sum("p").alias("p")).join(empty.select("_row").distinct(), "_row", "left_semi")
            mass = mass.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("_row")))
            reached = empty.join(mass, "_row")
            summed = reached.groupBy(*hub, "label").agg(F.sum("p").alias("s"))
            now = summed.withColumn("u", F.col("s") / F.sum("s").over(Window.partitionBy(*hub))).drop("s")
            now = written(now, "empty_hubs")
            if given is None:
                moved = 1.0
            else:
                change = now.join(given.withColumnRenamed("u", "before"), [*hub, "label"], "full").agg(F.max(F.abs(F.coalesce("u", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))))
                moved = change.first()[0] or 0.0
            given = now
            if moved <= tolerance:
                break
        every = anchored.unionByName(empty.join(given, hub).select("_row", "label", (SECOND_HAND * weight * F.col("u")).alias("p"), F.lit(None).cast("double").alias("w")))
    mass = every.groupBy("_row", "label").agg(F.sum("p").alias("p"), F.max("w").alias("w"))
    best = mass.groupBy("_row").agg(F.min_by("label", F.struct(-F.round("p", 12), F.col("label"))).alias("best"), F.max("w").alias("w"))
    settled = empty.groupBy("_row").agg(F.lit(False).alias("settled"))
    source = F.when(F.col("best").isNotNull(), "propagated").otherwise("all")
    for e in sorted(edges, key=lambda e: e.weight):
        source = F.when(F.col("w") >= float(e.weight), F.lit(e.name)).otherwise(source)
    out = gaps.select("_row", "_key").join(best, "_row", "left").join(settled, "_row", "left")
    top = base.where(label.isNotNull()).groupBy(label.alias("label")).count().orderBy(F.desc("count"), "label").first()
    out = out.select("_row", "_key", F.coalesce("best", F.lit(top and top["label"]).cast("string")).alias("label"), source.alias("source"), F.coalesce("settled", F.lit(True)).alias("settled"))
    return out if top else out.where("false")
