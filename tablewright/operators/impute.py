"""Repairing a table: nearest neighbours for numbers, the most frequent value for labels, and a full account of it.

Fitting is a handful of aggregates; the fitted statistics are literals of a lazy projection, so that a fit on one table can
be applied to another. The neighbour fill compares rows with gaps against all rows in blocks: a task holds a slice of the rows
with gaps, of like cells, and lets the donors pass by, read from the written table and not shuffled. What the donors of a cell have in
common leaves most rows out, a masked matrix product finds the pairs that are near enough, and the task keeps k donors per gap. A
sample of rows, from which the cells are made, is all that the driver sees.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.config import ImputationConfig, SchemaConfig
from tablewright.functions.parse import as_number, is_blank, name, null_if_token
from tablewright.functions.stats import melt, wide_row
from tablewright.operators.columns import quartiles
from tablewright.operators.roles import Roles, classify, coerce
from tablewright.plans.shared import numbered_in_order, written

#: Rows with gaps that a task holds; donors compared with them at a time; rows of a cell; rows from which cells are made; rows that a first guess looks at.
SLICE, BLOCK, LEAF, SAMPLE, NEAR = 18_000, 1024, 512, 40_000, 1536
#: Keys that repeat, up to which the others are finished in their tasks.
MOST_AGAIN = 100_000
#: Room for the rounding of a product, as a share of its squares.
EPS = {np.float32: 3e-5, np.float64: 1e-12}


def medians(view: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians from value counts; no task holds all values of a column."""
    counts = melt(view, columns, [name(c) for c in columns], "double").where("value IS NOT NULL").groupBy("pos", "value").agg(F.count(F.lit(1)).alias("cnt"))
    found = {r.c: r["median"] for r in quartiles(counts.select(F.lit(0).cast("long").alias("load_id"), F.col("pos").alias("c"), (F.col("value") + 0.0).alias("num"), "cnt")).collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def modes(view: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value that isn't null or blank, ties to the smallest."""
    if not columns:
        return {}
    counts = melt(view, columns, [name(c) for c in columns], "string").where(~is_blank(F.col("value"))).groupBy("pos", "value").count()
    best = counts.groupBy("pos").agg(F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("b")).select("pos", "b.value")
    found = {r.pos: r.value for r in best.collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


@dataclass(frozen=True)
class NumericStats:
    """Of one column: median, mean and population deviation after the median fill, mean of the observed, all whole?"""

    median: float | None
    mean: float = 0.0
    sd: float = 1.0
    observed_mean: float | None = None
    whole: bool = False


def scaler_stats(view: DataFrame, columns: list[str]) -> dict[str, NumericStats]:
    """view: the columns as doubles, null where missing."""
    if not columns:
        return {}
    med = medians(view, columns)
    asked = {}
    for i, c in enumerate(columns):
        filled = F.coalesce(name(c), F.lit(med[c]).cast("double"))
        asked |= {f"m{i}": F.avg(filled), f"s{i}": F.stddev_pop(filled), f"o{i}": F.avg(name(c)), f"w{i}": F.bool_and(name(c) == F.floor(name(c)))}
    row = wide_row(view, asked)
    return {c: NumericStats(med[c], row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0, row[f"o{i}"], bool(row[f"w{i}"])) for i, c in enumerate(columns)}


def numeric_view(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(name(key).alias("_key"), *(as_number(name(c), df.schema[c].dataType).alias(c) for c in columns))


def neighbour_fills(view: DataFrame, columns: list[str], stats: dict[str, NumericStats], k: int, weights: str, distance_columns: list[str] | None = None) -> DataFrame:
    """(_key, pos, value): a value for every gap that some donor has a distance to.

    Distance: over the shared columns, scaled, times all columns / shared ones, rounded to 9 decimals; ties to the smaller
    key. weights 'distance': 1/d, or the donors at distance 0 alone if there are any; 'uniform': the mean. Rows without a key
    neither give nor get. Rows are divided into cells of like ones; the cells decide which pairs need not be compared and
    nothing else. All rows are read once per SLICE rows with gaps and are never copied to disk for it; a task holds a slice of
    neighbouring cells and the k donors of its gaps.
    """
    usable = [c for c in columns if stats[c].median is not None]
    inside = [c for c in usable if distance_columns is None or c in distance_columns]
    if not usable:
        return view.sparkSession.createDataFrame([], "_key long, pos int, value double")
    packed = F.array(*(F.coalesce(name(c), F.lit(float("nan"))) for c in usable))
    rows = written(view.where("_key IS NOT NULL").select(F.col("_key").cast("long").alias("_key"), packed.alias("x")), "rows")
    n, gaps = rows.agg(F.count(F.lit(1)), F.count(F.when(F.exists("x", F.isnan), 1))).first()
    scale = Scale(np.array([stats[c].mean for c in usable]), np.array([stats[c].sd or 1.0 for c in usable]), np.array([c in inside for c in usable]))
    few = rows.where(F.pmod(F.xxhash64("_key"), F.lit(max(1, n // SAMPLE))) == 0).select("x").limit(2 * SAMPLE).collect()
    # a slice for every core, again and again; few rows with gaps are divided further, so that there is work for every core
    cores = view.sparkSession.sparkContext.defaultParallelism
    slices = -(-gaps // (SLICE * cores)) * cores if gaps > SLICE * cores else max(1, -(-gaps // SLICE), min(cores, -(-gaps // 64)))
    parts = max(1, -(-n // 50_000))
    cells = Cells.of(np.array([r.x for r in few], np.float64).reshape(len(few), len(usable)), scale, n, slices)
    celled = rows.mapInArrow(_into_cells(scale, cells, parts), "part int, c int, _key long, x array<double>").repartitionById(parts, "part").sortWithinPartitions("c")
    donors = written(celled.mapInArrow(_packed(cells), "s int, c binary, keys binary, x binary"), "donors")
    slots = donors.repartitionById(slices, "s").mapInArrow(_held_together, "slot int, mine binary, codes binary, gappy binary")
    # the one partition of donors passes every partition of a slice, whose rows come along with the first row
    passing = donors.coalesce(1).withColumn("first", F.monotonically_increasing_id() == 0).crossJoin(slots.hint("shuffle_replicate_nl"))
    met = passing.select(*(F.when(F.col("first"), F.col(c)).alias(c) for c in ("slot", "mine", "codes", "gappy")), "s", "c", "keys", "x")
    again = {r._key for r in rows.groupBy("_key").count().where("count > 1").select("_key").limit(MOST_AGAIN + 1).collect()}
    # a key that repeats has the nearest donors of all its rows: those are joined up here, others are finished in their task
    once = None if len(again) > MOST_AGAIN else np.array(sorted(again), np.int64)
    found = met.mapInArrow(_donors(scale, cells, k, weights, once, BLOCK), "_key long, pos int, d double, donor long, value double")
    places = F.element_at(F.array(*(F.lit(columns.index(c)) for c in usable)), F.col("pos") + 1)
    if not again:
        return found.select("_key", places.alias("pos"), "value")
    found = written(found, "found")
    nearest = Window.partitionBy("_key", "pos").orderBy("d", "donor")
    chosen = found.where("d IS NOT NULL").withColumn("_rn", F.row_number().over(nearest)).where(F.col("_rn") <= k)
    if weights == "uniform":
        value = F.avg("value")
    else:
        zero = F.avg(F.when(F.col("d") == 0, F.col("value")))
        w = F.when(F.col("d") > 0, 1 / F.when(F.col("d") > 0, F.col("d")))
        value = F.coalesce(zero, F.sum(w * F.col("value")) / F.sum(w))
    joined = chosen.groupBy("_key", "pos").agg(value.alias("value"))
    return found.where("d IS NULL").select("_key", "pos", "value").unionByName(joined).withColumn("pos", places)


@dataclass(frozen=True)
class Scale:
    """mean and deviation of every column, and which ones a distance looks at."""

    mean: np.ndarray
    sd: np.ndarray
    use: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """NaN where missing or not looked at."""
        return np.where(self.use, (x - self.mean) / self.sd, np.nan)


@dataclass(frozen=True)
class Cells:
    """A tree (feature, cut, below, above, missing) whose leaves are numbered. Features are the scaled columns; those without
    gaps (whole) are turned to the directions of their variance, which keeps distances.

    sparse: columns that most rows lack; rows of a leaf are divided by which of those they have. few: features of few values;
    cuts: others by which the tree divides. upto: the share of rows before each leaf. first, span: of a leaf, its first slice
    and among how many its rows are dealt out."""

    features: int
    whole: np.ndarray
    turn: np.ndarray
    tree: tuple | int
    sparse: list[int]
    few: list[int]
    cuts: list[int]
    upto: np.ndarray
    first: np.ndarray
    span: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, scale: Scale, n: int, slices: int) -> Cells:
        gone = np.isnan(x)
        whole = np.flatnonzero(scale.use & ~gone.any(0)) if len(x) > 1 else np.empty(0, int)
        turn = np.eye(len(whole))
        if len(whole) > 1:
            z = np.clip(scale.scaled(x)[:, whole], -10, 10)
            if np.isfinite(z).all():
                turn = np.linalg.eigh(np.cov(z.T))[1][:, ::-1]
        draft = cls(x.shape[1], whole, turn, 0, [], [], [], *[np.empty(0)] * 3)
        f = draft.spread(x, scale)
        few = [int(c) for c in np.flatnonzero(scale.use) if len(np.unique(f[~np.isnan(f[:, c]), c])) <= 16]
        # a cut between few values says all about them
        worth = np.where(np.isin(np.arange(f.shape[1]), few), 2.0, 1.0)
        tree, leaves, used = _tree(f, max(2, -(-LEAF * len(x) // max(n, 1))), worth)
        lacking = gone.mean(0) if len(x) else np.zeros(x.shape[1])
        sparse = sorted(np.argsort(-lacking, kind="stable")[:3][np.sort(-lacking)[:3] < -0.5].tolist())
        cuts = [c for c in sorted(used, key=lambda c: -used[c]) if c not in few][:2]
        # like cells have neighbouring numbers, so that a slice is of like rows
        leaf = _leaf_of(f, tree)
        upto, edge = (np.append(0, np.cumsum(np.bincount(leaf, w, leaves) + 1e-9)) for w in (None, gone.any(1)))
        edge *= slices / edge[-1]
        first = np.minimum(edge[:-1] + 1e-6, slices - 1).astype(int)
        span = np.maximum(np.round(np.diff(edge)).astype(int), 1)
        return cls(x.shape[1], whole, turn, tree, sparse, few, cuts, upto / upto[-1], first, np.minimum(span, slices - first))

    @property
    def others(self) -> np.ndarray:
        return np.delete(np.arange(self.features), self.whole)

    def turned(self, z: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features from scaled columns (columns first), 0 where missing, and where they are seen."""
        if not len(self.whole):
            return z, seen
        f, there, all_ = z.copy(), seen.copy(), seen[self.whole].all(0)
        f[self.whole] = np.where(all_, self.turn.T @ z[self.whole], 0.0)
        there[self.whole] = all_
        return f, there

    def spread(self, x: np.ndarray, scale: Scale) -> np.ndarray:
        z = scale.scaled(x).T
        f, there = self.turned(np.where(np.isnan(z), 0.0, z), ~np.isnan(z))
        return np.where(there, f, np.nan).T

    def place(self, x: np.ndarray, scale: Scale) -> np.ndarray:
        has = sum((~np.isnan(x[:, c])).astype(np.int32) << i for i, c in enumerate(self.sparse))
        return _leaf_of(self.spread(x, scale), self.tree) << len(self.sparse) | has


def _tree(z: np.ndarray, least: int, worth: np.ndarray) -> tuple[tuple | int, int, dict[int, float]]:
    """A tree over a sample, down to `least` rows: by the feature whose cut at its mean takes away most of the variance. The
    second is the number of leaves, the third what cuts by a feature took away."""
    numbers, used = iter(range(1 << 28)), {}

    def grown(z: np.ndarray, depth: int) -> tuple | int:
        if len(z) <= least or depth > 40:
            return next(numbers)
        seen = np.isfinite(z)
        y = np.where(seen, np.clip(z, -10, 10), 0.0)
        have = seen.sum(0)
        cut = y.sum(0) / np.maximum(have, 1)
        low = seen & (y <= cut)
        left = low.sum(0)
        right = have - left
        apart = np.where(seen & ~low, y, 0.0).sum(0) / np.maximum(right, 1) - np.where(low, y, 0.0).sum(0) / np.maximum(left, 1)
        won = left * right / np.maximum(have, 1) * apart**2 * worth
        c = int(np.argmax(won))
        if not won[c] > 0:
            return next(numbers)
        used[c] = used.get(c, 0.0) + float(won[c])
        return c, float(cut[c]), grown(z[low[:, c]], depth + 1), grown(z[seen[:, c] & ~low[:, c]], depth + 1), grown(z[~seen[:, c]], depth + 1)

    return grown(z, 0), next(numbers), used


def _leaf_of(z: np.ndarray, tree: tuple | int) -> np.ndarray:
    seen = np.isfinite(z)
    out, todo = np.zeros(len(z), np.int32), [(tree, np.arange(len(z)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            here, low = seen[at, node[0]], np.clip(z[at, node[0]], -10, 10) <= node[1]
            todo += [(node[2], at[here & low]), (node[3], at[here & ~low]), (node[4], at[~here])]
    return out


def _into_cells(scale: Scale, cells: Cells, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            c = cells.place(x, scale)
            part = np.minimum(cells.upto[c >> len(cells.sparse)] * parts + 1e-9, parts - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(c, pa.int32()), batch.column("_key"), batch.column("x")], names=["part", "c", "_key", "x"])

    return run


def _blobs(names: tuple[str, ...], slices: list[int], blobs: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names=[*names])


def _packed(cells: Cells):
    """Rows of neighbouring cells and of one slice as one row, column after column: a column of like values takes little room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for batch in batches:
            if not len(batch):
                continue
            c, keys = batch.column("c").to_numpy(), batch.column("_key").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            leaf, dealt = c >> len(cells.sparse), dealt + 1
            s = cells.first[leaf] + dealt % cells.span[leaf]
            cuts = np.flatnonzero(np.diff(s, prepend=-1))
            at = list(zip(cuts, [*cuts[1:], len(s)]))
            yield _blobs(("s", "c", "keys", "x"), s[cuts].tolist(), [[v[b:e].T.tobytes() for b, e in at] for v in (c, keys, x)])

    return run


def _held_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition as one row, like cells one after another."""
    got = [(s, c, keys, x) for batch in batches for s, c, keys, x in zip(*(batch.column(v) for v in ("s", "c", "keys", "x")))]
    if got:
        c = np.concatenate([np.frombuffer(g[1].as_buffer(), np.int32) for g in got])
        keys, x = zip(*(_unpacked(*g[2:]) for g in got))
        order = np.argsort(c, kind="stable")
        out = [[np.concatenate(keys)[order].tobytes()], [c[order].tobytes()], [np.concatenate(x, axis=1)[:, order].tobytes()]]
        yield _blobs(("slot", "mine", "codes", "gappy"), [got[0][0].as_py()], out)


def _unpacked(keys: pa.BinaryScalar, x: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """Keys; values, columns first."""
    keys = np.frombuffer(keys.as_buffer(), np.int64)
    return keys, np.frombuffer(x.as_buffer()).reshape(-1, len(keys))


def _bits(a: np.ndarray) -> np.ndarray:
    """Truth values, columns first, as 64 bits a word."""
    packed = np.packbits(a, axis=0)
    return np.vstack([packed, np.zeros((-len(packed) % 8, a.shape[1]), np.uint8)]).T.copy().view(np.uint64)


def _stacked(parts: list[np.ndarray], kind: type) -> np.ndarray:
    """One under another, of one type and without a copy of a wider one."""
    parts = [np.atleast_2d(v) for v in parts]
    out, at = np.empty((sum(map(len, parts)), parts[0].shape[1]), kind), 0
    for v in parts:
        out[at : at + len(v)] = v
        at += len(v)
    return out


class _Block:
    """Rows of neighbouring cells, columns first, and their cells' stretches (of `most` rows at most)."""

    def __init__(self, c: np.ndarray, keys: np.ndarray, x: np.ndarray, scale: Scale, cells: Cells, most: int):
        self.c, self.keys, self.x, self.cells = c, keys, x, cells
        self.has = ~np.isnan(x)
        self.seen = self.has & scale.use[:, None]
        self.z = x - scale.mean[:, None]
        self.z /= scale.sd[:, None]
        self.z[~self.seen] = 0.0
        self.f, self.there = cells.turned(self.z, self.seen)
        self.largest = max(np.abs(self.z).max(initial=0.0), np.abs(self.f).max(initial=0.0))
        self.zz = (self.f * self.f).sum(0)
        cuts = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
        self.starts = np.concatenate([np.arange(s, e, most) for s, e in zip(cuts, [*cuts[1:], len(c)])])
        self.ends = np.append(self.starts[1:], len(c))
        self.which = c[self.starts] & (1 << len(cells.sparse)) - 1
        self.by_row: tuple[np.ndarray, ...] | None = None

    def sides(self, kind: type) -> np.ndarray:
        """Against the rows of `left`: sums of squares over the features that both have. Columns without gaps need one square."""
        w, o = self.cells.whole, self.cells.others
        return _stacked([self.there[o], self._whole(self.there), self.f[o] ** 2, (self.f[w] ** 2).sum(0), self.f, -EPS[kind] * self.zz], kind)

    def _whole(self, there: np.ndarray) -> np.ndarray:
        w = self.cells.whole
        return there[w[0]] if len(w) else np.zeros(there.shape[1], bool)

    def bounds(self, features: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of every stretch; unbounded if a row lacks the feature."""
        whole = np.logical_and.reduceat(self.there[features], self.starts, axis=1)
        low, high = (by.reduceat(self.f[features], self.starts, axis=1) for by in (np.minimum, np.maximum))
        return np.where(whole, low, -np.inf), np.where(whole, high, np.inf)

    def rows(self) -> tuple[np.ndarray, ...]:
        if self.by_row is None:
            self.by_row = self.z.T.copy(), self.seen.T.copy(), self.has.T.copy(), _bits(self.seen), _bits(self.has)
        return self.by_row


class _Receivers:
    """Rows with gaps of neighbouring cells, and the k nearest donors of each gap so far."""

    def __init__(self, own: _Block, scale: Scale, cells: Cells, k: int):
        mine = np.flatnonzero(~own.has.all(0))
        self.keys, self.k, self.cells, self.p, self.all = own.keys[mine], k, cells, len(own.x), int(scale.use.sum())
        self.z, self.seen, self.gap = own.z[:, mine].T.copy(), own.seen[:, mine].T.copy(), ~own.has[:, mine].T
        self.f, self.there, self.zz = (np.ascontiguousarray(v[..., mine]) for v in (own.f, own.there, own.zz))
        self.seen_bits, self.gap_bits = _bits(own.seen[:, mine]), _bits(~own.has[:, mine])
        self.largest = own.largest
        shown = self.seen.sum(1)
        self.share = np.maximum(shown, 1) / max(self.all, 1)
        # a row that nothing is known of has no distance to any
        self.far = np.where(self.gap & (shown > 0)[:, None], np.inf, -np.inf)
        self.kind: type | None = None
        self.limits: dict[tuple[int, type], tuple[np.ndarray, np.ndarray]] = {}
        self.got = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.float64))
        self.new: list[tuple] = []
        self.waiting = self.compared = 0
        if len(mine):
            self._guess(mine, own)

    def _sides(self, kind: type) -> None:
        if self.kind is not kind:
            f, there, one = self.f, self.there, np.ones(len(self.zz))
            w, o = self.cells.whole, self.cells.others
            has = there[w[0]] if len(w) else np.zeros(len(one), bool)
            self.left = _stacked([f[o] ** 2, (f[w] ** 2).sum(0), there[o], has, -2 * f, one], kind).T.copy()
            few = self.cells.few
            self.code = _stacked([f[few] ** 2, there[few], -2 * f[few], one], kind)
            self.kind = kind

    def _guess(self, mine: np.ndarray, own: _Block) -> None:
        """No gap's k-th donor is farther away than the k-th of some donors: of rows around, and of ones from everywhere."""
        kind = _kind(own.largest)
        self._sides(kind)
        right = own.sides(kind)
        for s in range(0, len(own.keys), NEAR):
            to = slice(*np.searchsorted(mine, [s, s + NEAR]))
            self._guess_from(np.arange(len(mine))[to], np.arange(s, min(s + NEAR, len(own.keys))), own, right)
        left = np.flatnonzero(np.isposinf(self.far).any(1))
        for s in range(0, len(left), 1024):
            self._guess_from(left[s : s + 1024], np.arange(0, len(own.keys), max(1, len(own.keys) // 2048)), own, right)

    def _guess_from(self, at: np.ndarray, them: np.ndarray, own: _Block, right: np.ndarray) -> None:
        if not len(at):
            return
        kind, right, has = self.kind, right[:, them], own.has[:, them]
        with np.errstate(all="ignore"):
            left = self.left[at]
            room = (2 * EPS[kind] * own.zz[them] + EPS[kind] * self.zz[at, None]).astype(kind)
            # features are turned: pairs that lack a whole column are left out
            o = len(self.cells.others)
            shared = left[:, o + 1 : 2 * o + 1] @ right[:o] + kind(len(self.cells.whole))
            d = np.maximum(left @ right + room, 0) / shared
            bad = ~self.seen[at][:, self.cells.whole].all(1)
            d[bad] = np.inf
            d[:, ~own.seen[:, them][self.cells.whole].all(0)] = np.inf
            d[~(d < np.inf)] = np.inf
            for c in np.flatnonzero(self.gap[at].any(0)):
                rows, cols = np.flatnonzero(self.gap[at, c]), np.flatnonzero(has[c])
                if len(cols) >= self.k:
                    near = np.partition(d[np.ix_(rows, cols)], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                    self.far[at[rows], c] = np.minimum(self.far[at[rows], c], np.sqrt(near * self.all) * (1 + 1e-5) + 1e-6)

    def _limit(self, which: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The farthest that a donor of a cell with these sparse columns may be, of each row, and up to which sum of squares a product
        may say so: no pair shares more columns than its row has."""
        if (which, kind) not in self.limits:
            lacks = [c for i, c in enumerate(self.cells.sparse) if not which >> i & 1]
            far = np.delete(self.far, lacks, 1).max(1, initial=-np.inf)
            with np.errstate(all="ignore"):
                sums = (far + 1e-8) ** 2 * (1 + 1e-9) * self.share
                self.limits[which, kind] = far, np.where(far >= 0, (sums + EPS[kind] * (self.zz + sums)) * (1 + 1e-6), -np.inf).astype(kind)
        return self.limits[which, kind]

    def offer(self, them: _Block) -> None:
        """Compare with donors. What a stretch of them has in common says which rows they may be near to; pairs of which one
        product, with room for its rounding, says that they are near enough are computed exactly."""
        if not len(self.keys):
            return
        kind, few, cuts = _kind(max(them.largest, self.largest)), self.cells.few, self.cells.cuts
        self._sides(kind)
        right = them.sides(kind)
        (low, high), (least, most) = them.bounds(few), them.bounds(cuts)
        held: list[tuple] = []
        count, finite = 0, bool(np.isfinite(self.largest) and np.isfinite(them.largest))
        with np.errstate(all="ignore"):
            same = low == high
            v = np.where(same, low, 0.0)
            one = np.vstack([same, v * v, v, -EPS[kind] * (v * v).sum(0)]).T.astype(kind)
            for s in range(0, len(one), 64):
                bound = one[s : s + 64] @ self.code
                for b in range(s, min(s + 64, len(one))):
                    which, l = int(them.which[b]), bound[b - s]
                    limit = self._limit(which, kind)[1]
                    at = np.flatnonzero(~(l > limit))
                    at = at[limit[at] > -np.inf]
                    if not len(at):
                        continue
                    sums = l[at]
                    for c, feature in enumerate(cuts):
                        q = self.f[feature][at]
                        gap = np.maximum(np.maximum(least[c, b] - q, q - most[c, b]), 0.0) * self.there[feature][at]
                        sums = sums + gap * gap * (1 - 1e-9)
                    at = at[~(sums > limit[at])]
                    e, f = them.starts[b], them.ends[b]
                    self.compared += len(at) * int(f - e)
                    for t in range(0, len(at), 4096):
                        part = at[t : t + 4096]
                        product = self.left[part] @ right[:, e:f]
                        upto = limit[part][:, None]
                        hit = np.flatnonzero(product <= upto if finite else ~(product > upto))
                        if len(hit):
                            i, j = np.divmod(hit, f - e)
                            held.append((part[i], j + e, product.reshape(-1)[hit], np.full(len(hit), which)))
                            count += len(hit)
                            if count >= 50_000:
                                self._exact(held, them, kind)
                                held, count = [], 0
            self._exact(held, them, kind)

    def _exact(self, held: list[tuple], them: _Block, kind: type) -> None:
        if not held:
            return
        z, seen, has, seen_bits, has_bits = them.rows()
        i, j, product, which = (np.concatenate(v) for v in zip(*held))
        # how many columns are shared is counted by bits: most pairs that were near on all of them aren't
        shared = np.bitwise_count(self.seen_bits[i] & seen_bits[j]).sum(1)
        gives = (self.gap_bits[i] & has_bits[j]).any(1)
        far = np.empty(len(i))
        for w in np.unique(which):
            at = np.flatnonzero(which == w)
            far[at] = self._limit(int(w), kind)[0][i[at]]
        sums = (far + 1e-8) ** 2 * (1 + 1e-9) * shared / self.all
        fine = np.flatnonzero(gives & (shared > 0) & ~(product > (sums + EPS[kind] * (self.zz[i] + sums)) * (1 + 1e-6)))
        for s in range(0, len(fine), 10_000):
            a, b = i[fine[s : s + 10_000]], j[fine[s : s + 10_000]]
            d = (self.z[a] - z[b]) * (self.seen[a] & seen[b])
            d = np.round(np.sqrt(np.einsum("ij,ij->i", d, d) * self.all / shared[fine[s : s + 10_000]]), 9)
            pair, c = np.nonzero(has[b] & (d[:, None] <= self.far[a]) & np.isfinite(d)[:, None])
            if len(pair):
                self.new.append((a[pair] * self.p + c, d[pair], them.keys[b[pair]], them.x[c, b[pair]]))
                self.waiting += len(pair)
        if self.waiting >= max(50_000, len(self.got[0]) // 4):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        got = tuple(np.concatenate(v) for v in zip(self.got, *self.new))
        order = self._sorted(*got[:3])
        got = tuple(v[order] for v in got)
        first = np.flatnonzero(np.diff(got[0], prepend=-1))
        rank = np.arange(len(got[0])) - np.repeat(first, np.diff(np.append(first, len(got[0]))))
        self.got, self.new, self.waiting = tuple(v[rank < self.k] for v in got), [], 0
        last = rank == self.k - 1
        self.far.reshape(-1)[got[0][last]] = np.minimum(self.far.reshape(-1)[got[0][last]], got[1][last])
        self.limits = {}

    def _sorted(self, slot: np.ndarray, d: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """By slot, distance and donor. Distances have 9 decimals: with the slot they are one whole number, unless they are far."""
        room = 63 - int(self.z.size).bit_length()
        if not d.max(initial=0.0) < min(1 << 20, (1 << room) / 1e9 - 1):
            return np.lexsort((donor, d, slot))
        both = slot << room | np.rint(d * 1e9).astype(np.int64)
        order = np.argsort(both)
        both = both[order]
        same = both[1:] == both[:-1]
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
        if len(tied):
            order[tied] = order[tied][np.lexsort((donor[order[tied]], both[tied]))]
        return order

    def fills(self, weights: str, again: np.ndarray | None) -> list[np.ndarray]:
        """_key, pos, d, donor, value: the donors of keys that repeat (all, if `again` is None), else one finished value a gap."""
        slot, d, donor, value = self.got
        key, pos = self.keys[slot // self.p], (slot % self.p).astype(np.int32)
        open_ = np.ones(len(slot), bool) if again is None else np.isin(key, again)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        if not len(first):
            return [key, pos, d, donor, value]
        w = np.ones(len(d))
        if weights != "uniform":
            zero = np.repeat(d[first] == 0, np.diff(np.append(first, len(d))))
            w = np.where(zero, d == 0, 1 / np.where(d > 0, d, 1.0))
        made = np.add.reduceat(w * value, first) / np.add.reduceat(w, first)
        one = ~open_[first]
        none = np.full(int(one.sum()), np.nan)
        return [np.concatenate(v) for v in ((key[open_], key[first][one]), (pos[open_], pos[first][one]), (d[open_], none), (donor[open_], np.zeros(len(none), np.int64)), (value[open_], made[one]))]


def _kind(largest: float) -> type:
    return np.float32 if largest < 1e6 else np.float64


def _donors(scale: Scale, cells: Cells, k: int, weights: str, again: np.ndarray | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice comes with the first row; its own rows are compared first, those of others pass by."""
        slot, held = None, None
        for batch in batches:
            for b in range(len(batch)):
                if batch.column("mine")[b].is_valid:
                    slot = batch.column("slot")[b].as_py()
                    keys, x = _unpacked(batch.column("mine")[b], batch.column("gappy")[b])
                    own = _Block(np.frombuffer(batch.column("codes")[b].as_buffer(), np.int32), keys, x, scale, cells, most)
                    held = _Receivers(own, scale, cells, k)
                    held.offer(own)
                    held.settle()
                    del own, keys, x
                    pa.default_memory_pool().release_unused()
                if batch.column("s")[b].as_py() != slot:
                    keys, x = _unpacked(batch.column("keys")[b], batch.column("x")[b])
                    held.offer(_Block(np.frombuffer(batch.column("c")[b].as_buffer(), np.int32), keys, x, scale, cells, most))
        if held is not None:
            held.settle()
            key, pos, d, donor, value = held.fills(weights, again)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(d, mask=np.isnan(d)), pa.array(donor), pa.array(value)], names=["_key", "pos", "d", "donor", "value"])

    return run


@dataclass(frozen=True)
class Imputed:
    """frame: source columns in order, then `<name>_orig`. report: column_name, strategy, filled (positive counts)."""

    frame: DataFrame
    report: DataFrame

    def same_rows(self, source: DataFrame) -> bool:
        """Whether there are as many rows as in the source, from a count of each."""
        return self.frame.count() == source.count()

    def total_filled(self) -> int:
        return self.report.agg(F.coalesce(F.sum("filled"), F.lit(0))).first()[0]

    def summary(self, top: int = 15) -> str:
        rows = self.report.orderBy(F.desc("filled"), "column_name").collect()
        lines = [f"{sum(r.filled for r in rows)} values filled in {len({r.column_name for r in rows})} columns"]
        lines += [f"{r.column_name:<28}{r.filled:>8}  {r.strategy}" for r in rows[:top]]
        return "\n".join(lines + ([f"and {len(rows) - top} more"] if len(rows) > top else []))


class Filler(ABC):
    """What `impute` needs of a way to fill a table: something that is fitted on one table and applied to it or another. A
    subclass gives `fit` and `transform`; the rows and columns that `transform` gives back are checked."""

    @classmethod
    @abstractmethod
    def fit(cls, df: DataFrame, key: str, config: ImputationConfig = ImputationConfig(), roles: Roles | None = None) -> Filler: ...

    @abstractmethod
    def transform(self, df: DataFrame) -> Imputed: ...


@dataclass(frozen=True)
class Imputer(Filler):
    """Statistics of a fit, applied with `transform`."""

    key: str
    roles: Roles
    config: ImputationConfig
    numbers: dict[str, NumericStats]
    labels: dict[str, str | None]

    @classmethod
    def fit(cls, df: DataFrame, key: str, config: ImputationConfig = ImputationConfig(), roles: Roles | None = None, schema: SchemaConfig = SchemaConfig()) -> Imputer:
        roles = roles or classify(df, schema)
        numeric = [c for c in roles.numeric if c not in config.skip_columns]
        labels = [c for c in roles.categorical if c not in config.skip_columns]
        clean = coerce(df, roles, config.skip_columns)
        return cls(key, roles, config, scaler_stats(numeric_view(clean, key, numeric), numeric), modes(clean, labels))

    def transform(self, df: DataFrame, donors: DataFrame | None = None) -> Imputed:
        """Fill df. The key, of any type that has an order, must identify a row; a key that repeats gets one fill for all its
        rows, and a row without a key the mean. No more than all other rows are neighbours, and the report says how many
        were. Observed values come
        back as they are; rows and their number never change; skipped columns are untouched. Empty input stays empty."""
        config = self.config
        clean = coerce(df, self.roles, config.skip_columns)
        numeric, labels = list(self.numbers), list(self.labels)
        numbered = self._numbered(df)
        view = numeric_view(clean.withColumn("_key", name(self.key).cast("long")) if numbered is None else clean.join(numbered, self.key), "_key", numeric)
        k = min(config.n_neighbors, max(1, view.count() - 1))
        inside = list(config.distance_columns) if config.distance_columns is not None else None
        fills = neighbour_fills(view, numeric, self.numbers, k, config.weights, inside)
        wide = fills.groupBy("_key").agg(*(F.max(F.when(F.col("pos") == i, F.col("value"))).alias(f"_f{i}") for i in range(len(numeric)))) if numeric else None
        source = df.select(*(name(c) for c in df.columns), *(c.alias(f"_c{i}") for i, c in enumerate(_coerced(df, self.roles, config.skip_columns))))
        source = source.withColumn("_key", name(self.key).cast("long")) if numbered is None else source.join(numbered, self.key, "left")
        if wide is not None:
            source = source.join(wide, "_key", "left")
        out, marks = [], []
        place = {c: i for i, c in enumerate(df.columns)}
        for c in df.columns:
            seen = F.col(f"_c{place[c]}")
            if c in self.numbers:
                value, mark = self._number(c, seen, numeric.index(c), k)
            elif c in self.labels:
                value, mark = self._label(c, seen, df.schema[c].dataType)
            else:
                value, mark = name(c), F.lit(None).cast("string")
            out.append(value.alias(c))
            marks.append(mark)
        processed = [c for c in df.columns if c in self.numbers or c in self.labels]
        if config.keep_original_columns:
            out += [name(c).alias(f"{c}_orig") for c in processed]
        pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), m.alias("strategy")) for c, m in zip(df.columns, marks)))
        report = source.select(F.explode(F.filter(pairs, lambda p: p["strategy"].isNotNull())).alias("p")).groupBy("p.column_name", "p.strategy").agg(F.count(F.lit(1)).alias("filled"))
        return Imputed(source.select(*out), report)

    def _numbered(self, df: DataFrame) -> DataFrame | None:
        """(key, _key): numbers in the order of the keys, for keys that aren't whole numbers."""
        if isinstance(df.schema[self.key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return None
        return numbered_in_order(df.select(name(self.key)).where(name(self.key).isNotNull()).distinct(), self.key, "_key")

    def _number(self, c: str, seen: Column, i: int, k: int) -> tuple[Column, Column]:
        s = self.numbers[c]
        near, mean, median = F.col(f"_f{i}"), F.lit(s.observed_mean).cast("double"), F.lit(0.0 if s.median is None else s.median)
        guess = F.coalesce(near, mean, median)
        if s.whole:
            guess = F.bround(guess, 0)
        value = F.coalesce(seen.cast("double"), guess)
        mark = F.when(seen.isNull(), F.when(near.isNotNull() | mean.isNotNull(), F.lit(f"knn(k={k})")).otherwise(F.lit("median-fallback")))
        return (value.cast("long") if s.whole else value), mark

    def _label(self, c: str, seen: Column, kind: T.DataType) -> tuple[Column, Column]:
        fill = self.labels[c]
        given = F.lit(self.config.categorical_placeholder if fill is None else fill)
        text = seen.cast("string")
        blank = is_blank(text)
        value = F.when(text.isNull() | blank, given).otherwise(text)
        mark = F.when(text.isNull(), F.lit("mode" if fill is not None else "placeholder")).when(blank, F.lit("mode-fallback"))
        return value, mark


def _coerced(df: DataFrame, roles: Roles, skip: tuple[str, ...]) -> list[Column]:
    out = []
    for c in df.columns:
        kind = df.schema[c].dataType
        if c in skip:
            out.append(name(c))
        elif c in roles.numeric:
            out.append(as_number(name(c), kind))
        elif isinstance(kind, T.StringType):
            out.append(null_if_token(name(c)))
        else:
            out.append(name(c))
    return out


def impute(df: DataFrame, key: str, config: ImputationConfig = ImputationConfig(), roles: Roles | None = None, way: type[Filler] = Imputer) -> Imputed:
    """Fill df by a way of filling. Columns that are lost or come in another order raise ValueError; `Imputed.same_rows` counts."""
    made = way.fit(df, key, config, roles).transform(df)
    if made.frame.columns[: len(df.columns)] != df.columns:
        raise ValueError(f"columns were lost or moved: {', '.join(df.columns)} became {', '.join(made.frame.columns)}")
    return made
