"""Nearest rows by block matrix products in int8, verified in float.

Rows are divided into cells by their nearest centre. A row that lies within `radius` of the face between its own cell and
another visits that cell too (the distance to the face is (|x-c2|^2 - |x-c1|^2) / (2 |c1-c2|)), so that every pair within
the radius meets in the cell of one of them. The number of cells grows with the rows; inside a cell rows are divided once
more in the same way, into local cells of about NEAR rows, so that the pairs compared per row don't grow with the table. A
local cell is one product of int8 matrices; with the rounding error of each row known, it gives a lower bound of every
distance, and only pairs whose bound lets them pass are computed in float and kept in a heap per row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.plans.shared import over_groups, sized_join, written

#: Rows of a cell aimed at; cells at most (their centres are broadcast: 24 readings are 3 MB; beyond, cells hold more rows);
#: rows of a local cell aimed at.
CELL_ROWS, MOST_CELLS, NEAR = 4096, 16_384, 256
#: Rows the centres are fitted on, and at least so many per centre; a centre for fewer rows than this share of CELL_ROWS is dropped.
FIT_ROWS, FIT_PER_CELL, LEAST_SHARE = 20_000, 8, 1 / 16
#: A cell expected to hold more rows is cut into parts that meet pair by pair; rows of a product at a time.
TILE, STRIP = 100_000, 256
#: Up to so many centres are compared with every row; more are searched through their groups.
PLAIN = 512
#: Distances of a block at a time.
BLOCK = 1 << 21
#: Slack for rounding in bounds.
EPS = 1e-6

TILE_KEYS = ("cell", "ta", "tb")
_TILE_SCHEMA = "cell int, ta int, tb int, part int, resident boolean, id long, v array<double>"


def scaled_vectors(df: DataFrame, key: str, scales: list[tuple[str, float, float]], length: int) -> DataFrame:
    """(id, v): the scaled readings of the fields one after another, for rows in which every list is complete. A row with a
    null key, a null, NaN or infinite reading, or a list that is null or of another length, isn't complete and left out;
    rows with equal keys are rows of their own."""
    fields = [f"`{f}`" for f, _, _ in scales]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.asarray(batch.column("id").is_valid())
            lists = [batch.column(f"f{i}") for i in range(len(scales))]
            for c in lists:
                whole &= np.asarray(c.is_valid()) & (np.diff(np.asarray(c.offsets)) == length)
            at = pa.array(np.flatnonzero(whole))
            parts = [np.asarray(c.take(at).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length) for c in lists]
            x = np.hstack([(p - float(centre)) / float(spread) for p, (_, centre, spread) in zip(parts, scales)])
            fine = np.isfinite(x).all(1)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at).filter(pa.array(fine)), rows_of(x[fine])], names=["id", "v"])

    read = df.select(F.col(f"`{key}`").cast("long").alias("id"), *(F.col(f).cast("array<double>").alias(f"f{i}") for i, f in enumerate(fields)))
    return read.mapInArrow(run, "id long, v array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rows_of(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)), pa.array(x.ravel()))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)


@dataclass
class Tile:
    """int8 form of a block's rows: q * scale + centre, and the length of each row's rounding error."""

    q: np.ndarray
    norm: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, scale: float) -> Tile:
        moved = x - centre
        q = np.rint(moved / scale).astype(np.int8)
        back = q.astype(np.float64)
        return cls(q, (back**2).sum(1), np.sqrt(((moved - back * scale) ** 2).sum(1)) + EPS)


def _frame(*blocks: np.ndarray) -> tuple[np.ndarray, float]:
    low, high = np.min([b.min(0) for b in blocks], 0), np.max([b.max(0) for b in blocks], 0)
    return (low + high) / 2, max(float((high - low).max()) / 2 / 127, 1e-12)


def _product(dims: int):
    """Integer products are exact in single precision while they stay below 2**24."""
    return np.float32 if dims * 4 * 127**2 < 2**24 else np.float64


def within(a: np.ndarray, b: np.ndarray | None, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance) of rows of a and b at most `radius` apart; without b, pairs i < j of rows of a."""
    one = b is None
    b = a if one else b
    if not len(a) or not len(b):
        return
    centre, scale = _frame(a, b)
    left = Tile.of(a, centre, scale)
    right = left if one else Tile.of(b, centre, scale)
    kind = _product(a.shape[1])
    columns, norms, worst = np.ascontiguousarray(right.q.T.astype(kind)), right.norm.astype(kind), right.error.max()
    for s in range(0, len(a), STRIP):
        part, at = slice(s, s + STRIP), s if one else 0
        # |qa - qb|^2 - |qa|^2, and the most it may be for the distance to reach the radius
        most = ((radius + left.error[part] + worst) / scale) ** 2 - left.norm[part]
        got = norms[None, at:] - 2 * (left.q[part].astype(kind) @ columns[:, at:])
        i, j = np.nonzero(got <= most[:, None] + 0.5)
        i, j = i + s, j + at
        if one:
            i, j = i[i < j], j[i < j]
        if len(i):
            d = np.sqrt(((a[i] - b[j]) ** 2).sum(1))
            keep = d <= radius
            if keep.any():
                yield i[keep], j[keep], d[keep]


class Heaps:
    """The k nearest per row, ties to the smaller id. A heap's root is its worst entry."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def push(self, row: int, distance: float, other: int) -> None:
        h = self.of.setdefault(row, [])
        if len(h) < self.k:
            heapq.heappush(h, (-distance, -other))
        elif (-distance, -other) > h[0]:
            heapq.heapreplace(h, (-distance, -other))

    def rows(self) -> tuple[list, list, list]:
        flat = [(r, -o, -d) for r, h in self.of.items() for d, o in h]
        return tuple(map(list, zip(*flat))) if flat else ([], [], [])


class Cells:
    """Centres, and the cells that rows belong to and visit. share: the part of all rows expected in each cell.

    Up to PLAIN centres are compared with every row. More are put into groups around some of them: a group whose nearest
    point may not lie within reach of a row is passed over, so that the work per row stays far below the number of centres.
    """

    def __init__(self, centres: np.ndarray, share: np.ndarray | None = None):
        self.centres, self.share = centres, share
        self.tops = None
        if len(centres) > PLAIN:
            self.tops = centres[np.linspace(0, len(centres) - 1, int(len(centres) ** 0.5)).astype(int)]
            self.top, far = np.empty(len(centres), np.int64), np.empty(len(centres))
            for s in range(0, len(centres), 4096):
                d2 = squares(centres[s : s + 4096], self.tops)
                self.top[s : s + 4096] = d2.argmin(1)
                far[s : s + 4096] = np.sqrt(((centres[s : s + 4096] - self.tops[d2.argmin(1)]) ** 2).sum(1))
            self.radii = np.zeros(len(self.tops))
            np.maximum.at(self.radii, self.top, far)

    def _near(self, x: np.ndarray, slack: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks (rows, columns): the columns hold every row's nearest centre and all that are at most `slack` farther."""
        every = np.arange(len(self.centres))
        if self.tops is None:
            groups = [(np.arange(len(x)), every)]
        else:
            d = np.sqrt(squares(x, self.tops))
            least = d.min(1)
            reached = d - self.radii[None] <= (least + slack + 1e-6 * (1 + np.sqrt((x**2).sum(1))))[:, None]
            first = d.argmin(1)
            groups = ((rows, every[reached[rows].any(0)[self.top]]) for rows in (np.flatnonzero(first == t) for t in np.unique(first)))
        for rows, columns in groups:
            step = max(64, BLOCK // max(len(columns), 1))
            for s in range(0, len(rows), step):
                yield rows[s : s + step], columns

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
        for rows, columns in self._near(x, np.zeros(len(x))):
            d2 = squares(x[rows], self.centres[columns])
            best = d2.argmin(1)
            home[rows], distance[rows] = columns[best], np.sqrt(d2[np.arange(len(rows)), best])
        return home, distance

    def visits(self, x: np.ndarray, radius: float | np.ndarray, label: np.ndarray | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, row, cell): the cells that each row must visit so that it meets, in its own cell or one it visits, every row
        within its radius that lies in a cell of smaller number (every: in any other cell). With labels, several centres
        make up one cell, named by their label."""
        label = np.arange(len(self.centres)) if label is None else label
        radius = np.broadcast_to(np.asarray(radius, np.float64), (len(x),))
        home, out = np.zeros(len(x), np.int64), []
        for rows, columns in self._near(x, 2 * (radius + EPS)):
            part, c = x[rows], self.centres[columns]
            total = (part**2).sum(1)[:, None] + (c**2).sum(1)[None]
            d2 = np.maximum(total - 2 * part @ c.T, 0)
            best = d2.argmin(1)
            own = d2[np.arange(len(rows)), best]
            firsts, back = np.unique(best, return_inverse=True)
            gaps = np.stack([np.sqrt(((c - c[f]) ** 2).sum(1)) for f in firsts])[back]
            finite = np.isfinite(radius[rows])[:, None]
            reach = 2 * (np.where(finite, radius[rows, None], 0.0) + EPS) * gaps + 1e-12 * (1 + total)
            mine, theirs = label[columns[best]], label[columns]
            near = ~finite | (d2 - own[:, None] <= reach)
            near &= (theirs[None] != mine[:, None]) if every else (theirs[None] < mine[:, None])
            r, k = np.nonzero(near)
            home[rows] = mine
            out.append(np.unique(np.stack([rows[r], theirs[k]], 1), axis=0) if len(r) else np.zeros((0, 2), np.int64))
        met = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return home, met[:, 0], met[:, 1]


def spread_centres(centres: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """Centres without repeated ones: one of those that agree to `least`."""
    return centres[np.sort(np.unique(np.rint(centres / least), axis=0, return_index=True)[1])]


def settled(x: np.ndarray, centres: np.ndarray, rounds: int) -> Cells:
    """Some rounds of k-means, with the share of the rows in each cell."""
    cells = Cells(spread_centres(centres))
    for _ in range(rounds):
        home, _ = cells.home(x)
        size, sums = np.bincount(home, minlength=len(cells.centres)), np.zeros_like(cells.centres)
        np.add.at(sums, home, x)
        cells = Cells(spread_centres(np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], cells.centres)))
    return Cells(cells.centres, np.bincount(cells.home(x)[0], minlength=len(cells.centres)) / max(len(x), 1))


def fit_cells(vectors: DataFrame) -> Cells | None:
    """Centres, about one per CELL_ROWS rows, of a few rounds of k-means over a sample; None without rows.

    The sample is chosen by a hash, FIT_ROWS rows or FIT_PER_CELL per centre if that is more, at most twice as many. Only the
    centres depend on it: every row is assigned, and the pairs found don't depend on the centres. Centres for few rows are
    dropped, and their rows belong to the next ones.
    """
    n = vectors.count()
    if not n:
        return None
    k = int(min(max(n // CELL_ROWS, 1), MOST_CELLS))
    want = max(FIT_ROWS, FIT_PER_CELL * k)
    mix = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40))
    chosen = (vectors if want >= n else vectors.where(mix < int(want / n * (1 << 40)) + 1)).limit(2 * want).select("id", "v").toArrow()
    x = matrix(chosen.sort_by("id").column("v"))
    if not len(x):
        x = matrix(vectors.limit(1).toArrow().column("v"))
    k = min(k, max(1, len(x) // FIT_PER_CELL))
    cells = settled(x, x[np.linspace(0, len(x) - 1, k).astype(int)], 4)
    large = cells.share * n >= CELL_ROWS * LEAST_SHARE
    return cells if large.all() or not large.any() else settled(x, cells.centres[large], 0)


def cell_parts(cells: Cells, n: int) -> np.ndarray:
    """Into how many parts each cell is cut."""
    return np.ones(len(cells.centres), np.int64) if cells.share is None else np.maximum(1, np.ceil(cells.share * n / TILE)).astype(np.int64)


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


def assigned(vectors: DataFrame, cells: Cells, radius: float, parts: np.ndarray | None = None, label: np.ndarray | None = None) -> DataFrame:
    """(cell, ta, tb, part, resident, id, v): each row in its own cell, and as a visitor in the others it must meet. A cell cut into
    several parts becomes a tile for every two of them; tile (a, a) compares the rows of part a, (a, b) those of a with b."""
    held = vectors.sparkSession.sparkContext.broadcast((cells, parts, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, parts, label = held.value
        for batch in batches:
            if not len(batch):
                continue
            home, rows, at = cells.visits(matrix(batch.column("v")), radius, label)
            take, cell = np.concatenate([np.arange(len(batch)), rows]), np.concatenate([home, at])
            resident = np.arange(len(take)) < len(batch)
            ta = tb = part = np.zeros(len(take), np.int64)
            if parts is not None and (parts[cell] > 1).any():
                n = parts[cell]
                part = _mixed(batch.column("id").to_numpy()[take]) % n
                copy = np.repeat(np.arange(len(take)), n)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                take, cell, resident, part = take[copy], cell[copy], resident[copy], part[copy]
                ta, tb = np.minimum(part, other), np.maximum(part, other)
            number = lambda a: pa.array(a.astype(np.int32))
            take = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [number(cell), number(ta), number(tb), number(part), pa.array(resident), batch.column("id").take(take), batch.column("v").take(take)],
                names=["cell", "ta", "tb", "part", "resident", "id", "v"],
            )

    return vectors.select("id", "v").mapInArrow(run, _TILE_SCHEMA)


def local_cells(x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, at home): the rows of a cell divided once more, with visitors."""
    k = len(x) // NEAR
    if k < 2:
        yield np.arange(len(x)), np.ones(len(x), bool)
        return
    pick = x[np.linspace(0, len(x) - 1, min(len(x), FIT_PER_CELL * k)).astype(int)]
    home, rows, at = settled(pick, pick[np.linspace(0, len(pick) - 1, k).astype(int)], 2).visits(x, radius)
    rows, cell = np.concatenate([np.arange(len(x)), rows]), np.concatenate([home, at])
    order = np.argsort(cell, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        yield rows[own], own < len(x)


def meetings(x: np.ndarray, resident: np.ndarray, side: np.ndarray | None, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance), one local cell after another, of the pairs that meet in a cell: each pair within the radius in exactly
    one local cell of one cell. Two visitors meet elsewhere, at either level. With sides, pairs of different sides only."""
    for at, inner in local_cells(x, radius):
        outer = resident[at]
        own, rest = at[outer & inner], at[~(outer & inner)]
        out = []
        for a, b in ((own, None), (own, rest), (at[outer & ~inner], at[~outer & inner])):
            for i, j, d in within(x[a], None if b is None else x[b], radius):
                i, j = a[i], (a if b is None else b)[j]
                keep = slice(None) if side is None else side[i] != side[j]
                out.append((i[keep], j[keep], d[keep]))
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out))


def tile_meetings(tile: pa.Table, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """meetings of one tile of `assigned`."""
    whole = tile.column("ta")[0].as_py() == tile.column("tb")[0].as_py()
    return meetings(matrix(tile.column("v")), tile.column("resident").to_numpy(zero_copy_only=False), None if whole else tile.column("part").to_numpy(), radius)


def similar_rows(vectors: DataFrame, k: int, radius: float) -> DataFrame:
    """(id, other, distance, rank): for every row of (id, v) its k nearest other rows within the radius, exactly.

    Ties go to the smaller id. Of rows with equal vectors only the first k + 1 by id can be anybody's partner; the others
    take the first k as their own partners and don't enter the cells. A row has no partner under its own id.
    Empty input gives no rows.
    """
    vectors = written(vectors.select("id", "v"), "vectors")
    few, beyond = _first_copies(vectors, k)
    cells = fit_cells(few)
    if cells is None:
        return vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")

    def use(tile: pa.Table) -> pa.RecordBatch:
        heaps, ids = Heaps(k), tile.column("id").to_numpy()
        for i, j, d in tile_meetings(tile, radius):
            for a, b, r in zip(ids[i].tolist(), ids[j].tolist(), d.tolist()):
                if a != b:
                    heaps.push(a, r, b)
                    heaps.push(b, r, a)
        a, b, d = heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names=["id", "other", "distance"])

    found = over_groups(assigned(few, cells, radius, cell_parts(cells, few.count())), TILE_KEYS, "id long, other long, distance double", use)
    # a row that repeats under one id finds each partner once per repetition, and the first row left out of a crowd may find
    # its partners in the cells as well
    found = (found if beyond is None else found.unionByName(beyond)).groupBy("id", "other").agg(F.min("distance").alias("distance"))
    nearest = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _first_copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows that may be partners, and the partners (the first k of their copies) of the rows left out; None where no
    vector has more than k + 1 copies. Copies are counted by a hash of the vector, so that only hashes travel; the rows of
    crowded hashes alone are then ordered by vector and id."""
    hashed = vectors.withColumn("_h", F.xxhash64("v"))
    crowds = written(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("_h"), "crowded")
    if crowds.isEmpty():
        return vectors, None
    plain = sized_join(hashed, crowds, ["_h"], "left_anti", ["id"]).select("id", "v")
    dense = written(sized_join(hashed, crowds, ["_h"], "left_semi", ["id"]).select("id", "v"), "dense")
    first = dense.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    first = written(first, "first_copies")
    crowded = first.where(F.col("_n") == k + 1).select("v")
    firsts = written(first.where(F.col("_n") <= k).join(crowded, "v", "left_semi").groupBy("v").agg(F.collect_list("id").alias("others"), F.max("id").alias("_last")), "crowds")
    # others has at most k entries
    rows = sized_join(dense, firsts, ["v"], "inner", ["id"]).where(F.col("id") > F.col("_last"))
    beyond = rows.select("id", F.explode(F.array_distinct("others")).alias("other"), F.lit(0.0).alias("distance")).where("id <> other").distinct()
    return written(plain.unionByName(first.select("id", "v")), "few"), beyond


_ASK = "cell int, part int, q long, id long, v array<double>, bound double"


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(id, other, distance, rank): for each stated query of (id, v) its k nearest rows among all vectors, exactly.

    A query first meets the rows of its own cell, which bounds the distance of its k-th neighbour; then it visits just those
    cells that a ball of that radius reaches. Neither queries nor rows pass through the driver. In a cell every query keeps a
    heap, and a pair is computed in float only if its int8 lower bound beats the heap's worst entry. A query isn't its own
    neighbour (equal ids are left out). Ties go to the smaller id. Rows or queries that share an id are one neighbour or
    one query, at the least of their distances.
    """
    vectors = written(vectors.select("id", "v"), "vectors")
    asked = written(queries.select(F.monotonically_increasing_id().alias("q"), "id", "v"), "queries")
    cells = fit_cells(vectors)
    if cells is None or asked.isEmpty():
        return queries.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
    held = vectors.sparkSession.sparkContext.broadcast((cells, cell_parts(cells, vectors.count())))

    def placed(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, parts = held.value
            for batch in batches:
                if not len(batch):
                    continue
                x, ids = matrix(batch.column("v")), batch.column("id").to_numpy()
                rows = np.arange(len(x))
                if kind == "far":
                    bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                    _, rows, cell = cells.visits(x, np.where(np.isnan(bound), np.inf, bound), every=True)
                else:
                    cell, _ = cells.home(x)
                if kind == "row":
                    part = _mixed(ids) % parts[cell]
                else:
                    n = parts[cell]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    rows, cell = np.repeat(rows, n), np.repeat(cell, n)
                take = pa.array(rows)
                q = pa.array(np.full(len(rows), -1)) if kind == "row" else batch.column("q").take(take)
                limit = batch.column("bound").take(take) if kind == "far" else pa.nulls(len(rows), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), q, batch.column("id").take(take), batch.column("v").take(take), limit],
                    names=["cell", "part", "q", "id", "v", "bound"],
                )

        return run

    def use(group: pa.Table) -> pa.RecordBatch:
        q = group.column("q").to_numpy()
        ids, x = group.column("id").to_numpy(), matrix(group.column("v"))
        bound = group.column("bound").to_numpy()
        asks, rows = np.flatnonzero(q >= 0), np.flatnonzero(q < 0)
        heaps, held_in = [[] for _ in asks], [{} for _ in asks]
        worst = np.where(np.isnan(bound[asks]), np.inf, bound[asks])
        for s in range(0, len(rows) if len(asks) else 0, 3000):
            part = rows[s : s + 3000]
            _offer(ids[asks], x[asks], heaps, held_in, worst, ids[part], x[part], k)
        found = [(int(q[a]), int(ids[a]), -o, -d) for a, h in zip(asks, heaps) for d, o in h]
        columns = zip(*found) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["q", "id", "other", "distance"])

    out = "q long, id long, other long, distance double"
    rows = vectors.mapInArrow(placed("row"), _ASK)
    near = written(over_groups(rows.unionByName(asked.mapInArrow(placed("home"), _ASK)), ("cell", "part"), out, use), "near")
    # at most k entries per part of a cell
    bounds = near.groupBy("q", "other").agg(F.min("distance").alias("d")).groupBy("q").agg(F.get(F.array_sort(F.collect_list("d")), F.lit(k - 1)).alias("bound"))
    far = over_groups(rows.unionByName(asked.join(bounds, "q", "left").mapInArrow(placed("far"), _ASK)), ("cell", "part"), out, use)
    found = near.unionByName(far).groupBy("id", "other").agg(F.min("distance").alias("distance"))
    nearest = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _offer(ids: np.ndarray, q: np.ndarray, heaps: list, held_in: list, worst: np.ndarray, other: np.ndarray, x: np.ndarray, k: int) -> None:
    """Offer a block of rows to the queries' heaps, which hold an id once; held_in: each heap's distance by id."""
    centre, scale = _frame(q, x)
    right, kind = Tile.of(x, centre, scale), _product(x.shape[1])
    columns, most = right.q.T.astype(kind), right.error.max()
    # so many rows of one id are in the block at most: reach + 1 rows without the query's own hold k ids
    reach = k * int(np.unique(other, return_counts=True)[1].max())
    for s in range(0, len(q), STRIP):
        part = slice(s, s + STRIP)
        left = Tile.of(q[part], centre, scale)
        d2 = left.norm[:, None].astype(kind) + right.norm[None].astype(kind) - 2 * (left.q.astype(kind) @ columns)
        bound = worst[part].copy()
        if d2.shape[1] > reach:
            # the nearest of this block alone bound the answer (some of them may be the query itself)
            kth = np.sqrt(np.maximum(np.partition(d2, reach, axis=1)[:, reach].astype(np.float64), 0)) * scale + left.error + most
            bound = np.minimum(bound, kth)
        limit = np.where(np.isfinite(bound), ((bound + left.error + most) / scale) ** 2, np.inf)
        i, j = np.nonzero(d2 <= limit[:, None] + 0.5)
        exact = np.sqrt(((q[part][i] - x[j]) ** 2).sum(1))
        for a, b, d in zip((i + s).tolist(), j.tolist(), exact.tolist()):
            o = int(other[b])
            if o == ids[a]:
                continue
            h, own = heaps[a], held_in[a]
            if o in own:
                if d >= own[o]:
                    continue
                h[h.index((-own[o], -o))] = (-d, -o)
                heapq.heapify(h)
            elif len(h) < k:
                heapq.heappush(h, (-d, -o))
            elif (-d, -o) > h[0]:
                del own[-heapq.heapreplace(h, (-d, -o))[1]]
            else:
                continue
            own[o] = d
            if len(h) == k:
                worst[a] = min(worst[a], -h[0][0])
