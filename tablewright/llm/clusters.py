"""Similarity clusters from mergeable cluster-feature trees.

Every partition grows a tree whose leaf entries are cluster features (count, linear sum, sum of squares). Leaf entries of
several partitions are merged, round by round, into trees of the same bounded number of leaves; Ward agglomeration joins
the last leaves to clusters; one pass assigns every row to its leaf and cluster. Where groups are defined by a distance
between rows, Ward joins the leaves to blocks of bounded size, and the rows of a block meet for the exact check.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.vectors import CELL_ROWS, MOST_CELLS, TILE, TILE_KEYS, Cells, assigned, matrix, spread_centres, tile_meetings
from tablewright.plans.shared import over_groups, sized_join, written

#: Leaf entries of the first tree at most; entries of an inner node; trees merged into one; Ward clusters.
LEAVES, BRANCH, FAN_IN, CLUSTERS = 512, 32, 8, 24
#: Leaves that Ward takes at once at most (its matrix of costs is 32 MB); rows below which a leaf isn't refined; rows of a leaf
#: aimed at where leaves are joined to blocks.
WARD_LEAVES, LEAST_SHARE, LEAF_ROWS = 2048, 64, 512
LEAF = "part int, node int, n double, ls array<double>, ss double"


class FeatureTree:
    """A tree of two levels over cluster features. A row or feature descends to the nearest node and there to the nearest
    leaf entry, which takes it in if its radius stays within the threshold. When leaves become too many, the threshold
    rises and the leaves are inserted anew."""

    def __init__(self, dims: int, leaves: int = LEAVES, threshold: float = 0.0):
        self.dims, self.leaves, self.threshold = dims, leaves, threshold
        self._clear()

    def _clear(self) -> None:
        self.n, self.ls, self.ss = np.zeros(0), np.zeros((0, self.dims)), np.zeros(0)
        self.node = np.zeros(0, np.int64)
        self.nodes = 0

    def _centres(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_cache") or self._cache is None:
            sums, size = np.zeros((self.nodes, self.dims)), np.zeros(self.nodes)
            np.add.at(sums, self.node, self.ls)
            np.add.at(size, self.node, self.n)
            self._cache = sums / np.maximum(size, 1e-300)[:, None], self.ls / self.n[:, None]
        return self._cache

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        """The leaf entry that each row descends to."""
        tops, leaves = self._centres()
        top = ((x**2).sum(1)[:, None] + (tops**2).sum(1)[None] - 2 * x @ tops.T).argmin(1)
        out = np.empty(len(x), np.int64)
        for t in np.unique(top):
            rows, entries = np.flatnonzero(top == t), np.flatnonzero(self.node == t)
            c = leaves[entries]
            out[rows] = entries[((c**2).sum(1)[None] - 2 * x[rows] @ c.T).argmin(1)]
        return out

    def _radius(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(ss / n - ((ls / n[..., None]) ** 2).sum(-1), 0))

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> FeatureTree:
        """Insert cluster features; a row is one with n = 1."""
        rest = np.arange(len(n))
        while len(rest):
            if len(self.n):
                part = rest[:2048]
                at = self._nearest(ls[part] / n[part][:, None])
                fits = self._radius(self.n[at] + n[part], self.ls[at] + ls[part], self.ss[at] + ss[part]) <= self.threshold
                # all that fit alone enter together; entries that grow beyond the threshold this way are still one feature
                go = part[fits]
                np.add.at(self.n, at[fits], n[go])
                np.add.at(self.ls, at[fits], ls[go])
                np.add.at(self.ss, at[fits], ss[go])
                new, rest = part[~fits], rest[2048:]
                self._cache = None
            else:
                new, rest = rest[:1], rest[1:]
            self._open(n, ls, ss, new)
        return self

    def _open(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, new: np.ndarray) -> None:
        """New leaf entries for what fitted nowhere: near ones among them share an entry."""
        while len(new):
            block = new[:64]
            new = new[64:]
            heads: list[int] = []
            for i in block:
                c = ls[i] / n[i]
                if heads:
                    tail = slice(len(self.n) - len(heads), len(self.n))
                    j = len(self.n) - len(heads) + int(((self.ls[tail] / self.n[tail][:, None] - c) ** 2).sum(1).argmin())
                    if self._radius(self.n[j] + n[i], self.ls[j] + ls[i], self.ss[j] + ss[i]) <= self.threshold:
                        self.n[j] += n[i]
                        self.ls[j] += ls[i]
                        self.ss[j] += ss[i]
                        continue
                heads.append(i)
                self.n, self.ls, self.ss = np.append(self.n, n[i]), np.vstack([self.ls, ls[i]]), np.append(self.ss, ss[i])
            self._attach(len(heads))
            if len(self.n) > self.leaves:
                self._rebuild()

    def _attach(self, count: int) -> None:
        """Put the last `count` entries under their nearest nodes and split nodes that overflow."""
        first = len(self.n) - count
        self._cache = None
        if not self.nodes:
            self.nodes, self.node = 1, np.zeros(len(self.n), np.int64)
        else:
            size, sums = np.zeros(self.nodes), np.zeros((self.nodes, self.dims))
            np.add.at(size, self.node, self.n[:first])
            np.add.at(sums, self.node, self.ls[:first])
            tops, c = sums / np.maximum(size, 1e-300)[:, None], self.ls[first:] / self.n[first:, None]
            near = ((c**2).sum(1)[:, None] + (tops**2).sum(1)[None] - 2 * c @ tops.T).argmin(1) if count else np.zeros(0, np.int64)
            self.node = np.append(self.node, near)
        for t in range(self.nodes):
            own = np.flatnonzero(self.node == t)
            if len(own) > BRANCH:
                c = self.ls[own] / self.n[own][:, None]
                a = ((c - c.mean(0)) ** 2).sum(1).argmax()
                b = ((c - c[a]) ** 2).sum(1).argmax()
                far = ((c - c[b]) ** 2).sum(1) < ((c - c[a]) ** 2).sum(1)
                if far.any() and not far.all():
                    self.node[own[far]] = self.nodes
                    self.nodes += 1

    def _rebuild(self) -> None:
        n, ls, ss = self.n, self.ls, self.ss
        c = ls / n[:, None]
        pick = np.linspace(0, len(c) - 1, min(len(c), 256)).astype(int)
        d2 = (c[pick] ** 2).sum(1)[:, None] + (c[pick] ** 2).sum(1)[None] - 2 * c[pick] @ c[pick].T
        np.fill_diagonal(d2, np.inf)
        near = float(np.median(np.sqrt(np.maximum(d2.min(1), 0)))) / 2
        self.threshold = max(self.threshold * 1.25, min(near, self.threshold * 2 if self.threshold else near), 1e-9)
        self._clear()
        self._cache = None
        self.insert(n, ls, ss)

    def rows(self, x: np.ndarray) -> FeatureTree:
        return self.insert(np.ones(len(x)), x, (x**2).sum(1))


def feature_leaves(vectors: DataFrame, budgets: dict[int, int], cells: Cells | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, linear sums, sums of squares) of the leaves of one tree for each node of `budgets`, which gives its number of
    leaves at most; so many entries reach the driver. Without cells all rows are under node 0; with them a row is under
    the cell it belongs to, and rows under other cells are left out."""

    def batch(part: int, trees: dict[int, FeatureTree]) -> Iterator[pa.RecordBatch]:
        for node, tree in trees.items():
            if len(tree.n):
                flat = pa.ListArray.from_arrays(np.arange(0, tree.ls.size + 1, tree.dims, np.int32), tree.ls.ravel())
                number = lambda v: pa.array(np.full(len(tree.n), v, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([number(part), number(node), pa.array(tree.n), flat, pa.array(tree.ss)], names=["part", "node", "n", "ls", "ss"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, FeatureTree] = {}
        for b in batches:
            if len(b):
                x = matrix(b.column("v"))
                home = np.zeros(len(x), np.int64) if cells is None else cells.home(x)[0]
                for node in np.unique(home).tolist():
                    if node in budgets:
                        trees.setdefault(node, FeatureTree(x.shape[1], budgets[node])).rows(x[home == node])
        yield from batch(TaskContext.get().partitionId(), trees)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of one partition come sorted by their new part and node; one tree is open at a time."""
        tree, now = None, None
        for b in batches:
            part, node = b.column("part").to_numpy(), b.column("node").to_numpy()
            cuts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(node, prepend=-1) != 0))
            for s, e in zip(cuts, [*cuts[1:], len(b)]):
                key = int(part[s]), int(node[s])
                if key != now:
                    yield from batch(now[0], {now[1]: tree}) if tree is not None else ()
                    tree, now = None, key
                own = b.slice(s, e - s)
                ls = matrix(own.column("ls"))
                tree = (tree or FeatureTree(ls.shape[1], budgets[key[1]])).insert(own.column("n").to_numpy(), ls, own.column("ss").to_numpy())
        yield from batch(now[0], {now[1]: tree}) if tree is not None else ()

    parts = vectors.rdd.getNumPartitions()
    out = written(vectors.select("v").mapInArrow(grow, LEAF), "leaves")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        tasks = min(parts * len(budgets), 4 * vectors.sparkSession.sparkContext.defaultParallelism)
        out = out.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).repartition(tasks, "part", "node").sortWithinPartitions("part", "node", "n", "ss").mapInArrow(merge, LEAF)
    got = out.toArrow()
    if not len(got):
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    return got.column("n").to_numpy(), matrix(got.column("ls")), got.column("ss").to_numpy()


def distinct_leaves(n: np.ndarray, ls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, centres) in a fixed order, leaves with nearly one centre united: the faces between such would be ill-defined."""
    centres = ls / n[:, None]
    order = np.lexsort(centres.T[::-1])
    n, centres = n[order], centres[order]
    kept = spread_centres(centres)
    home, _ = Cells(kept).home(centres)
    return np.bincount(home, n, len(kept)), kept


def refined_leaves(vectors: DataFrame, leaves: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, centres, tops) of the leaves of a tree, in which each leaf that holds far more than its share of the rows has become
    a tree of its own: with `cells` leaves in all, far-off rows don't leave the dense ones to a single leaf. tops: the centres
    of the first tree's leaves."""
    n, ls, _ = feature_leaves(vectors, {0: leaves})
    if not len(n):
        return n, ls, ls
    n, tops = distinct_leaves(n, ls)
    share = max(LEAST_SHARE, n.sum() / cells)
    heavy = np.flatnonzero(n > 2 * share)
    if not len(heavy):
        return n, tops, tops
    budgets = {int(i): int(max(2, n[i] / share)) for i in heavy}
    m, sub, _ = feature_leaves(vectors, budgets, Cells(tops))
    light = np.setdiff1d(np.arange(len(n)), heavy)
    return *distinct_leaves(np.concatenate([n[light], m]), np.vstack([tops[light] * n[light, None], sub])), tops


def leaf_features(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, means, sums of squared distances from the mean) of the rows that belong to each cell, from a pass over all rows; at
    most one row per cell reaches the driver. Cells without rows keep their centre."""
    dims = centres.shape[1]
    held = vectors.sparkSession.sparkContext.broadcast((Cells(centres), centres))
    names = ["leaf", "n", "ss", *(f"d{i}" for i in range(dims))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = held.value
        sums = np.zeros((len(centres), dims + 2))
        for b in batches:
            if len(b):
                x = matrix(b.column("v"))
                leaf, _ = cells.home(x)
                off = x - centres[leaf]
                np.add.at(sums, leaf, np.column_stack([np.ones(len(x)), (off**2).sum(1), off]))
        full = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(sums[full, i]) for i in range(dims + 2))], names=names)

    parts = vectors.select("v").mapInArrow(add, ", ".join(f"{c} {'int' if c == 'leaf' else 'double'}" for c in names))
    got = parts.groupBy("leaf").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    at = got.column("leaf").to_numpy()
    n, within, means = np.zeros(len(centres)), np.zeros(len(centres)), centres.copy()
    n[at] = got.column("n").to_numpy()
    off = np.column_stack([got.column(f"d{i}").to_numpy() for i in range(dims)]) / n[at, None]
    means[at] += off
    within[at] = np.maximum(got.column("ss").to_numpy() - n[at] * (off**2).sum(1), 0)
    return n, means, within


def ward(n: np.ndarray, centres: np.ndarray, clusters: int, within: np.ndarray | None = None, limit: float = np.inf, most: float = np.inf) -> np.ndarray:
    """Cluster number of each leaf: join the two whose union costs least until `clusters` are left, or until every union left
    would have a root mean square distance from its centre above `limit`, or more than `most` rows. within: each leaf's sum of
    squared distances. Each leaf remembers its cheapest partner, which is sought anew only when that one has changed."""
    n, c = n.astype(np.float64).copy(), centres.astype(np.float64).copy()
    within = np.zeros(len(n)) if within is None else within.astype(np.float64).copy()
    label, alive = np.arange(len(n)), np.ones(len(n), bool)
    cost = np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * c @ c.T, 0)
    cost *= n[:, None] * n[None] / (n[:, None] + n[None])

    def barred(rows: slice | int, costs: np.ndarray) -> np.ndarray:
        both = n[rows, None] + n[None] if isinstance(rows, slice) else n[rows] + n
        spread = within[rows, None] + within[None] if isinstance(rows, slice) else within[rows] + within
        return (spread + costs > limit**2 * both) | (both > most)

    for s in range(0, len(n), 256):
        part = cost[s : s + 256]
        part[barred(slice(s, s + 256), part)] = np.inf
    np.fill_diagonal(cost, np.inf)
    best = cost.argmin(1) if len(n) else label
    least = cost[np.arange(len(n)), best]
    for _ in range(max(0, len(n) - clusters)):
        i = int(least.argmin())
        i, j = sorted((i, int(best[i])))
        if not np.isfinite(cost[i, j]):
            break
        within[i] += within[j] + cost[i, j]
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        label[label == j] = i
        cost[j, :] = cost[:, j] = np.inf
        alive[j], least[j] = False, np.inf
        row = ((c - c[i]) ** 2).sum(1) * n * n[i] / (n + n[i])
        row[~alive | barred(i, row)] = np.inf
        row[i] = np.inf
        cost[i, :] = cost[:, i] = row
        nearer = row < least
        best[nearer], least[nearer] = i, row[nearer]
        for k in np.flatnonzero(alive & ~nearer & ((best == i) | (best == j))).tolist() + [i]:
            best[k] = cost[k].argmin()
            least[k] = cost[k, best[k]]
    return np.unique(label, return_inverse=True)[1]


def leaf_blocks(vectors: DataFrame, rows: int, leaf_rows: int, block_rows: int) -> tuple[Cells, np.ndarray, np.ndarray] | None:
    """(cells, block of each leaf, rows of each block): leaves of about `leaf_rows` rows, up to MOST_CELLS of them, joined by Ward
    to blocks of at most `block_rows` (a leaf that holds more is a block). Where Ward can't take all leaves at once, it joins
    those of one branch of the first tree. None without rows."""
    wanted = int(min(max(rows // leaf_rows, 1), MOST_CELLS))
    n, centres, tops = refined_leaves(vectors, min(LEAVES, wanted), wanted)
    if not len(n):
        return None
    branch = np.zeros(len(n), np.int64) if len(n) <= WARD_LEAVES else Cells(tops).home(centres)[0]
    block, blocks = np.zeros(len(n), np.int64), 0
    for b in np.unique(branch):
        own = np.flatnonzero(branch == b)
        for s in range(0, len(own), WARD_LEAVES):
            part = own[s : s + WARD_LEAVES]
            block[part] = ward(n[part], centres[part], 1, most=block_rows) + blocks
            blocks = int(block[part].max()) + 1
    return Cells(centres), block, np.bincount(block, n)


@dataclass(frozen=True)
class Clustering:
    """cells: the leaves; cluster: leaf -> cluster; centres: of the clusters. rows: (id, v, leaf, cluster, distance)."""

    cells: Cells
    cluster: np.ndarray
    centres: np.ndarray
    rows: DataFrame

    def described(self, members: int = 3) -> DataFrame:
        """(cluster, size, mean_distance, rank, id, distance): each cluster's size, the mean distance from its centre, and
        its `members` rows nearest to the centre, ties to the smaller id."""
        size = self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("distance").alias("mean_distance"))
        typical = self.rows.select("cluster", "id", "distance").withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "id"))).where(F.col("rank") <= members)
        return typical.join(size, "cluster").select("cluster", "size", "mean_distance", "rank", "id", "distance")

    def divided(self, members: int = 3) -> DataFrame:
        """described, with one row for every row: rank is null beyond the `members` nearest to the centre. Rows of one id and
        one distance share a rank."""
        rows = written(self.rows.select("cluster", "id", "distance"), "divided")
        near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "id"))).where(F.col("rank") <= members)
        near = near.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("_near"))
        groups = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("distance").alias("mean_distance")).join(near, "cluster")
        # one row per cluster, of which there are no more than leaves
        place = F.array_position("_near", F.struct("distance", "id")).cast("int")
        return rows.join(F.broadcast(groups), "cluster").select("cluster", "size", "mean_distance", F.when(place > 0, place).alias("rank"), "id", "distance")


def cluster_rows(vectors: DataFrame, clusters: int = CLUSTERS, leaves: int = LEAVES, cells: int = WARD_LEAVES // 2, limit: float | None = None) -> Clustering | None:
    """Divide the rows of (id, v) into at most `clusters` clusters. None if there are no rows.

    With a limit the number of clusters follows from the rows: no leaves are joined to a cluster whose root mean square
    distance from its centre is above it. There are as many clusters as leaves at most; a leaf that is wider alone stays one.
    Equal vectors share a cluster. The leaves depend on how rows lie in partitions; all rows take part. Rows with equal
    ids are rows of their own.
    """
    n, centres, _ = refined_leaves(vectors, leaves, cells)
    if not len(n):
        return None
    if limit is None:
        label, inner = ward(n, centres, clusters), centres
    else:
        n, inner, within = leaf_features(vectors, centres)
        full = n > 0
        label = np.zeros(len(n), np.int64)
        label[full] = ward(n[full], inner[full], 1, within[full], limit)
    means = np.array([np.average(inner[label == k], axis=0, weights=n[label == k]) for k in range(label.max() + 1)])
    held = vectors.sparkSession.sparkContext.broadcast((Cells(centres), label, means))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, label, means = held.value
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column("v"))
            leaf, _ = cells.home(x)
            distance = np.sqrt(((x - means[label[leaf]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(leaf.astype(np.int32)), pa.array(label[leaf].astype(np.int32)), pa.array(distance)], names=["id", "v", "leaf", "cluster", "distance"])

    rows = vectors.select("id", "v").mapInArrow(assign, "id long, v array<double>, leaf int, cluster int, distance double")
    return Clustering(Cells(centres), label, means, rows)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): the links (a, b) as links of each node to the smallest of its component; roots have no row."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def linked_groups(vectors: DataFrame, radius: float, least: int, leaf_rows: int = LEAF_ROWS, block_rows: int = CELL_ROWS) -> DataFrame:
    """(group_id, id) of the groups of rows of (id, v) connected through pairs at most `radius` apart, with at least `least`
    rows; one row for each row of such a group, group_id is its smallest id. Empty input gives no rows.

    Rows are assigned to the leaves of a cluster-feature tree and meet in the block to which Ward has joined their leaf; rows
    at the border of another block visit it, so no pair is lost, and the distances of the pairs that meet are exact. Rows with
    equal vectors are one node with their number as weight. A local cell passes on one link per node, never all pairs of a
    dense group.
    """
    counted = vectors.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    # two rows of one id with different vectors are told apart by the node number
    nodes = written(counted.select(F.monotonically_increasing_id().alias("node"), "id", "v", "rows"), "nodes")
    points = nodes.select(F.col("node").alias("id"), "v")
    made = leaf_blocks(points, nodes.count(), leaf_rows, block_rows)
    if made is None:
        return vectors.select(F.col("id").alias("group_id"), "id").where("false")
    cells, block, size = made

    def forest(tile: pa.Table) -> pa.RecordBatch:
        links = [stars(i, j) for i, j, _ in tile_meetings(tile, radius)]
        a, b = (np.concatenate(c) for c in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
        ids = tile.column("id").to_numpy()
        a, b = stars(ids[a], ids[b])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = np.maximum(1, np.ceil(size / TILE)).astype(np.int64)
    roots = connected(over_groups(assigned(points, cells, radius, parts, block), TILE_KEYS, "a long, b long", forest))
    members = nodes.select("node", "id", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = members.groupBy("root").agg(F.sum("rows").alias("size"), F.min("id").alias("group_id")).where(F.col("size") >= least)
    chosen = written(members.join(sizes, "root").select("node", "id", "rows", "group_id"), "groups")
    single = chosen.where("rows = 1").select("group_id", "id")
    several = chosen.where("rows > 1").select("node", "group_id")
    if several.isEmpty():
        return single
    copies = written(nodes.where("rows > 1").select("node", "v").join(several, "node").select("v", "group_id"), "copies")
    return single.unionByName(sized_join(vectors.select("id", "v"), copies, ["v"], "inner", ["id"]).select("group_id", "id"))


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node that has an edge. Alternates the large-star
    and small-star steps, each two groupings; every step's edges are written."""

    def settled(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = settled(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = written(small, "small_star")
        now = settled(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
