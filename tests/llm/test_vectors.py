import random

import numpy as np
import pytest

from tablewright.llm import clusters as G
from tablewright.llm import vectors as V


def frame(spark, x, ids=None, parts=3):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)


def blobs(n, dims=6, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 4, (n, 1)) * 3
    if copies:
        x[rng.integers(0, n, copies)] = x[rng.integers(0, 3, copies)]
    return x


def nearest(x, k, radius=np.inf):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i and d[j] <= radius][:k]
        out[i] = order
    return out


def test_int8_bound_loses_no_pair():
    for scale in (1e-3, 1.0, 1e4):
        x = blobs(400) * scale
        x[0] *= 50
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        got = {(i, j) for a, b, _ in V.within(x, x, 0.9 * scale) for i, j in zip(a, b)}
        assert got == set(zip(*np.nonzero(d <= 0.9 * scale)))


@pytest.mark.parametrize("tile", [100_000, 40])
def test_similar_rows_are_the_k_nearest_within_the_radius(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "CELL_ROWS", 90)
    monkeypatch.setattr(V, "NEAR", 20)
    x = blobs(500, copies=60)
    got = {}
    for r in sorted(V.similar_rows(frame(spark, x), 4, 1.2).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.other)
        assert r.distance == pytest.approx(np.sqrt(((x[r.id] - x[r.other]) ** 2).sum()))
    assert got == {i: o for i, o in nearest(x, 4, 1.2).items() if o}


def test_a_third_of_copies_and_repeated_ids(spark):
    x = np.vstack([blobs(60), np.tile(np.ones(6), (60, 1))])
    got = {}
    for r in V.similar_rows(frame(spark, x), 3, 0.5).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got[100] == {60, 61, 62} and got[60] == {61, 62, 63}
    twice = V.similar_rows(frame(spark, np.vstack([np.zeros(3), np.zeros(3), np.full(3, 0.1)]), [7, 7, 8]), 3, 1.0).collect()
    assert sorted((r.id, r.other) for r in twice) == [(7, 8), (8, 7)]


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 40)
    monkeypatch.setattr(V, "TILE", 30)
    x = blobs(400, copies=40)
    df = frame(spark, x)
    want = nearest(x, 5)
    got = {}
    for r in sorted(V.search(df.where("id % 20 = 0"), df, 5).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.other)
    assert got == {i: want[i] for i in range(0, 400, 20)}
    assert V.search(df.where("false"), df, 5).count() == 0 and V.search(df.where("id = 1"), df.where("id = 1"), 5).count() == 0


def test_search_with_repeated_ids(spark, monkeypatch):
    """Copies of a query don't push its neighbours out, and a repeated neighbour takes one place."""
    monkeypatch.setattr(V, "CELL_ROWS", 40)
    monkeypatch.setattr(V, "TILE", 30)
    x = np.vstack([blobs(300), np.tile(blobs(300)[:1], (30, 1)), blobs(300)[20:60] + 0.01])
    ids = [*range(300), *[0] * 30, *range(20, 60)]
    df = frame(spark, x, ids, parts=2)
    got = {}
    for r in sorted(V.search(df.where("id % 20 = 0"), df, 5).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.other)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    least = np.full((300, 300), np.inf)
    np.minimum.at(least, (np.array(ids)[:, None], np.array(ids)[None]), d)
    np.fill_diagonal(least, np.inf)
    assert got == {i: np.lexsort((np.arange(300), least[i]))[:5].tolist() for i in range(0, 300, 20)}


def test_incomplete_rows_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 2.0]), (7, [3.0, 4.0]), (7, [3.0, 4.0])]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "id long, r array<double>, v string")
    got = sorted((r.id, r.v) for r in V.scaled_vectors(df, "id", [("r", 1.0, 2.0)], 2).collect())
    assert got == [(1, [0.0, 0.5]), (7, [1.0, 1.5]), (7, [1.0, 1.5])]
    empty = V.scaled_vectors(df.where("false"), "id", [("r", 0, 1)], 2)
    assert V.similar_rows(empty, 3, 1.0).count() == 0 and G.cluster_rows(empty) is None


# clusters


def test_features_add_up():
    x = blobs(3000)
    tree = G.FeatureTree(6, 40).rows(x)
    assert len(tree.n) <= 40 and tree.n.sum() == 3000
    assert np.allclose(tree.ls.sum(0), x.sum(0)) and tree.ss.sum() == pytest.approx((x**2).sum())
    other = G.FeatureTree(6, 40).rows(blobs(500, seed=1))
    merged = tree.insert(other.n, other.ls, other.ss)
    assert merged.n.sum() == 3500 and len(merged.n) <= 40


def test_copies_need_one_leaf():
    tree = G.FeatureTree(3, 8).rows(np.tile([1.0, 2.0, 3.0], (5000, 1)))
    assert tree.n.sum() == 5000 and len(tree.n) <= 8


def test_ward_joins_the_nearest():
    assert G.ward(np.ones(5), np.array([[0.0], [0.1], [5.0], [5.1], [9.0]]), 3).tolist() == [0, 0, 1, 1, 2]


def test_every_row_has_its_cluster(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6)) * 40
    truth = rng.integers(0, 4, 800)
    x = centres[truth] + rng.normal(size=(800, 6))
    made = G.cluster_rows(frame(spark, x), clusters=4, leaves=60)
    rows = {r.id: r.cluster for r in made.rows.collect()}
    assert len(rows) == 800 and len({(truth[i], c) for i, c in rows.items()}) == 4
    shown = made.described(3).collect()
    assert sum(r["size"] for r in shown if r["rank"] == 1) == 800 and len(shown) == 12
    for r in shown:
        own = [i for i in rows if rows[i] == r.cluster]
        d = np.sqrt(((x[own] - x[own].mean(0)) ** 2).sum(1))
        assert r.id == own[np.lexsort((own, d))[r["rank"] - 1]]


def test_the_number_of_clusters_follows_from_the_limit(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 40
    truth = rng.integers(0, 40, 1200)
    x = centres[truth] + rng.normal(size=(1200, 6)) * 0.2
    rows = G.cluster_rows(frame(spark, x), limit=2.0).divided(3).collect()
    assert sorted(r.id for r in rows) == list(range(1200))
    assert len({(truth[r.id], r.cluster) for r in rows}) == len({r.cluster for r in rows}) == 40
    for c in {r.cluster for r in rows}:
        own = [r for r in rows if r.cluster == c]
        ids = [r.id for r in own]
        d = np.sqrt(((x[ids] - x[ids].mean(0)) ** 2).sum(1))
        assert [r.distance for r in own] == pytest.approx(d) and {r["size"] for r in own} == {len(own)} and np.sqrt((d**2).mean()) <= 2.0
        typical = sorted((r["rank"], r.id) for r in own if r["rank"])
        assert typical == [(k + 1, ids[i]) for k, i in enumerate(np.lexsort((ids, d))[:3])]


def test_p6_clusters_has_every_complete_row(spark, sf):
    from tablewright.llm import queries as L

    got = sorted(r.vec_id for r in L.p6_clusters(spark, sf).collect())
    assert got == sorted(r.id for r in L.profile_vectors(spark, sf, L.P6_FIELDS).collect())


def components(x, ids, radius, least):
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, j in zip(*np.nonzero(d <= radius)):
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(x)):
        groups.setdefault(root(i), []).append(ids[i])
    return sorted((min(g), i) for g in groups.values() if len(g) >= least for i in g)


@pytest.mark.parametrize("tile", [100_000, 30])
def test_linked_groups_are_the_components(spark, monkeypatch, tile):
    monkeypatch.setattr(G, "TILE", tile)
    monkeypatch.setattr(V, "NEAR", 25)
    x = blobs(400, dims=4, seed=4, copies=50)
    chain = np.column_stack([np.arange(80) * 0.45 - 20, np.full((80, 3), 30.0)])
    x = np.vstack([x, chain])
    ids = random.Random(0).sample(range(10_000), len(x))
    got = sorted((r.group_id, r.id) for r in G.linked_groups(frame(spark, x, ids), 0.5, 5, leaf_rows=15, block_rows=60).collect())
    assert got == components(x, ids, 0.5, 5) and len(got) > 100


def test_connected(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.root for r in G.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                i = todo.pop()
                if i not in want:
                    want[i] = n
                    todo += near[i]
    assert got == want
    assert G.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_centres_lose_no_visit(monkeypatch):
    x = blobs(900, seed=6)
    x[:5] *= 300
    plain = V.Cells(x[::9])
    monkeypatch.setattr(V, "PLAIN", 10)
    grouped = V.Cells(x[::9])
    assert plain.tops is None and grouped.tops is not None
    for radius in (0.3, np.where(np.arange(900) % 50, 1.0, np.inf)):
        for every in (False, True):
            a, b = (c.visits(x, radius, every=every) for c in (plain, grouped))
            assert (a[0] == b[0]).all() and sorted(zip(a[1], a[2])) == sorted(zip(b[1], b[2]))
    assert np.allclose(plain.home(x)[1], grouped.home(x)[1])


def test_local_cells_meet_each_pair_once():
    x = blobs(1500, dims=3, seed=7)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    resident = np.arange(1500) % 3 > 0
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.4)) if i < j and (resident[i] or resident[j])}
    got = [(min(i, j), max(i, j)) for a, b, _ in V.meetings(x, resident, None, 0.4) for i, j in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_compared_per_row_do_not_grow(monkeypatch):
    """Ten and forty times the rows of one cell, at the density that the readings of more stays have: the products stay as wide."""
    compared = [0]
    plain = V.within

    def counted(a, b, radius):
        compared[0] += len(a) * (len(a) if b is None else len(b))
        return plain(a, b, radius)

    monkeypatch.setattr(V, "within", counted)
    per_row = {}
    for n in (2_000, 20_000, 80_000):
        rng = np.random.default_rng(n)
        x = np.repeat(rng.normal(size=(n, 3)), 8, 1) * 3 + rng.normal(size=(n, 24)) * 0.3
        compared[0] = 0
        for _ in V.meetings(x, np.ones(n, bool), None, 0.35):
            pass
        per_row[n] = compared[0] / n
    assert per_row[20_000] < 1.5 * per_row[2_000] and per_row[80_000] < 1.5 * per_row[20_000], per_row


def test_stars():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    a, b = np.append(a, np.arange(600, 700)), np.append(b, np.arange(601, 701))
    node, root = G.stars(a, b)
    got, near = dict(zip(node.tolist(), root.tolist())), {}
    for i, j in zip(a.tolist(), b.tolist()):
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    seen = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = i
                todo += near[k]
    assert got == {k: r for k, r in seen.items() if k != r}


def test_a_component_of_a_third_of_the_rows(spark):
    ball = np.random.default_rng(9).normal(size=(300, 4)) * 0.05
    x = np.vstack([ball, blobs(600, dims=4, seed=10) + 40])
    ids = list(range(len(x)))
    got = sorted((r.group_id, r.id) for r in G.linked_groups(frame(spark, x, ids), 0.5, 5, leaf_rows=15, block_rows=60).collect())
    assert got == components(x, ids, 0.5, 5) and sum(g == 0 for g, _ in got) == 300


def test_ward_keeps_blocks_below_their_limit():
    rng = np.random.default_rng(11)
    n, c = rng.integers(1, 40, 300), rng.normal(size=(300, 5))
    label = G.ward(n, c, 1, most=100)
    size = np.bincount(label, n)
    assert size.max() <= 100 and len(size) < 2 * n.sum() / 50
