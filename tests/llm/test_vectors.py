import numpy as np
import pytest

from meshwork.llm import vectors


def brute(rows, least=0.95):
    good = []
    for k, (_, v) in enumerate(rows):
        x = None if v is None or len(v) != 8 or any(c is None for c in v) else np.array(v, dtype=float)
        good.append(None if x is None or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] is not None and good[j] is not None and good[i] @ good[j] >= least:
                links[i] += 1
                links[j] += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    least_id = {}
    for i, (v, _) in enumerate(rows):
        least_id[root(i)] = min(least_id.get(root(i), v), v)
    return sorted((v, links[i], least_id[root(i)], v == least_id[root(i)]) for i, (v, _) in enumerate(rows))


def data(seed, n=260, spread=0.12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, 8))
    x = base[rng.integers(0, len(base), n)] + spread * rng.normal(size=(n, 8))
    x[::17] = x[0]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


EDGES = [(900, None), (901, []), (902, [0.0] * 8), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1.0, 2.0])]


@pytest.mark.parametrize("cell,tile,spread", [(8192, 16384, 0.12), (16, 16384, 0.05), (40, 10, 0.12), (16, 7, 0.3)])
def test_against_all_pairs(spark, monkeypatch, cell, tile, spread):
    monkeypatch.setattr(vectors, "CELL_POINTS", cell)
    monkeypatch.setattr(vectors, "TILE_POINTS", tile)
    monkeypatch.setattr(vectors, "LEAF_POINTS", 4)
    rows = data(cell, spread=spread) + EDGES
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, point int, home int").repartition(3)
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == brute(rows)


def compared(tree):
    """Pairs of centres and of points that a traversal of the tree with itself looks at."""
    centres = points = 0
    stack = [(0, 0)]
    while stack:  # all pairs of nodes that the walk would open
        x, y = stack.pop()
        cx, cy = tree.children[x], tree.children[y]
        if not len(cx) and not len(cy):
            points += len(tree.members[x]) * len(tree.members[y])
            continue
        cx, cy = (c if len(c) else np.array([n]) for c, n in ((cx, x), (cy, y)))
        centres += len(cx) * len(cy)
        away = vectors._apart(tree.points[[tree.centres[c] for c in cx]], tree.points[[tree.centres[c] for c in cy]])
        for i, j in zip(*np.nonzero(away <= np.array(tree.radii)[cx][:, None] + np.array(tree.radii)[cy] + tree.reach)):
            if x != y or i <= j:
                stack.append((cx[i], cy[j]))
    return centres, points


def test_tree_prunes_clustered_points_and_keeps_levels_of_scattered_ones():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    close = base[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 64))
    scattered = rng.normal(size=(1000, 64))
    trees = []
    for x in (close, scattered):
        x /= np.linalg.norm(x, axis=1)[:, None]
        tree = vectors.CoverTree(x, np.sqrt(0.1))
        trees.append(tree)
        leaves = [tree.members[k] for k in range(len(tree.radii)) if not len(tree.children[k])]
        assert sorted(np.concatenate(leaves)) == list(range(len(x)))
        for k, parts in enumerate(tree.children):
            assert (vectors._apart(tree.points[tree.members[k]], tree.points[[tree.centres[k]]]) <= tree.radii[k] + 1e-7).all()
            assert all(tree.radii[c] <= tree.radii[k] / 2 + 1e-4 for c in parts)
        found = {tuple(sorted(p)) for i, j in vectors.link_tiles(x, None, 0.95) for p in zip(i.tolist(), j.tolist())}
        i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        assert found == set(zip(i.tolist(), j.tolist()))
    assert sum(compared(trees[0])) < 0.06 * 3000 * 3000
    # scattered points are balls of their own: their centres are compared, and hardly any points after that
    assert len(trees[1].radii) == 1001 and compared(trees[1])[1] < 0.01 * 1000 * 1000


def test_rows_without_an_id_link_with_nothing(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=repr)
    assert got == sorted([(None, 0, None, True)] * 2 + [(1, 1, 1, True), (2, 1, 1, False)], key=repr)


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_width_is_searched(spark):
    rng = np.random.default_rng(8)
    rows = []
    for width, n in ((8, 60), (5, 55), (64, 3), (1, 4)):
        base = rng.normal(size=(max(2, n // 6), width))
        for _ in range(n):
            v = base[rng.integers(0, len(base))] + 0.1 * rng.normal(size=width)
            rows.append((len(rows), [float(np.float32(c)) for c in v]))
    expected = []
    for width in (8, 5, 64, 1):
        mine = [r for r in rows if len(r[1]) == width]
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v in mine}
        links = {i: [j for j in unit if j != i and unit[i] @ unit[j] >= 0.95] for i in unit}
        for i in unit:
            reached, new = {i}, [i]
            while new:
                new = [j for k in new for j in links[k] if j not in reached]
                reached |= set(new)
            expected.append((i, len(links[i]), min(reached), i == min(reached)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == sorted(expected)


def test_a_large_group_of_near_copies_is_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_PAIRS", 500)
    rng = np.random.default_rng(2)
    units = rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(300, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    copies = rng.integers(1, 4, 300)
    links, label = vectors.tile_links(units, copies, np.arange(300), None, 0.95)
    near = units @ units.T >= 0.95
    np.fill_diagonal(near, False)
    assert (links == near @ copies).all() and len(set(label)) == 1
    pairs = rng.integers(0, 300, (2, 260))
    found = np.arange(300)
    vectors.unite(*pairs, found)
    plain = list(range(300))
    for _ in range(300):
        for a, b in pairs.T:
            plain[a] = plain[b] = min(plain[a], plain[b])
    assert found.tolist() == plain


def test_each_vector_is_stored_once_for_all_its_comparisons(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_POINTS", 50)
    monkeypatch.setattr(vectors, "TILE_POINTS", 20)
    folders, plain = [], vectors.new_path
    monkeypatch.setattr(vectors, "new_path", lambda session, label: folders.append(plain(session, label)) or folders[-1])
    x = np.random.default_rng(3).normal(size=(400, 8))
    x[300:] = x[:100] + 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(rows).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert found == dict(enumerate(((unit @ unit.T >= 0.95).sum(1) - 1).tolist()))
    assert [spark.read.parquet(f).count() for f in folders if "/tiles-" in f] == [400]
