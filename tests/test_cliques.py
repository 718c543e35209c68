"""Components by clique cells and what is built on them, against all pairs."""

from itertools import combinations

import numpy as np
import pytest

from gridjobs.operators import baselines, cliques, labelling, neighbors


def roots(xyz, r):
    """Smallest reachable row for each row, from all pairs."""
    a, b = zip(*combinations(range(len(xyz)), 2), strict=True)
    a, b = np.array(a), np.array(b)
    near = ((xyz[a] - xyz[b]) ** 2).sum(1) <= r * r
    parent = list(range(len(xyz)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return [find(v) for v in range(len(xyz))]


def spots(rng, n, dims):
    """Even spread, hot spots, lattice points that touch at just the radius, and lines."""
    return np.vstack([
        rng.uniform(-4, 4, (n, dims)),
        rng.normal(0, 1, (4, dims)).repeat(n // 2, 0) + rng.normal(0, 1e-6, (2 * n // 2 * 2, dims)),
        rng.normal(3, 0.25, (n, dims)),
        rng.integers(-3, 3, (n, dims)) * 0.5,
        np.arange(n)[:, None] * np.full((1, dims), 0.3 / dims**0.5) - 6,
    ])


@pytest.mark.parametrize("dims,seed,full,tile", [(3, 0, 64, 24), (3, 1, 3, 2), (2, 2, 1, 3), (2, 3, 64, 128), (1, 4, 2, 5), (3, 5, 1, 4)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, dims, seed, full, tile):
    monkeypatch.setattr(cliques, "FULL", full)
    monkeypatch.setattr(cliques, "BLOCK", 50)
    monkeypatch.setattr(cliques, "PART", 7)
    rng = np.random.default_rng(seed)
    x = spots(rng, 60, dims)
    x = x[rng.permutation(len(x))]
    names = ["x", "y", "z"][:dims]
    for r in (0.31, 0.5)[seed % 2 :][:1]:
        rows = [(k % 2, k, *map(float, v)) for k, v in enumerate(x)]
        bad = [(0, 10_000, *[float("nan")] * dims), (1, 10_001, *[None] * dims)]
        p = spark.createDataFrame(rows + bad, f"step int, atom_id long, {', '.join(f'{c} double' for c in names)}")
        got = {r_["atom_id"]: r_["root"] for r_ in cliques.clique_components(p, r, ["step"], names, tile=tile).collect()}
        want = {10_000: 10_000, 10_001: 10_001}
        for s in (0, 1):
            own = [k for k in range(len(x)) if k % 2 == s]
            want |= {k: own[m] for k, m in zip(own, roots(x[own], r), strict=True)}
        assert got == want


def test_open_pairs_of_full_buckets_are_searched_point_by_point(spark, monkeypatch):
    monkeypatch.setattr(cliques, "FULL", 8)
    monkeypatch.setattr(cliques, "PART", 5)
    rng = np.random.default_rng(0)
    ring = lambda n: np.stack([np.cos(np.arange(n) * 2 * np.pi / n), np.sin(np.arange(n) * 2 * np.pi / n)], 1) * 0.33
    seen = []
    kept = cliques._searched
    monkeypatch.setattr(cliques, "_searched", lambda *a: (seen.append(a[1].count()), kept(*a))[1])
    for gap in (1.04, 1.2, 1.35):
        x = np.vstack([ring(40) + 0.35, ring(40)[rng.permutation(40)] + [0.35 + gap, 0.35 + gap / 2]])
        p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "atom_id long, x double, y double")
        got = [r["root"] for r in cliques.clique_components(p, 1.0, (), ("x", "y")).orderBy("atom_id").collect()]
        assert got == roots(x, 1.0)
    assert seen is not None


def test_a_spot_of_many_points_makes_few_edges(spark):
    """Half of all points in one spot and a dense ball: what tiles tell of rims and open pairs stays in proportion to buckets."""
    rng = np.random.default_rng(1)
    x = np.vstack([np.full((4_000, 3), 0.4) + rng.normal(0, 1e-7, (4_000, 3)), rng.normal(5, 0.5, (4_000, 3))])
    p = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(x)], "step int, atom_id long, x double, y double, z double")
    got = {r["atom_id"]: r["root"] for r in cliques.clique_components(p, 0.4, ["step"]).collect()}
    assert {got[k] for k in range(4_000)} == {0}
    assert [got[k] - 4_000 for k in range(4_000, 8_000)] == roots(x[4_000:], 0.4)


def test_no_points_and_no_radius(spark):
    p = spark.createDataFrame([], "step int, atom_id long, x double, y double, z double")
    assert cliques.clique_components(p, 1.0, ["step"]).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        cliques.clique_components(p, 0.0)


def test_atoms_below_or_without_a_label_are_left_out(spark):
    rows = [(0, 5, 0.0, 0.0, 0.0, 0.9), (0, 2, 1.0, 0.0, 0.0, 0.5), (0, 9, 2.0, 0.0, 0.0, 0.9), (0, 7, 9.0, 0.0, 0.0, None), (1, 5, 0.0, 0.0, 0.0, 0.5)]
    a = spark.createDataFrame(rows, "step int, atom_id long, x double, y double, z double, c_label double")
    got = lambda **o: {(r["step"], r["atom_id"]): r["label"] for r in labelling.atom_components(a, **o).collect()}
    assert got(cutoff=1.5) == {(0, 5): 1, (0, 2): 1, (0, 9): 1, (0, 7): 2, (1, 5): 1}
    assert got(cutoff=1.5, thr=0.5) == {(0, 5): 1, (0, 2): 1, (0, 9): 1, (0, 7): 0, (1, 5): 1}
    assert got(cutoff=1.5, thr=0.5, strict=True) == {(0, 5): 0, (0, 2): -1, (0, 9): 1, (0, 7): -1, (1, 5): -1}


@pytest.mark.parametrize("seed,min_pts", [(0, 1), (1, 4), (2, 12)])
def test_dbscan_equals_the_definition(spark, monkeypatch, seed, min_pts):
    monkeypatch.setattr(cliques, "FULL", 5)
    monkeypatch.setattr(neighbors, "PART", 20)
    rng = np.random.default_rng(seed)
    x = spots(rng, 50, 2)
    eps = 0.35
    p = spark.createDataFrame([(k, float(a), float(b), 1) for k, (a, b) in enumerate(x)], "point_id long, x double, y double, truth int")
    got = {r["point_id"]: r["label"] for r in baselines.dbscan_labels(p, eps, min_pts).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = np.nonzero(near.sum(1) >= min_pts)[0]
    root = dict(zip(core.tolist(), core[roots(x[core], eps)].tolist(), strict=True)) if len(core) > 1 else {int(c): int(c) for c in core}
    number = {r: n for n, r in enumerate(sorted(set(root.values())))}
    want = {k: number[r] for k, r in root.items()}
    for k in range(len(x)):
        if k not in root:
            want[k] = min((want[c] for c in core.tolist() if near[k, c]), default=-1)
    assert got == want
