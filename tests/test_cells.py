"""Cell labelling, growth, diffusion and components against plain loops over dense arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridjobs.functions.kernels import label_2d
from gridjobs.operators import diffusion, labelling, matching
from gridjobs.operators.components import components
from gridjobs.operators.diffusion import diffuse_free_3d, diffuse_masked_2d, impute_3d
from gridjobs.operators.grid import full_lattice, normalize_nonzero
from gridjobs.operators.labelling import cell_components, cell_components_3d, seeded_components

STEPS = {4: [(1, 0), (-1, 0), (0, 1), (0, -1)], 8: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]}


def flood(mask, connectivity, wrap):
    nx, ny = mask.shape
    out, k = -np.ones(mask.shape, int), 0
    for i in range(nx):
        for j in range(ny):
            if mask[i, j] and out[i, j] < 0:
                todo, out[i, j] = [(i, j)], k
                while todo:
                    x, y = todo.pop()
                    for a, b in STEPS[connectivity]:
                        u, v = x + a, y + b
                        if wrap:
                            u, v = u % nx, v % ny
                        if 0 <= u < nx and 0 <= v < ny and mask[u, v] and out[u, v] < 0:
                            out[u, v] = k
                            todo.append((u, v))
                k += 1
    return out


def raster(selected, dense, connectivity, wrap, max_passes):
    """Growth by its rule: a pass visits the open cells in raster order, and what it gives a cell counts at once for the next."""
    nx, ny = selected.shape
    label = dict(np.ndenumerate(flood(dense, connectivity, wrap)))
    around = lambda i, j: {label.get(((i + a) % nx, (j + b) % ny) if wrap else (i + a, j + b), -1) for a, b in STEPS[connectivity]} - {-1}

    def visit(waiting):
        for cell in waiting:
            if len(names := around(*cell)) == 1:
                label[cell] = names.pop()
        return [c for c in waiting if label[c] < 0]

    waiting = [c for c, on in np.ndenumerate(selected) if on and label[c] < 0]
    for _ in range(max_passes if max_passes is not None else nx * ny):
        waiting, before = visit(waiting), len(waiting)
        if len(waiting) == before:
            break
    return np.array([[label[i, j] for j in range(ny)] for i in range(nx)])


def table(spark, runs):
    """runs: run -> dict of arrays; cells where any boolean array is true, or all where there is none."""
    rows = []
    for r, arrays in enumerate(runs):
        shape = next(iter(arrays.values())).shape
        for i in range(shape[0]):
            for j in range(shape[1]):
                v = [a[i, j] for a in arrays.values()]
                if any(isinstance(x, np.bool_) and x for x in v) or not any(isinstance(x, np.bool_) for x in v):
                    rows.append((r, i, j, *shape, *(x.item() for x in v)))
    names = ["run", "i", "j", "nx", "ny", *runs[0]]
    kinds = ["int"] * 5 + ["boolean" if a.dtype == bool else "double" for a in runs[0].values()]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


@pytest.mark.parametrize(("connectivity", "wrap"), [(4, False), (4, True), (8, False), (8, True)])
def test_labels_match_flood_fill_tiled_or_not(spark, connectivity, wrap):
    rng = np.random.default_rng(connectivity + wrap)
    shapes = [(9, 13), (1, 7), (2, 5), (12, 3), (6, 6)]
    masks = [rng.random(s) < 0.5 for s in shapes]
    for m in masks:
        i, j = np.nonzero(m)
        got = label_2d(i, j, *m.shape, connectivity, wrap)
        want = flood(m, connectivity, wrap)[i, j]
        assert len(set(zip(got, want, strict=True))) == len(set(want))
    cells = table(spark, [{"selected": m} for m in masks])
    for tile in (512, 4):
        got = {(r["run"], r["i"], r["j"]): r["label"] for r in cell_components(cells, ["run"], connectivity, wrap, tile).collect()}
        for r, m in enumerate(masks):
            want = flood(m, connectivity, wrap)
            assert {k: v for k, v in got.items() if k[0] == r} == {(r, i, j): want[i, j] for i, j in zip(*np.nonzero(m), strict=True)}


@pytest.mark.parametrize(("connectivity", "wrap", "max_passes"), [(4, False, None), (8, True, None), (4, True, 2)])
def test_growth_matches_raster_sweeps(spark, connectivity, wrap, max_passes):
    rng = np.random.default_rng(7)
    runs = []
    for _ in range(12):
        dense = rng.random((8, 9)) < 0.15
        runs.append({"selected": (rng.random((8, 9)) < 0.6) | (dense & (rng.random((8, 9)) < 0.8)), "dense": dense})
    got = {(r["run"], r["i"], r["j"]): r["label"] for r in seeded_components(table(spark, runs), ["run"], connectivity, wrap, max_passes).collect()}
    for r, a in enumerate(runs):
        want = raster(a["selected"], a["dense"], connectivity, wrap, max_passes)
        on = a["selected"] | a["dense"]
        assert {k: v for k, v in got.items() if k[0] == r} == {(r, i, j): want[i, j] for i, j in zip(*np.nonzero(on), strict=True)}


@pytest.mark.parametrize("connectivity, wrap, max_passes", [(4, False, None), (8, True, 3)])
def test_growth_over_tiles_matches_raster_sweeps(spark, connectivity, wrap, max_passes, monkeypatch):
    rng = np.random.default_rng(3)
    runs = []
    for n in range(3):
        dense = rng.random((17, 19)) < 0.04
        runs.append({"selected": (rng.random((17, 19)) < 0.5 + 0.2 * n) | dense, "dense": dense})
    snake = np.ones((17, 19), bool)  # a way back and forth through the tiles, with an origin at each end
    snake[1::6, :-1] = snake[4::6, 1:] = False
    ends = np.zeros_like(snake)
    ends[0, 0] = ends[16, 9] = True
    runs.append({"selected": snake, "dense": ends})
    by, tiles = [], labelling._grow_tiles
    monkeypatch.setattr(labelling, "_grow_tiles", lambda *a: by.append(a[-1]) or tiles(*a))
    got = {(r["run"], r["i"], r["j"]): r["label"] for r in seeded_components(table(spark, runs), ["run"], connectivity, wrap, max_passes, tile=10).collect()}
    assert by == [10]
    for r, a in enumerate(runs):
        want = raster(a["selected"], a["dense"], connectivity, wrap, max_passes)
        assert {k: v for k, v in got.items() if k[0] == r} == {(r, i, j): want[i, j] for i, j in zip(*np.nonzero(a["selected"] | a["dense"]), strict=True)}


def test_growth_where_tiles_tell_each_other_of_a_label_that_is_gone(spark):
    rows = ["1011111", "0101111", "1111111", "1100111", "0111011", "1111101", "1111111", "1010111"]
    selected = np.array([[c == "1" for c in row] for row in rows])
    dense = np.zeros_like(selected)
    dense[2, 1] = dense[5, 2] = dense[5, 6] = dense[6, 1] = True
    got = {(r["i"], r["j"]): r["label"] for r in seeded_components(table(spark, [{"selected": selected, "dense": dense}]), (), 4, True, tile=4).collect()}
    want = raster(selected, dense, 4, True, None)
    assert got == {(i, j): want[i, j] for i, j in zip(*np.nonzero(selected | dense), strict=True)}


def dense_loop(norm, occupied, dense, scale, beta, max_iters, min_iters, tol, every, wrap):
    c = dense.astype(float)
    up = occupied & ~dense
    w = np.where(up, np.clip(norm / scale, 0, 1), 0)
    last = None
    for it in range(1, max_iters + 1):
        p = np.pad(c, 1, mode="wrap" if wrap else "edge")
        lap = p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * c
        d = np.where(up, beta * w * lap, 0)
        c = np.where(up, np.clip(c + d, 0, 1), c)
        if it % every == 0:
            last = np.abs(d).max()
            if it >= min_iters and last < tol:
                break
    return c, it, last


@pytest.mark.parametrize("wrap", [False, True])
def test_masked_diffusion_stops_with_the_global_loop(spark, wrap):
    rng = np.random.default_rng(3)
    runs = []
    for shape in [(8, 9), (1, 6), (2, 7), (10, 10)]:
        n = np.where(rng.random(shape) < 0.75, rng.integers(1, 30, shape), 0)
        n[0, 0], n[-1, -1] = 29, 1
        runs.append({"n": n.astype(float)})
    cells = table(spark, runs).where("n > 0")
    cells = normalize_nonzero(cells, ["run"]).withColumn("dense", F.col("norm") >= 0.5).withColumn("scale", F.lit(0.5))
    betas = (0.1, 0.25, 0.45)
    field, stats = diffuse_masked_2d(cells, ["run"], betas, max_iters=3000, min_iters=25, tol=1e-5, check_every=10, periodic=wrap)
    got = {(r["run"], r["beta"], r["i"], r["j"]): r["c"] for r in field.collect()}
    told = {(r["run"], r["beta"]): r for r in stats.collect()}
    for r, a in enumerate(runs):
        occ = a["n"] > 0
        norm = np.where(occ, (a["n"] - a["n"][occ].min()) / (a["n"][occ].max() - a["n"][occ].min()), 0)
        for beta in betas:
            c, it, last = dense_loop(norm, occ, occ & (norm >= 0.5), 0.5, beta, 3000, 25, 1e-5, 10, wrap)
            assert told[r, beta]["iters_used"] == it
            assert told[r, beta]["max_delta_last"] == pytest.approx(last, abs=1e-12)
            for i, j in zip(*np.nonzero(occ), strict=True):
                assert got[r, beta, i, j] == pytest.approx(c[i, j], abs=1e-9)


@pytest.mark.parametrize("wrap,max_iters,every", [(False, 130, 5), (True, 64, 5), (True, 3, 5)])
def test_diffusion_tile_by_tile_equals_the_global_loop(spark, wrap, max_iters, every):
    """Tiles of 20 cells with halos: one component over the whole grid, a thin one, and a grid smaller than a tile."""
    rng = np.random.default_rng(4)
    runs = []
    for shape in [(45, 30), (41, 2), (5, 4)]:
        n = rng.integers(1, 30, shape)
        n[rng.random(shape) < 0.05] = 0
        n[0, 0], n[-1, -1] = 29, 1
        runs.append({"n": n.astype(float)})
    cells = table(spark, runs).where("n > 0")
    cells = normalize_nonzero(cells, ["run"]).withColumn("dense", F.col("norm") >= 0.9).withColumn("scale", F.lit(0.5)).cache()
    betas = (0.1, 0.4)
    field, stats = diffuse_masked_2d(cells, ["run"], betas, max_iters=max_iters, min_iters=7, tol=1e-4, check_every=every, periodic=wrap, tile=20, touching=1)
    got = {(r["run"], r["beta"], r["i"], r["j"]): r["c"] for r in field.collect()}
    told = {(r["run"], r["beta"]): r for r in stats.collect()}
    for r, a in enumerate(runs):
        occ = a["n"] > 0
        norm = np.where(occ, (a["n"] - a["n"][occ].min()) / (a["n"][occ].max() - a["n"][occ].min()), 0)
        for beta in betas:
            c, it, last = dense_loop(norm, occ, occ & (norm >= 0.9), 0.5, beta, max_iters, 7, 1e-4, every, wrap)
            assert told[r, beta]["iters_used"] == it
            assert told[r, beta]["max_delta_last"] == (None if last is None else pytest.approx(last, abs=1e-12))
            for i, j in zip(*np.nonzero(occ), strict=True):
                assert got[r, beta, i, j] == pytest.approx(c[i, j], abs=1e-9)


def test_diffusion_without_sparse_cells_stops_at_the_first_check(spark):
    cells = spark.createDataFrame([(0, 0, 2, 2, 1.0, True, 0.5)], "i int, j int, nx int, ny int, norm double, dense boolean, scale double")
    field, stats = diffuse_masked_2d(cells, min_iters=25, check_every=10)
    assert [r["c"] for r in field.collect()] == [1.0]
    s = stats.first()
    assert (s["iters_used"], s["stop"], s["max_delta_last"]) == (30, "converged", 0.0)


def test_components_match_union_find_in_rounds_or_at_once(spark):
    rng = random.Random(5)
    edges = [(k, rng.randrange(200), rng.randrange(200)) for k in (0, 1) for _ in range(120)] + [(2, n, n + 1) for n in range(40)]
    want = {}
    for k in (0, 1, 2):
        parent = {}
        find = lambda v, p=parent: v if p.setdefault(v, v) == v else find(p[v], p)
        for _, a, b in (e for e in edges if e[0] == k and e[1] != e[2]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        want |= {(k, v): find(v) for v in parent}
    e = spark.createDataFrame([*edges, (0, None, 3)], "run int, src long, dst long").repartition(4)
    for finish in (0, 1000):
        assert {(r["run"], r["vertex"]): r["root"] for r in components(e, ["run"], finish=finish).collect()} == want
    assert components(e.limit(0), ["run"]).count() == 0
    assert {(r["vertex"], r["root"]) for r in components(e.where("run = 2").drop("run")).collect()} == {(n, 0) for n in range(41)}


def test_3d_clusters_by_radius(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 0, 0, 0, 1), (0, 0, 1, 1, 2), (0, 0, 5, 5, 5), (0, 0, 4, 4, 4)], "step long, size_id int, xi int, yi int, zi int")
    count = lambda **kw: sorted((r["xi"], r["cluster_id"]) for r in cell_components_3d(cells, **kw).collect())
    assert count() == [(0, 1), (0, 1), (1, 2), (4, 3), (5, 4)]
    assert count(radius=1.5) == [(0, 1), (0, 1), (1, 2), (4, 3), (5, 4)]
    assert count(radius=1.8) == [(0, 1), (0, 1), (1, 1), (4, 2), (5, 2)]
    assert count(radius=1.8, by_size=True, drop_singletons=True) == [(0, 0), (0, 0), (1, 0), (4, 1), (5, 1)]
    assert count(by_size=True, drop_singletons=True) == [(0, 0), (0, 0)]


def test_3d_diffusion_keeps_mass_and_known_cells(spark):
    rows = [(0, 0, 1.0, 1.0, 1.0, 4, 3, 2, 0.0, 0.0, 0.0, x, y, z, float(x == 1), 1) for x in range(4) for y in range(3) for z in range(2) if (x, y, z) != (3, 2, 1)]
    names = "step long, size_id int, dx double, dy double, dz double, mx int, my int, mz int, xlo double, ylo double, zlo double, xi int, yi int, zi int, label_mean double, cn long"
    cells = spark.createDataFrame(rows, names)
    lattice = full_lattice(cells)
    assert lattice.count() == 24
    free = diffuse_free_3d(lattice, iters=7).agg(F.sum("c")).first()[0]
    assert free == pytest.approx(6.0)
    got = {(r["xi"], r["yi"], r["zi"]): r for r in impute_3d(lattice, iters=200).collect()}
    assert all(r["c"] == r["label_mean"] for k, r in got.items() if k != (3, 2, 1))
    assert got[3, 2, 1]["c"] == pytest.approx(0.0)


def test_tiles_with_halos_diffuse_like_the_whole_lattice(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for step, shape in ((0, (9, 5, 7)), (1, (3, 12, 4))):
        for x, y, z in np.ndindex(shape):
            known = rng.random() < 0.4
            rows.append((step, 0, 1.0, 1.0, 1.0, *shape, 0.0, 0.0, 0.0, x, y, z, float(rng.random()) if known else None, int(known)))
    names = "step long, size_id int, dx double, dy double, dz double, mx int, my int, mz int, xlo double, ylo double, zlo double, xi int, yi int, zi int, label_mean double, cn long"
    lattice = spark.createDataFrame(rows, names)
    told = lambda df: {(r["step"], r["xi"], r["yi"], r["zi"]): r["c"] for r in df.collect()}
    whole = {True: told(impute_3d(lattice, iters=5)), False: told(diffuse_free_3d(lattice.where("cn > 0"), iters=5))}
    for tile, halo in ((3, 2), (2, 16)):
        for impute in (True, False):
            cells = lattice if impute else lattice.where("cn > 0")
            assert told(diffusion._tiled(cells, ["step", "size_id"], 0.1, 5, impute, tile, halo)) == whole[impute]


def test_ranks_by_ranges_are_those_of_one_window(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.randrange(3), n) for n in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(5)
    want = {(k, v): sorted(b for a, b in rows if a == k).index(v) for k, v in rows}
    for limit in (1_000, 10):
        monkeypatch.setattr(labelling, "RANKED", limit)
        assert {(r["k"], r["v"]): r["rank"] for r in labelling.ranked(df, ["k"], ["v"]).collect()} == want
        down = labelling.ranked(df, [], [F.desc("v"), F.col("k")]).collect()
        assert sorted(r["rank"] for r in down) == list(range(900)) and max(down, key=lambda r: r["v"])["rank"] == 0
        members = labelling.cluster_members(df, ["k"], ["v"], chunk=100).collect()
        assert {(r["k"], v): 100 * r["chunk"] + n for r in members for n, v in enumerate(r["members"])} == want
        assert labelling.ranked(df.limit(0), ["k"], ["v"]).count() == 0


def test_matches_of_counted_atoms_are_those_of_single_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(0, int(a), int(b)) for a, b in zip(rng.integers(-1, 5, 400), rng.integers(-1, 4, 400), strict=True)]
    one = spark.createDataFrame(rows, "step int, grid_id int, atom_label int")
    told = one.groupBy(*one.columns).count()
    want = {tuple(r) for r in matching.match_one_to_one(one, min_jaccard=0.01).collect()}
    assert want and {tuple(r) for r in matching.match_one_to_one(told, min_jaccard=0.01, count="count").collect()} == want
    cells = spark.createDataFrame([(0, 0, 0, 0, 1.0, 1.0, 1.0), (0, 1, 0, 0, 1.0, 1.0, 1.0)], "g int, xi int, yi int, zi int, dx double, dy double, dz double")
    points = spark.createDataFrame([(0, 5), (0, 4)], "g int, n long")
    assert [tuple(r) for r in matching.voxel_shape(cells, ["g"], points, 9, count="n").collect()] == [(0, 2.0, 10.0, 9)]
