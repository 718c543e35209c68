"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from gridjobs import queries
from gridjobs.operators import grid, search

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=2e-5, abs_tol=2e-5))


@pytest.mark.parametrize("name", ["dense_regions", "s1_read_points_without_ids", "s2_read_snapshots_without_ids", "d1_diffuse_stops", "d2_diffuse_free_3d_tiled", "c2_seeded_components", "c7_cluster_members", "q8_cluster_report", "r1_stage_a_grid", "r2_stage_a_eval", "r5_stage_b_sweep", "r9_dataset_sweep", "r7_run_fixed_2d", "r10_sweep_3d", "x3_compare_clusters", "x4_sweep_summary", "x5_sweep_pivot", "g5_cell_means", "p4_knn_spacing", "p7_suggest_grids", "g2_assign_cells_periodic", "m5_diffusion_weight_scale", "d1_diffuse_masked_2d", "d3_impute_3d", "c3b_cell_components_by_size", "c6_atom_components", "q3_davies_bouldin", "q6_external_scores", "x1_match_by_overlap", "x2_voxel_shape", "b3_dbscan_labels"])
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want) and all(near(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_full_diffusion_queries_match_brute_force(spark, monkeypatch):
    boxed = queries.boxed(spark, SF)
    for name, cells, impute in (("d2_diffuse_free_3d_full", boxed, False), ("d3_impute_3d_full", boxed.where("c_label >= 0.8"), True)):
        lattice = grid.full_lattice(grid.cell_means(cells).where("size_id = 1")).collect()
        got = {(r["step"], r["xi"], r["yi"], r["zi"]): r["c"] for r in queries.QUERIES[name](spark, SF).where("size_id = 1").collect()}
        want = {}
        for step in {r["step"] for r in lattice}:
            own = [r for r in lattice if r["step"] == step]
            v = np.zeros([1 + max(r[a] for r in own) for a in ("xi", "yi", "zi")])
            known = np.zeros(v.shape, bool)
            for r in own:
                v[r["xi"], r["yi"], r["zi"]], known[r["xi"], r["yi"], r["zi"]] = r["label_mean"] or 0.0, r["cn"] > 0
            c = v.copy()
            for _ in range(500):
                c = c + 0.1 * (sum(np.roll(c, s, a) for a in range(3) for s in (1, -1)) - 6 * c)
                c = np.where(known, v, c) if impute else c.clip(0, 1)
            want |= {(step, *map(int, k)): c[tuple(k)] for k in (np.argwhere(known | impute))}
        assert set(got) == set(want) and all(near(got[k], float(want[k])) for k in want)
    steps = []
    whole = search.diffuse_free_3d
    monkeypatch.setattr(search, "diffuse_free_3d", lambda c, keys, beta, iters: steps.append(iters) or whole(c, keys, beta, iters))
    queries.QUERIES["r10_sweep_3d"](spark, SF)
    assert steps == [500]


def test_full_masked_diffusion_queries_converge(spark):
    field, stats = queries.masked(spark, SF)
    assert stats.first()["stop"] == "converged"
    early, full = ({(r["i"], r["j"]): r["c"] for r in queries.QUERIES[n](spark, SF).collect()} for n in ("d1_diffuse_masked_2d", "d1_diffuse_masked_2d_full"))
    assert set(early) == set(full) and full == {(r["i"], r["j"]): r["c"] for r in queries.rounded(field).collect()} and full != early
    chosen = {(r["i"], r["j"]) for r in queries.QUERIES["m6_select_after_diffusion_full"](spark, SF).where("selected").collect()}
    assert {k for k, c in full.items() if c > 0.05 + 1e-6} <= chosen


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
