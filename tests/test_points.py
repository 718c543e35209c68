"""Reading, preparation, neighbours, metrics, matching and whole runs on small tables."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridjobs.operators import baselines, diffusion, grid, labelling, matching, metrics, neighbors, prepare, search
from gridjobs.plans import pipeline
from gridjobs.sources import points as sources


def blobs(spark, k=6, per=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(k):
        a = 2 * math.pi * n / k
        for x, y in rng.normal((10 * math.cos(a), 10 * math.sin(a)), 0.6, (per, 2)):
            rows.append((len(rows), float(x), float(y), n))
    return spark.createDataFrame(rows, "point_id long, x double, y double, truth int")


def test_dirty_rows_are_left_out_or_refused(spark, tmp_path):
    rows = [(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double")
    assert [r["point_id"] for r in sources.points_from(df).orderBy("point_id").collect()] == [1, 5]
    with pytest.raises(Exception, match="not finite"):
        sources.points_from(df, strict=True).collect()
    with pytest.raises(ValueError, match="missing"):
        sources.points_from(df.drop("y"))
    places = [(r["point_id"], r["x"]) for r in sources.points_from(df.drop("point_id").coalesce(1)).orderBy("point_id").collect()]
    assert places == [(0, 1.0), (4, 3.0)]
    path = str(tmp_path / "points")
    df.write.csv(path, header=True)
    assert sources.read_points(spark, path).count() == 2


def test_files_without_ids_are_numbered_by_place(spark, tmp_path):
    with open(tmp_path / "shapes.csv", "w") as f:
        f.write("x,y,class\n" + "".join(f"{n / 7},{n % 13},b'{n % 3}'\n" for n in range(3_000)))
    p = sources.read_points(spark, str(tmp_path / "shapes.csv")).repartition(7)
    assert {(r["point_id"], r["y"], r["class"]) for r in p.collect()} == {(n, float(n % 13), f"b'{n % 3}'") for n in range(3_000)}
    many = spark.range(1_000).select(F.col("id").alias("x"), F.lit(1).alias("y")).repartition(6)
    many.write.parquet(str(tmp_path / "many"))
    assert sorted(r["point_id"] for r in sources.read_points(spark, str(tmp_path / "many"), "parquet").collect()) == list(range(1_000))


def test_a_snapshot_file_goes_from_reading_to_matched_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz = rng.uniform(0, 10, (200, 3))
    label = np.exp(-((xyz - 2) ** 2).sum(1) / 8)
    with open(tmp_path / "atoms.csv", "w") as f:
        f.write("x,y,z,c_label,xlo,xhi,ylo,yhi,zlo,zhi\n")
        f.writelines(",".join(map(repr, map(float, (*v, c, 0, 10, 0, 10, 0, 10)))) + "\n" for v, c in zip(xyz, label, strict=True))
    atoms = sources.read_snapshots(spark, str(tmp_path / "atoms.csv"))
    binned = grid.box_cells(atoms, sources.snapshot_boxes(atoms), [(2.0, 2.0, 2.0)])
    cells = grid.cell_means(binned)
    assert 0 < cells.count() <= 125
    field = diffusion.diffuse_free_3d(cells, iters=1)
    chosen = grid.select_cells_3d(field, 0.1, "c")
    clusters = labelling.cell_components_3d(chosen)
    assert clusters.count() == chosen.count() > 0
    by_atom = labelling.atom_components(atoms, cutoff=1.5, thr=0.1)
    rows = by_atom.collect()
    assert sorted(r["atom_id"] for r in rows) == list(range(200)) and all((r["label"] > 0) == (label[r["atom_id"]] >= 0.1) for r in rows)
    both = grid.cell_members(binned, clusters).join(by_atom, ["step", "atom_id"]).select("step", "atom_id", F.col("cluster_id").alias("grid_id"), F.col("label").alias("atom_label"))
    assert matching.match_by_overlap(both).count() == clusters.select("cluster_id").distinct().count()


def test_truth_columns_and_labels(spark):
    df = spark.createDataFrame([("b'3'", 1), ("b'4'", 2), (None, 3)], "Class string, gt int")
    assert sources.find_truth_column(df) == "Class"
    assert sources.find_truth_column(df, "class") == "Class"
    assert sources.find_truth_column(df, "none") is None
    assert [r["Class_int"] for r in sources.decode_labels(df, "Class").orderBy("gt").collect()] == [3, 4, None]
    odd = df.unionByName(spark.createDataFrame([("b'x'", 4)], "Class string, gt int"))
    got = sources.decode_labels(odd, "Class").orderBy("gt").collect()
    assert [r["Class_int"] for r in got] == [None] * 4 and [r["Class"] for r in got] == ["3", "4", None, "x"]


def test_nearest_neighbours_with_lone_and_equal_points(spark):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.random((80, 2)), [[9, 9], [9.5, 9], [0.5, 0.5], [0.5, 0.5]]])
    p = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), 1)
    got = {r["id"]: r["distance"] for r in neighbors.knn_distances(p, 3).collect()}
    assert len(got) == len(xy)
    assert all(got[n] == pytest.approx(d[n, 3]) for n in got)
    assert prepare.knn_spacing(p.limit(3), 5).first()["knn_h"] is None


def test_squared_silhouette_by_clusters_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CLUSTERS", 3)
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for run, k in enumerate((8, 2, 1)):
        label = np.append(rng.integers(0, k, 60), [k - 1] if k < 3 else [k, -1])
        xy = rng.normal(0, 1, (len(label), 2)) + 1e4 + label[:, None]
        rows += [(run, n, float(x), float(y), int(c)) for n, ((x, y), c) in enumerate(zip(xy, label, strict=True))]
        xy, label = xy[label >= 0], label[label >= 0]
        d, s = ((xy[:, None] - xy[None]) ** 2).sum(2), []
        for n, c in enumerate(label):
            own = (label == c).sum()
            if own > 1 and k > 1:
                a, b = d[n, label == c].sum() / (own - 1), min(d[n, label == o].mean() for o in set(label.tolist()) - {c})
                s.append((b - a) / max(a, b))
            else:
                s.append(0.0)
        want[run] = pytest.approx(np.mean(s), abs=1e-9) if k > 1 else None
    df = spark.createDataFrame(rows, "run int, point_id long, x double, y double, label int")
    assert {r["run"]: r["silhouette"] for r in metrics.silhouette(df, ["run"], squared=True).collect()} == want


def test_half_of_all_points_in_one_spot_make_leaves_no_fuller(spark):
    rng = np.random.default_rng(5)
    even, spot = rng.random((400, 2)), 0.5 + 1e-6 * rng.random((400, 2))
    spot[:150] = 0.5  # equal points fill leaves of their own
    for xy in (np.vstack([even, rng.random((400, 2))]), np.vstack([even, spot])):
        p = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(xy)], "point_id long, x double, y double")
        sizes = [r["count"] for r in neighbors.leaves(p, len(xy), 40, "point_id").groupBy("slab", "block").count().collect()]
        assert max(sizes) <= 40 and min(sizes) >= 19
        d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), 1)
        got = {r["id"]: r["distance"] for r in neighbors.knn_distances(p, 5, leaf=40).collect()}
        assert len(got) == len(xy) and all(got[n] == pytest.approx(d[n, 5], abs=1e-15) for n in got)


def test_neighbours_of_far_points_beside_a_full_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PART", 2)
    rng = np.random.default_rng(7)
    xy = np.vstack([rng.normal(0, 0.001, (300, 2)), rng.uniform(-1e4, 1e4, (12, 2)), [[5, 5]] * 9])
    p = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)), 1)
    got = {r["id"]: r["distance"] for r in neighbors.knn_distances(p, 4, leaf=20).collect()}
    assert len(got) == len(xy) and all(got[n] == pytest.approx(d[n, 4], abs=1e-12) for n in got)


def test_quantiles_by_narrowing_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = {"even": rng.normal(0, 1, 6_000), "ties": np.round(rng.normal(0, 1, 6_000)), "one": np.full(6_000, 2.5), "top": np.append(rng.random(2_000), np.full(4_000, 7.0))}
    monkeypatch.setattr(prepare, "BUFFERED", 200)
    for v in values.values():
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        assert prepare.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]) == pytest.approx(np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist(), abs=1e-15)
    monkeypatch.setattr(prepare, "BUFFERED", 1_000_000)
    df = spark.createDataFrame([(float(x),) for x in values["even"]], "v double")
    assert prepare.quantiles(df, "v", [0.3]) == pytest.approx([np.quantile(values["even"], 0.3)]) and prepare.quantiles(df.limit(0), "v", [0.3]) == [None]


def test_widths_around_a_whole_quotient(spark):
    for lx, ly, h in ((2.0, 1.3, 0.125), (3.0, 3.0, 0.2), (7.7, 1.0, 0.35)):
        hs = np.clip(np.linspace(0.8 * h, 1.2 * h, 7), 1e-12, max(lx, ly))
        want = list(dict.fromkeys((int(np.ceil(lx / x)), int(np.ceil(ly / x))) for x in hs))
        seeds = spark.createDataFrame([(lx, ly, h)], "Lx double, Ly double, h_est double")
        assert [(r["nx"], r["ny"]) for r in prepare.grids_around(seeds).orderBy("cand_id").collect()] == want


def test_radius_pairs_in_dense_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PART", 5)
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.random((60, 3)) * 0.4, rng.normal(0, 2, (40, 3))])
    p = spark.createDataFrame([(0, n, *map(float, v)) for n, v in enumerate(xyz)], "step long, atom_id long, x double, y double, z double")
    want = {(a, b) for a, b in combinations(range(len(xyz)), 2) if ((xyz[a] - xyz[b]) ** 2).sum() <= 0.3**2}
    got = [(r["src"], r["dst"]) for r in neighbors.radius_pairs(p, 0.3, ["step"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_metrics_on_known_partitions(spark):
    p = blobs(spark).withColumn("label", F.col("truth"))
    r = metrics.cluster_report(p.withColumn("phase", F.lit("a"))).first()
    assert [r[c] for c in ("coverage", "ari", "nmi", "fm", "purity")] == pytest.approx([1.0] * 5)
    assert r["k"] == 6 and r["silhouette"] > 0.8
    x = np.array([(q["x"], q["y"], q["label"]) for q in p.collect()])
    d = np.sqrt(((x[:, None, :2] - x[None, :, :2]) ** 2).sum(2))
    same = x[:, None, 2] == x[None, :, 2]
    a = (d * same).sum(1) / (same.sum(1) - 1)
    b = np.min([np.where(x[:, 2] == k, np.inf, d[:, x[:, 2] == k].mean(1)) for k in range(6)], 0)
    assert r["silhouette"] == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    noise = metrics.score_partition(p.withColumn("label", F.lit(-1))).first()
    assert (noise["cov"], noise["k"], noise["score"]) == (0.0, 0, float("-inf"))
    one = metrics.external_scores(metrics.contingency(p.withColumn("label", F.lit(0)))).first()
    assert one["nmi"] == 0.0 and one["ari"] == pytest.approx(0.0)


def test_scores_from_cells_are_those_of_the_points(spark, monkeypatch):
    p = blobs(spark)
    grids = spark.createDataFrame([(0, 12, 12), (1, 7, 9)], "cand_id int, nx int, ny int")
    binned = search.bin_candidates(p, grids)
    cells = grid.cell_counts(binned, ["cand_id", "nx", "ny"])
    at = [labelling.cell_components(cells.where(f"n >= {n}"), ["cand_id"]).withColumn("r", F.lit(n)) for n in (2, 6, 40)]
    labels = at[0].unionByName(at[1]).unionByName(at[2])
    runs = grids.select("cand_id").crossJoin(spark.createDataFrame([(2,), (6,), (40,)], "r int"))
    every = F.explode(F.array(F.lit(2), F.lit(6), F.lit(40))).alias("r")
    want = metrics.partition_scores(grid.label_points(binned.select("*", every), labels, ["cand_id", "r"]), ["cand_id", "r"])
    for size in (2_000, 2):
        monkeypatch.setattr(metrics, "CLUSTERS", size)
        got = metrics.scores_by_cells(binned, labels, ["cand_id"], ["cand_id", "r"], runs)
        told = lambda df: sorted((r["cand_id"], r["r"], r["k"], r["valid"], r["sil"], r["cov"], r["dbi"]) for r in df.collect())
        a, b = told(got), told(want)
        assert len(a) == 6 and all(x[:5] == y[:5] and x[5:] == pytest.approx(y[5:]) for x, y in zip(a, b, strict=True))


def brute_scores(xy, label):
    """Coverage, clusters and the mean worst ratio of a partition, from its definition."""
    names = sorted(set(label[label >= 0].tolist()))
    centre = {k: xy[label == k].mean(0) for k in names}
    spread = {k: np.sqrt(((xy[label == k] - centre[k]) ** 2).sum(1)).mean() for k in names}
    worst = [max(((spread[a] + spread[b]) / np.sqrt(((centre[a] - centre[b]) ** 2).sum()) if (centre[a] != centre[b]).any() else 0.0) for b in names if b != a) for a in names] if len(names) > 1 else []
    return (label >= 0).mean(), len(names), float(np.mean(worst)) if worst else math.inf


def test_stages_of_a_search_score_what_they_label(spark):
    p = blobs(spark, k=4, per=25)
    rows = sorted((r["point_id"], r["x"], r["y"]) for r in p.collect())
    xy = np.array([r[1:] for r in rows])
    lo, hi = xy.min(0) - 1e-9 * (np.ptp(xy, 0) + 1), xy.max(0) + 1e-9 * (np.ptp(xy, 0) + 1)

    def cells(nx, ny):
        return [np.clip(np.floor((xy[:, a] - lo[a]) / ((hi[a] - lo[a]) / n)), 0, n - 1).astype(int) for a, n in ((0, nx), (1, ny))]

    def labelled(i, j, keep):
        label, k = {}, 0
        for cell in sorted(keep):
            if cell not in label:
                todo = [cell]
                label[cell] = k
                while todo:
                    a, b = todo.pop()
                    for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if c in keep and c not in label:
                            label[c] = k
                            todo.append(c)
                k += 1
        return np.array([label.get(c, -1) for c in zip(i.tolist(), j.tolist(), strict=True)])

    grids = spark.createDataFrame([(0, 9, 8), (1, 5, 6)], "cand_id int, nx int, ny int")
    got = {(r["cand_id"], r["dense_q"]): r for r in search.stage_a_grid(p, grids, (0.2, 0.7)).collect()}
    assert len(got) == 4
    for cand, (nx, ny) in enumerate(((9, 8), (5, 6))):
        i, j = cells(nx, ny)
        n = {}
        for c in zip(i.tolist(), j.tolist(), strict=True):
            n[c] = n.get(c, 0) + 1
        least, most = min(n.values()), max(n.values())
        norm = {c: (v - least) / (most - least) for c, v in n.items()}
        for q in (0.2, 0.7):
            thr = np.quantile(list(norm.values()), q)
            cov, k, dbi = brute_scores(xy, labelled(i, j, {c for c, v in norm.items() if v >= thr}))
            r = got[cand, q]
            assert (r["cov"], r["k"], r["dbi"], r["score"]) == (pytest.approx(cov), k, pytest.approx(dbi), pytest.approx(0.8 / (1 + dbi) + 0.15 * cov))
    seeds = prepare.spacing_seeds(p)
    found = search.stage_a_search(p, seeds, draws=3, rounds=2)
    rows = found.collect()
    s = seeds.first()
    h0 = float(np.median([x for x in (s["knn_h"], s["occ_h"], s["fd_h"], s["h_est"])]))
    assert [(r["h"], r["r"]) for r in sorted(rows, key=lambda r: r["ordinal"])[:9]] == [(pytest.approx(f * h0), n) for f in (1, 0.9, 1.1) for n in (3, 5, 7)]
    for r in rows:
        if r["reason"] == "ok":
            i, j = cells(r["nx"], r["ny"])
            n = {}
            for c in zip(i.tolist(), j.tolist(), strict=True):
                n[c] = n.get(c, 0) + 1
            cov, k, dbi = brute_scores(xy, labelled(i, j, {c for c, v in n.items() if v >= r["r"]}))
            assert (r["cov"], r["k"], r["dbi"]) == (pytest.approx(cov), k, pytest.approx(dbi))
    assert any(r["reason"] == "ok" for r in rows)
    best = search.best_candidate(found.where("reason = 'ok'")).first()
    assert best["score"] == max(r["score"] for r in rows if r["reason"] == "ok")


def test_the_second_stage_scores_its_own_labels(spark):
    p = blobs(spark, k=4, per=40)
    binned = search.bin_candidates(p, spark.createDataFrame([(10, 10)], "nx int, ny int"))
    cells = grid.normalize_nonzero(grid.cell_counts(binned, ["nx", "ny"]))
    cells = grid.dense_by_threshold(cells, 0.4).withColumn("scale", F.lit(0.4)).cache()
    scores, labels = search.stage_b_sweep(binned, cells, (0.05, 0.2), (0.05, 0.3))
    own = {(r["beta"], r["cthr"], r["i"], r["j"]): r["label"] for r in labels.collect()}
    xy = np.array([(r["x"], r["y"]) for r in binned.orderBy("point_id").collect()])
    at = [(r["i"], r["j"]) for r in binned.orderBy("point_id").collect()]
    rows = scores.collect()
    assert sorted(r["ordinal"] for r in rows) == [0, 1, 2, 3] and all(r["stop"] == "converged" for r in rows)
    for r in rows:
        cov, k, dbi = brute_scores(xy, np.array([own.get((r["beta"], r["cthr"], *c), -1) for c in at]))
        assert (r["cov"], r["k"], r["dbi"]) == (pytest.approx(cov), k, pytest.approx(dbi))
    for beta in (0.05, 0.2):
        field = {(r["i"], r["j"]): (r["dense"], r["c"]) for r in diffusion.diffuse_masked_2d(cells, (), [beta])[0].collect()}
        for cthr in (0.05, 0.3):
            assert {k[2:] for k in own if k[:2] == (beta, cthr)} == {k for k, (d, c) in field.items() if d or c > cthr}


def test_davies_bouldin_of_many_clusters_reads_few_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "CLUSTERS", 30)
    seen = []
    kept = metrics.close_blocks
    monkeypatch.setattr(metrics, "close_blocks", lambda *a: (seen.append((a[0].count(), kept(*a).count())), kept(*a))[1])
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.uniform(0, 100, (1_500, 2)), rng.normal(50, 0.5, (400, 2)), np.full((40, 2), 7.0)])
    s = rng.exponential(0.1, len(xy))
    s[5] = 6.0
    rows = [(run, k, float(s[k]), float(xy[k, 0]), float(xy[k, 1])) for run in (0, 1) for k in range(len(xy)) if run == 0 or k < 45]
    c = spark.createDataFrame(rows + [(2, k, 0.5, 1.0, 1.0) for k in range(50)], "run int, label long, s double, cx double, cy double")
    got = {r["run"]: r["dbi"] for r in metrics._dbi(c, ["run"]).collect()}

    def brute(x, s):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        ratio = np.divide(s[:, None] + s[None], d, out=np.zeros_like(d), where=d > 0)
        np.fill_diagonal(ratio, -1)
        return ratio.max(1).mean()

    assert got == {0: pytest.approx(brute(xy, s)), 1: pytest.approx(brute(xy[:45], s[:45])), 2: 0.0}
    blocks, pairs = seen[0]
    assert blocks >= 65 and pairs < 0.4 * blocks * blocks


def test_silhouette_scores_all_points_of_a_large_run(spark):
    n = 50_500
    p = spark.range(n + 1).select(F.col("id").alias("point_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("label"))
    p = p.withColumns({"x": F.when(F.col("point_id") == n, 1.0).otherwise(0.0), "label": F.when(F.col("point_id") == n, 1).otherwise(0)})
    assert metrics.silhouette(p).first()["silhouette"] == pytest.approx(n / (n + 1), abs=1e-9)


def test_matching_ties_zero_overlap_and_background(spark):
    rows = [(0, 1, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0), (4, 0, 4), (5, 2, 3)]
    d = spark.createDataFrame([(0, *r) for r in rows], "step long, atom_id long, grid_id int, atom_label int")
    got = {r["grid_id"]: (r["atom_label"], r["jaccard"]) for r in matching.match_by_overlap(d).collect()}
    assert got == {1: (1, 0.5), 2: (3, 1.0), 3: (1, 0.0)}
    assert {r["grid_id"] for r in matching.match_by_overlap(d, min_jaccard=0.6).collect()} == {2}
    assert matching.match_by_overlap(d.withColumn("atom_label", F.lit(0))).count() == 0


def test_tuned_run_finds_the_blobs(spark):
    p = blobs(spark)
    out = pipeline.run_tuned_2d(p, pipeline.Tuning(quantiles=(0.0, 0.3), betas=(0.1,), cthrs=(0.1, 0.19)))
    r = {x["phase"]: x for x in out["report"].collect()}
    assert all(x["silhouette"] > 0.5 for x in r.values())
    assert r["after_seeded"]["purity"] > 0.9 and r["after_seeded"]["coverage"] <= r["after_std"]["coverage"]
    assert out["stage_b"].count() == 2 and out["winner"].count() == 1
    fixed = pipeline.run_fixed_2d(p, 12, 12, 0.1, 0.1, min_count=3)[0]
    assert fixed.groupBy("phase").count().count() == 3
    with pytest.raises(ValueError):
        pipeline.Tuning(connectivity=5)


def test_both_strategies_of_a_sweep_over_datasets(spark):
    p = blobs(spark).withColumn("dataset", F.concat(F.lit("d"), F.col("truth") % 2))
    grids = spark.createDataFrame([(0, 12, 12), (1, 8, 8)], "cand_id int, nx int, ny int")
    got = {(r["dataset"], r["strategy"]): r for r in pipeline.dataset_sweep(p, grids, (0.2, 0.5), search={"draws": 2, "rounds": 1}).collect()}
    assert set(got) == {(d, s) for d in ("d0", "d1") for s in ("grid", "search")}
    for d in ("d0", "d1"):
        own = p.where(f"dataset = '{d}'")
        alone = search.best_candidate(search.stage_a_grid(own, grids, (0.2, 0.5))).first()
        r = got[d, "grid"]
        assert (r["nx"], r["ny"], r["k"]) == (alone["nx"], alone["ny"], alone["k"]) and r["score"] == pytest.approx(alone["score"]) and r["dense_thr"] is not None
        found = search.best_candidate(search.stage_a_search(own, prepare.spacing_seeds(own), draws=2, rounds=1).where("reason = 'ok'")).first()
        assert (got[d, "search"]["r"], got[d, "search"]["score"]) == (found["r"], pytest.approx(found["score"]))
    assert pipeline.dataset_sweep(p, grids, (0.2,), strategies=["grid"]).count() == 2
    with pytest.raises(ValueError):
        pipeline.dataset_sweep(p, grids, (0.2,), strategies=["other"])


def test_search_keeps_its_best_and_gives_reasons(spark):
    p = blobs(spark)
    rows = [(0, 100.0, 3, 0.0, 0.8, 0.2), (1, 2.0, 3, 0.0, 0.8, 0.2), (2, 2.0, 999, 0.0, 0.8, 0.2)]
    got = search.stage_a_eval(p, spark.createDataFrame(rows, "cand_id int, h double, r int, w_sil double, w_dbi double, w_cov double"))
    assert {r["cand_id"]: r["reason"] for r in got.collect()} == {0: "too-few-cells", 1: "ok", 2: "no-dense"}


def test_baselines(spark):
    p = prepare.standardize(blobs(spark))
    got = {r["method"]: r for r in baselines.compare_methods(p, {"gmm": lambda q: baselines.gmm_labels(q, 6), "kmeans": lambda q: baselines.kmeans_labels(q, 6), "dbscan": lambda q: baselines.dbscan_labels(q, 0.3, 4), "clique": lambda q: baselines.clique_labels(q, 12, 2)}).collect()}
    assert got["dbscan"]["ari"] > 0.9 and got["clique"]["purity"] > 0.8 and got["kmeans"]["k"] == 6
    assert got["gmm"]["k"] <= 6 and got["gmm"]["coverage"] == 1.0 and got["gmm"]["purity"] > 0.5
    assert all(r["silhouette"] > 0.2 for r in got.values())


def test_cluster_distances_by_tree_match_all_pairs(spark):
    from gridjobs.operators.distances import cluster_distances

    rng = np.random.default_rng(5)
    x, y = (np.concatenate([rng.normal(size=300), 1e-3 * rng.normal(size=300) + 0.3, [0.3, 0.3]]) for _ in "xy")
    label = np.concatenate([rng.integers(0, 4, 600), [1, 1]])
    df = spark.createDataFrame(pd.DataFrame({"point_id": range(602), "x": x, "y": y, "label": label}))
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    size = np.bincount(label)
    mean = np.array([d[:, label == k].sum(1) for k in range(4)]) / size[:, None]
    own = mean[label, range(602)] * size[label] / (size[label] - 1)
    mean[label, range(602)] = np.inf
    got = cluster_distances(df, leaf=25, whole=0).collect()
    assert sum(r["w"] for r in got) == 602 and max(r["w"] for r in got) == 2 and {r["size"] for r in got} == set(size.tolist())
    want = sorted(zip(own, mean.min(0)))
    assert np.allclose(sorted((r["a"], r["b"]) for r in got for _ in range(r["w"])), want, rtol=1e-7)
    s = np.mean([(b - a) / max(a, b) for a, b in want])
    assert metrics.silhouette(df, leaf=25, whole=0).first()[0] == pytest.approx(s, abs=1e-8)
    assert metrics.silhouette(df).first()[0] == pytest.approx(s, abs=1e-12)


def test_a_leaf_compares_each_point_with_few_others(monkeypatch):
    rng = np.random.default_rng(12)
    pairs, brute = [0], neighbors._brute

    def counted(ax, ay, bx, by, k):
        pairs[0] += len(ax) * len(bx)
        return brute(ax, ay, bx, by, k)

    monkeypatch.setattr(neighbors, "_brute", counted)
    even = rng.random((3_000, 2))
    lattice = np.stack(np.meshgrid(np.arange(50.0), np.arange(60.0)), -1).reshape(-1, 2)
    spot = np.vstack([even[:1_500], 0.5 + 1e-7 * rng.random((1_500, 2))])
    for xy in (even, even * [1, 300], lattice, spot, np.repeat(even[:1_000], 3, 0)):
        (x, y), pairs[0] = xy.T, 0
        got = np.sort(neighbors.nearest(x, y, np.full(len(x), np.inf), x, y, 6), 1)
        assert pairs[0] < len(x) ** 2 / 8
        assert (got == np.sort(brute(x, y, x, y, 6), 1)).all()
    x, y = even.T
    bound = 0.05 * rng.random(500)
    got, want = (np.sort(d, 1) for d in (neighbors.nearest(x[:500] + 0.3, y[:500], bound, x, y, 5), brute(x[:500] + 0.3, y[:500], x, y, 5)))
    assert ((got == want) | ((got >= bound[:, None]) & (want >= bound[:, None]))).all()


def test_quantiles_of_counted_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, w = np.round(rng.normal(0, 1, 900), 2), rng.integers(0, 9, 900)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w, strict=True)], "v double, n long")
    want = np.quantile(np.repeat(v, w), [0.0, 0.25, 0.5, 1.0]).tolist()
    for most in (1_000_000, 300):
        monkeypatch.setattr(prepare, "BUFFERED", most)
        assert prepare.quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], "n") == pytest.approx(want, abs=1e-15)


def test_a_search_over_datasets_reads_its_source_once_for_each(spark):
    rng = np.random.default_rng(4)
    rows = [(n, float(x), float(y), "ab"[n % 2]) for n, (x, y) in enumerate(np.vstack([rng.normal(0, 0.2, (40, 2)), rng.normal(3, 0.2, (40, 2))]))]
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for g in parts:
            read.add(len(g))
            yield g

    kinds = "point_id long, x double, y double, dataset string"
    points = spark.createDataFrame(rows, kinds).mapInPandas(counted, kinds)
    found = pipeline.dataset_sweep(points, None, (0.3,), strategies=["search"], search={"draws": 1, "rounds": 1}).collect()
    assert {r["dataset"] for r in found} == {"a", "b"} and read.value <= 3 * len(rows)
