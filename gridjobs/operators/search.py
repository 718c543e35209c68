"""Parameter sweeps: every candidate of a sweep is a key of one job."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.operators.diffusion import diffuse_free_3d, diffuse_masked_2d
from gridjobs.operators.grid import BOX_KEYS, assign_cells, box_cells, cell_counts, cell_means, dense_by_quantile, label_points, normalize_nonzero
from gridjobs.operators.labelling import cell_components, cell_components_3d, seeded_components
from gridjobs.operators.metrics import partition_scores, scores_by_cells, weighted
from gridjobs.operators.prepare import grid_size, padded_bounds, with_row

BOUNDS = ["x_min", "x_max", "y_min", "y_max"]
# Fixed values of the batch search: weight triples that a weight search starts from beside the given one, factors of the width
# and counts of the warm starts; and the reasons for which a candidate has no score.
PRIORS = ((0.50, 0.30, 0.20), (0.30, 0.50, 0.20))
WIDTHS, COUNTS = (1.0, 0.9, 1.1), (3, 5, 7)
TOO_FEW, NO_OCCUPANCY, NO_DENSE, BAD_SCORE = "too-few-cells", "no-occupancy", "no-dense", "bad-score"


def normalize_weights(df: DataFrame, cols: Sequence[str] = ("w_sil", "w_dbi", "w_cov"), floor: float = 0.0, ceil: float = 1.0) -> DataFrame:
    """Weights clipped to [floor, ceil] and divided by their sum; thirds where that isn't a positive number."""
    d = df.withColumns({c: F.greatest(F.lit(float(floor)), F.least(F.lit(float(ceil)), F.col(c).cast("double"))) for c in cols})
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    good = total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < float("inf"))
    d = d.withColumns({"_good": good, "_total": total})
    return d.withColumns({c: F.when(F.col("_good"), F.try_divide(F.col(c), F.col("_total"))).otherwise(1.0 / len(cols)) for c in cols}).drop("_good", "_total")


def best_candidate(df: DataFrame, keys: Sequence[str] = (), score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    """The row of largest score of each key; of equal ones the first by ``ordinal``. Candidates are few, so they are ranked."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ordinal)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def bin_candidates(points: DataFrame, grids: DataFrame, box: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Points once per candidate grid, with their cells; ``box`` is padded_bounds(points) unless given."""
    box = padded_bounds(points, keys) if box is None else box
    b = box.select(*keys, *BOUNDS)
    spots = with_row(points, b, keys)
    same = [c for c in keys if c in grids.columns]
    return assign_cells(spots.join(F.broadcast(grids), same) if same else spots.crossJoin(F.broadcast(grids)))


def stage_a_grid(points: DataFrame, grids: DataFrame, quantiles: Sequence[float], w_sil: float = 0.0, w_dbi: float = 0.8, w_cov: float = 0.15, periodic: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """One row per grid and quantile: dense cells by quantile, components by four neighbours, points labelled and scored.

    Points are binned once for each grid; all that doesn't need them follows from sums over cells, for all quantiles at once. Only
    a silhouette (``w_sil``) takes the points of every quantile. Columns: keys, ordinal (order of the sweep), cand_id, nx, ny, dense_q, dense_thr, sil, dbi, cov, k, score.
    """
    run = [*keys, "cand_id"]
    widest = grids.agg(F.max(F.greatest("nx", "ny"))).first()[0]
    binned = bin_candidates(points, grids.select(*(c for c in run if c in grids.columns), "nx", "ny"), keys=keys)
    cells = cut(normalize_nonzero(cell_counts(binned, [*run, "nx", "ny"]), run))
    dense = cut(dense_by_quantile(cells, quantiles, run).where("dense"))
    labels = cell_components(dense, [*run, "q"], 4, periodic, widest=widest)
    if w_sil:
        qs = F.explode(F.array(*map(F.lit, map(float, quantiles)))).alias("q")
        scores = partition_scores(label_points(binned.select("*", qs), labels, [*run, "q"]), [*run, "q"], True)
    else:
        scores = scores_by_cells(binned, labels, run, [*run, "q"])
    scores = weighted(scores, w_sil, w_dbi, w_cov)
    told = dense.groupBy(*run, "q", "nx", "ny").agg(F.first("thr").alias("dense_thr"))
    order = F.col("cand_id") * len(quantiles) + F.array_position(F.array(*map(F.lit, map(float, quantiles))), F.col("q")) - 1
    return scores.join(told, [*run, "q"]).select(*run[:-1], order.cast("int").alias("ordinal"), "cand_id", "nx", "ny", F.col("q").alias("dense_q"), "dense_thr", "sil", "dbi", "cov", "k", "score")


def stage_a_eval(points: DataFrame, candidates: DataFrame, max_bins: int = 200, periodic: bool = False, with_silhouette: bool = False) -> DataFrame:
    """Scores of candidates (cand_id, h, r, w_sil, w_dbi, w_cov): adds nx, ny, sil, dbi, cov, k, score and reason.

    reason is ok, too-few-cells (a grid of one cell), no-occupancy (fewer than two occupied cells), no-dense (no cell with r
    points) or bad-score; score is null where it isn't ok.
    """
    box = padded_bounds(points)
    g = candidates.crossJoin(F.broadcast(box.select("Lx", "Ly")))
    h = F.greatest("h", F.lit(1e-12))
    g = cut(g.withColumns({"nx": grid_size("Lx", h, max_bins), "ny": grid_size("Ly", h, max_bins)}).drop("Lx", "Ly"))
    grids = g.where("nx * ny >= 2").select("cand_id", "nx", "ny", "r")
    binned = bin_candidates(points, grids, box)
    cells = cut(cell_counts(binned, ["cand_id", "nx", "ny", "r"]))
    found = cells.groupBy("cand_id").agg(F.count("*").alias("occupied"), F.count_if(F.col("n") >= F.col("r")).alias("dense"))
    labels = cell_components(cells.where("n >= r"), ["cand_id"], 4, periodic, widest=max_bins)
    scores = partition_scores(label_points(binned, labels, ["cand_id"]), ["cand_id"], True) if with_silhouette else scores_by_cells(binned, labels, ["cand_id"], ["cand_id"], grids.select("cand_id"))
    scores = weighted_by(scores, g.select("cand_id", "w_sil", "w_dbi", "w_cov"))
    d = g.join(found, "cand_id", "left").join(scores, "cand_id", "left")
    reason = F.when(F.col("nx") * F.col("ny") < 2, TOO_FEW).when(F.coalesce("occupied", F.lit(0)) < 2, NO_OCCUPANCY).when(F.col("dense") < 1, NO_DENSE)
    d = d.withColumn("reason", reason.when(F.col("score").isNull() | (F.abs("score") == float("inf")), BAD_SCORE).otherwise("ok"))
    return d.withColumn("score", F.when(F.col("reason") == "ok", F.col("score"))).drop("occupied", "dense")


def weighted_by(scores: DataFrame, weights: DataFrame) -> DataFrame:
    d = scores.join(F.broadcast(weights), "cand_id")
    return weighted(d, *(F.col(c) for c in ("w_sil", "w_dbi", "w_cov"))).drop("w_sil", "w_dbi", "w_cov")


def stage_a_search(
    points: DataFrame, seeds: DataFrame, weights: tuple[float, float, float] = (0.0, 0.8, 0.15), h_range: tuple[float, float] = (0.5, 2.0), r_range: tuple[int, int] = (2, 12), search_weights: bool = False,
    weight_range: tuple[float, float] = (0.05, 0.9), draws: int = 24, rounds: int = 2, shrink: float = 0.5, seed: int = 11, max_bins: int = 200, periodic: bool = False,
) -> DataFrame:
    """All candidates that a batch search scored, with ``ordinal``; the best one is best_candidate of them.

    Cell widths lie in ``h_range`` times h0, the median of the seed widths (knn_h, occ_h, fd_h, h_est of spacing_seeds). The first
    batch holds warm starts (three widths, three counts and, in a weight search, three weight triples) and seeded draws, even in
    log width; each further batch draws around the best so far in a range ``shrink`` times as wide. A batch is one job.
    """
    spark = points.sparkSession
    s = seeds.select("knn_h", "occ_h", "fd_h", "h_est", "Lx", "Ly").first()
    known = sorted(x for x in s[:4] if x is not None and math.isfinite(x))
    mid = len(known) // 2
    h0 = (known[mid] if len(known) % 2 else (known[mid - 1] + known[mid]) / 2) if known else max(1e-12, 0.05 * max(s[4], s[5]))
    lo, hi = math.log(h_range[0] * h0), math.log(h_range[1] * h0)
    clip = lambda v, a, b: min(max(v, a), b)
    own = [clip(w, 0.0, 1.0) for w in weights]
    own = tuple(w / sum(own) for w in own) if sum(own) > 0 else (1 / 3,) * 3
    unit = lambda w: tuple(x / sum(w) for x in w)
    triples = [unit([clip(x, *weight_range) for x in w]) for w in (own, *PRIORS)] if search_weights else [own]
    rng = random.Random(seed)
    batch = [(math.exp(clip(math.log(h), lo, hi)), clip(r, *r_range), *w) for h in (f * h0 for f in WIDTHS) for r in COUNTS for w in triples]
    done, span, centre = None, 1.0, None
    for n in range(rounds):
        for _ in range(draws):
            a, b = (lo, hi) if centre is None else (max(lo, math.log(centre["h"]) - span * (hi - lo) / 2), min(hi, math.log(centre["h"]) + span * (hi - lo) / 2))
            width = max(1, round(span * (r_range[1] - r_range[0]) / 2))
            r = rng.randint(*r_range) if centre is None else clip(centre["r"] + rng.randint(-width, width), *r_range)
            batch.append((math.exp(rng.uniform(a, b)), r, *(unit([rng.uniform(*weight_range) for _ in range(3)]) if search_weights else own)))
        first = 0 if done is None else done.count()
        rows = [(first + k, *map(float, b[:1]), int(b[1]), *map(float, b[2:])) for k, b in enumerate(dict.fromkeys(batch))]
        found = stage_a_eval(points, spark.createDataFrame(rows, "cand_id int, h double, r int, w_sil double, w_dbi double, w_cov double"), max_bins, periodic, any(b[2] for b in batch))
        found = cut(found.withColumn("ordinal", F.col("cand_id")))
        done = found if done is None else done.unionByName(found)
        best = best_candidate(done.where("reason = 'ok'")).first()
        if best is None:
            break
        centre, span, batch = best.asDict(), span * shrink, []
    return done


def stage_b_sweep(
    points: DataFrame, cells: DataFrame, betas: Sequence[float], cthrs: Sequence[float], w_sil: float = 0.0, w_dbi: float = 0.8, w_cov: float = 0.15, connectivity: int = 4, periodic: bool = False, keys: Sequence[str] = (), widest: int | None = None, **diffusion
) -> tuple[DataFrame, DataFrame]:
    """(one scored row per beta and cthr, labels of all cells under each).

    ``cells``: i, j, nx, ny, norm, dense, scale; ``points`` carry i and j. Each rate is diffused once; its field is compared with
    all thresholds. Scores carry iters_used, stop and ordinal (the order of the sweep).
    """
    keys = list(keys)
    run = [*keys, "beta", "cthr"]
    field, stats = diffuse_masked_2d(cells, keys, betas, periodic=periodic, widest=widest, **diffusion)
    t = F.explode(F.array(*map(F.lit, map(float, cthrs)))).alias("cthr")
    chosen = cut(field.select("*", t).withColumn("selected", F.col("dense") | (F.col("c") > F.col("cthr"))))
    labels = cut(seeded_components(chosen, run, connectivity, periodic, widest=widest))
    sweep = stats.select(*keys, "beta_no", "beta", "iters_used", "stop", t)
    spots = points.select(*keys, *(c for c in ("point_id", "x", "y", "i", "j") if c in points.columns))
    if w_sil:
        spots = spots.join(F.broadcast(sweep.select(*run)), keys) if keys else spots.crossJoin(F.broadcast(sweep.select(*run)))
        scores = partition_scores(label_points(spots, labels, run), run, True)
    else:
        scores = scores_by_cells(spots, labels, keys, run)
    scores = weighted(scores, w_sil, w_dbi, w_cov)
    order = F.col("beta_no") * len(cthrs) + F.array_position(F.array(*map(F.lit, map(float, cthrs))), F.col("cthr")) - 1
    return scores.join(F.broadcast(sweep), run).withColumn("ordinal", order.cast("int")).drop("beta_no"), labels


def sweep_3d(atoms: DataFrame, boxes: DataFrame, sizes: Sequence[tuple[float, float, float]], thresholds: Sequence[float], beta: float = 0.10, iters: int = 500, radius: float = 1.01, keys: Sequence[str] = ("step",)) -> DataFrame:
    """Selected cells and clusters for every snapshot, cell size and threshold, raw and diffused: (step, size_id, c_thr, diffusion,
    n_selected, n_clusters). Diffusion doesn't depend on the threshold, so it is run once for each size."""
    cells = cut(cell_means(box_cells(atoms, boxes, sizes)))
    field = diffuse_free_3d(cells, BOX_KEYS, beta, iters)
    value: list[tuple[str, DataFrame, str]] = [("raw", cells, "label_mean"), ("diffused", field, "c")]
    t = F.explode(F.array(*map(F.lit, map(float, thresholds)))).alias("c_thr")
    both = None
    for name, df, c in value:
        got = df.select(*BOX_KEYS, "xi", "yi", "zi", F.col(c).alias("v"), F.lit(name).alias("diffusion"), t).where("v >= c_thr")
        both = got if both is None else both.unionByName(got)
    run = [*BOX_KEYS, "c_thr", "diffusion"]
    clusters = cell_components_3d(cut(both), run, radius)
    return clusters.groupBy(*run).agg(F.count("*").alias("n_selected"), F.count_distinct("cluster_id").alias("n_clusters"))

