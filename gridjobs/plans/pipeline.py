"""Whole runs: one fixed set of parameters, tuned, or over many datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.operators.diffusion import diffuse_masked_2d
from gridjobs.operators.grid import cell_counts, classify_cells, dense_by_count, dense_by_threshold, diffusion_weight_scale, label_points, normalize_nonzero, select_after_diffusion
from gridjobs.operators.labelling import cell_components, seeded_components
from gridjobs.operators.metrics import cluster_report
from gridjobs.operators.prepare import grids_around, spacing_seeds, with_row
from gridjobs.operators.search import best_candidate, bin_candidates, stage_a_grid, stage_a_search, stage_b_sweep


@dataclass(frozen=True)
class Tuning:
    """Parameters of a tuned run; defaults are those of the search functions."""

    mode: str = "grid"
    k: int = 5
    alpha: float = 1.0
    target_occ: float = 4
    sweep_pct: float = 0.2
    max_bins: int = 200
    quantiles: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
    betas: Sequence[float] = (0.02, 0.05, 0.1, 0.2)
    cthrs: Sequence[float] = (0.05, 0.1, 0.15, 0.19)
    w_sil: float = 0.0
    w_dbi: float = 0.8
    w_cov: float = 0.15
    connectivity: int = 4
    periodic: bool = False
    diffusion: dict = field(default_factory=dict)
    search: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("grid", "count"):
            raise ValueError("mode must be grid or count")
        if self.connectivity not in (4, 8):
            raise ValueError("connectivity must be 4 or 8")
        if any(not 0 <= q <= 1 for q in self.quantiles):
            raise ValueError("quantiles must lie in [0, 1]")
        if any(b <= 0 for b in self.betas) or not self.betas or not self.cthrs:
            raise ValueError("rates must be positive, and rates and thresholds given")
        if min(self.w_sil, self.w_dbi, self.w_cov) < 0:
            raise ValueError("weights must not be negative")


def _phases(binned: DataFrame, labels: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    out = None
    for phase, lab in labels.items():
        got = label_points(binned, lab, keys).withColumn("phase", F.lit(phase))
        out = got if out is None else out.unionByName(got)
    return out


def run_fixed_2d(
    points: DataFrame, nx: int, ny: int, beta: float, cthr: float, dense_thr: float | None = None, min_count: int | None = None, connectivity: int = 4, periodic: bool = False, scale: float | None = None, **diffusion
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points x phase with label, cells with c and selected, diffusion statistics) for given parameters.

    Phases: before (components of dense cells), after_std (of all selected cells) and after_seeded (grown from the dense ones).
    Only the cell aggregation shuffles anything that comes from the points; everything later works on cells.
    """
    spark = points.sparkSession
    grid = spark.createDataFrame([(int(nx), int(ny))], "nx int, ny int")
    binned = bin_candidates(points, grid)
    cells = normalize_nonzero(cell_counts(binned, ["nx", "ny"]))
    if (dense_thr is None) == (min_count is None):
        raise ValueError("give either dense_thr or min_count")
    cells = dense_by_threshold(cells, float(dense_thr)).withColumn("thr", F.lit(float(dense_thr))) if min_count is None else dense_by_count(cells, int(min_count))
    cells = cut(classify_cells(cells.withColumn("scale", F.lit(float(scale)) if scale is not None else F.col("thr"))))
    wide = {"periodic": periodic, "widest": max(int(nx), int(ny))}
    field_, stats = diffuse_masked_2d(cells, (), [beta], **wide, **diffusion)
    chosen = cut(select_after_diffusion(field_, float(cthr)))
    labels = {
        "before": cell_components(chosen.where("dense"), (), connectivity, **wide),
        "after_std": cell_components(chosen.where("selected"), (), connectivity, **wide),
        "after_seeded": seeded_components(chosen, (), connectivity, **wide),
    }
    return _phases(binned, labels), chosen, stats


def run_tuned_2d(points: DataFrame, tuning: Tuning | None = None) -> dict[str, DataFrame]:
    """Grid and density by a first sweep, diffusion by a second, then labels and scores of the winner.

    Returns tables: stage_a, stage_b (all candidates), winner (one row), labelled (points x phase) and report (a row per phase).
    Raises ValueError where no candidate of the first stage can be scored.
    """
    t = tuning or Tuning()
    weights = {"w_sil": t.w_sil, "w_dbi": t.w_dbi, "w_cov": t.w_cov}
    seeds = cut(spacing_seeds(points, t.k, t.alpha, t.target_occ, True, t.max_bins))
    if t.mode == "grid":
        around = grids_around(seeds, t.sweep_pct, t.max_bins)
        first = seeds.select(F.lit(-1).alias("cand_id"), F.col("nx0").alias("nx"), F.col("ny0").alias("ny"), F.col("h_est").alias("h"))
        grids = around.unionByName(first.join(around, ["nx", "ny"], "left_anti").select(around.columns)).withColumn("cand_id", F.col("cand_id") + 1)
        stage_a = cut(stage_a_grid(points, grids, t.quantiles, **weights, periodic=t.periodic))
        won = best_candidate(stage_a).first()
        if won is None:
            raise ValueError("no candidate of the first stage could be scored")
        by = lambda c: dense_by_threshold(c, float(won["dense_thr"])).withColumn("thr", F.lit(float(won["dense_thr"])))
    else:
        stage_a = stage_a_search(points, seeds, (t.w_sil, t.w_dbi, t.w_cov), max_bins=t.max_bins, periodic=t.periodic, **t.search)
        won = best_candidate(stage_a.where("reason = 'ok'")).first()
        if won is None:
            raise ValueError("no candidate of the first stage could be scored")
        by = lambda c: dense_by_count(c, int(won["r"]))
        weights = {c: float(won[c]) for c in weights}
    grid = points.sparkSession.createDataFrame([(won["nx"], won["ny"])], "nx int, ny int")
    binned = cut(bin_candidates(points, grid))
    cells = by(normalize_nonzero(cell_counts(binned, ["nx", "ny"])))
    cells = cut(with_row(cells, diffusion_weight_scale(cells)))
    wide = max(won["nx"], won["ny"])
    stage_b, labels = stage_b_sweep(binned, cells, t.betas, t.cthrs, **weights, connectivity=t.connectivity, periodic=t.periodic, widest=wide, **t.diffusion)
    stage_b = cut(stage_b)
    top = best_candidate(stage_b).first()
    chosen = labels.where((F.col("beta") == top["beta"]) & (F.col("cthr") == top["cthr"]))
    std = cell_components(chosen.select("i", "j", F.lit(won["nx"]).alias("nx"), F.lit(won["ny"]).alias("ny")), (), t.connectivity, t.periodic, widest=wide)
    phases = {"before": cell_components(cells.where("dense"), (), 4, t.periodic, widest=wide), "after_std": std, "after_seeded": chosen.select("i", "j", "label")}
    labelled = cut(_phases(binned, phases))
    winner = best_candidate(stage_b).crossJoin(F.broadcast(grid)).withColumns({"mode": F.lit(t.mode), "dense_thr": F.lit(float(won["dense_thr"])) if t.mode == "grid" else F.lit(None).cast("double"), "r": F.lit(int(won["r"])) if t.mode == "count" else F.lit(None).cast("int")})
    return {"stage_a": stage_a, "stage_b": stage_b, "winner": winner, "labelled": labelled, "report": cluster_report(labelled, ["phase"])}


def dataset_sweep(points: DataFrame, grids: DataFrame, quantiles: Sequence[float], key: str = "dataset", strategies: Sequence[str] = ("grid", "search"), search: dict | None = None, **kw) -> DataFrame:
    """The winning first-stage row of every dataset and strategy: (dataset, strategy, nx, ny, dense_thr, r, sil, dbi, cov, k, score).

    For the grid strategy all datasets, grids and quantiles are keys of one job. A batch search goes its own way for each dataset
    (its draws follow what it found), so the names of the datasets, few by their nature, are what the driver goes through. The points of
    one are written apart first, as a search reads them many times.
    """
    unknown = set(strategies) - {"grid", "search"}
    if unknown or not strategies:
        raise ValueError("strategies are grid and search")
    shared = [key, "strategy", "nx", "ny", "dense_thr", "r", "sil", "dbi", "cov", "k", "score"]
    won: list[DataFrame] = []
    if "grid" in strategies:
        best = best_candidate(stage_a_grid(points, grids, quantiles, keys=[key], **kw), [key])
        won.append(best.withColumns({"strategy": F.lit("grid"), "r": F.lit(None).cast("int")}).select(*shared))
    if "search" in strategies:
        weights = tuple(kw.get(w, d) for w, d in (("w_sil", 0.0), ("w_dbi", 0.8), ("w_cov", 0.15)))
        for (name,) in points.select(key).distinct().orderBy(key).collect():
            own = cut(points.where(F.col(key).eqNullSafe(F.lit(name))))
            found = stage_a_search(own, cut(spacing_seeds(own)), weights, **(search or {}))
            best = best_candidate(found.where("reason = 'ok'"))
            told = {key: F.lit(name).cast(dict(points.dtypes)[key]), "strategy": F.lit("search"), "dense_thr": F.lit(None).cast("double")}
            won.append(best.withColumns(told).select(*shared))
    return reduce(DataFrame.unionByName, won)
