"""Grid clusters against atom clusters over a sweep of cell sizes and thresholds, raw and diffused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.operators.diffusion import diffuse_free_3d
from gridjobs.operators.grid import BOX_KEYS, box_cells, cell_means
from gridjobs.operators.labelling import atom_components, cell_components_3d
from gridjobs.operators.matching import compare_clusters, match_one_to_one, voxel_shape

RUN = [*BOX_KEYS, "c_thr", "diffusion"]
CELL = ["xi", "yi", "zi"]
SIZE = ["dx", "dy", "dz"]


def compare_sweep(
    atoms: DataFrame, boxes: DataFrame, sizes: Sequence[tuple[float, float, float]], thresholds: Sequence[float], cutoff: float = 1.5, atom_thr: float = 0.4, beta: float = 0.10, iters: int = 500, radius: float = 1.01, min_jaccard: float = 0.5, least_points: int = 10
) -> DataFrame:
    """One row per matched pair of clusters: step, size_id, c_thr, diffusion, cluster_id (of the grid), atom_label, volumes, surfaces and
    their differences.

    Atoms are clustered once. Cells of each size are diffused once; thresholds and both fields are keys of one job. Grid clusters are
    numbered from 0 by falling size, single cells are none. Shapes of both sides are voxels of the run's cell size: a grid
    cluster's are its cells, an atom cluster's the cells that its atoms lie in. Atoms are told their cluster once and counted by cell and
    cluster; runs meet these counts only.
    """
    boxes = cut(boxes)
    sized = lambda a: box_cells(a, boxes, sizes).select(*BOX_KEYS, *CELL, *(c for c in ("c_label", "atom_label") if c in a.columns), *SIZE, "mx", "my", "mz")
    cells = cut(cell_means(sized(atoms)))
    t = F.explode(F.array(*map(F.lit, map(float, thresholds)))).alias("c_thr")
    fields = {"raw": cells.withColumn("v", F.col("label_mean")), "diffused": diffuse_free_3d(cells, BOX_KEYS, beta, iters).withColumn("v", F.col("c"))}
    told = [f.select(*BOX_KEYS, *CELL, *SIZE, "cn", "v", F.lit(name).alias("diffusion"), t).where("v >= c_thr") for name, f in fields.items()]
    chosen = cut(told[0].unionByName(told[1]))
    clusters = cut(cell_components_3d(chosen, RUN, radius, by_size=True, drop_singletons=True).withColumnRenamed("cluster_id", "grid_id"))
    # from here on atoms are counts: of each atom cluster in each cell, whatever the runs
    over = cut(atoms.where(F.col("c_label") > atom_thr).select("step", "atom_id", "x", "y", "z", "c_label"))
    named = atom_components(over, ["step"], cutoff, atom_thr, strict=True).where("label >= 0").withColumnRenamed("label", "atom_label")
    held = over.drop("c_label").join(named, ["step", "atom_id"])
    spots = cut(sized(held).groupBy(*BOX_KEYS, *CELL, *SIZE, "atom_label").agg(F.count("*").alias("n")))
    own = cut(clusters.join(chosen.drop("v"), [*RUN, *CELL]))
    inside = own.groupBy(*RUN, "grid_id").agg(F.sum("cn").alias("n"))
    both = cut(clusters.join(spots.drop(*SIZE), [*BOX_KEYS, *CELL]).groupBy(*RUN, "grid_id", "atom_label").agg(F.sum("n").alias("n")))
    # atoms of either kind in each run; those that are in no cluster of a kind have -1 there
    runs = clusters.select(*RUN).distinct()
    whole = runs.join(spots.groupBy(*BOX_KEYS, "atom_label").agg(F.sum("n").alias("n")), BOX_KEYS)
    rest = lambda all_, c: all_.unionByName(both.select(*RUN, c, (-F.col("n")).alias("n"))).groupBy(*RUN, c).agg(F.sum("n").alias("n")).where("n > 0")
    labelled = both.unionByName(rest(inside, "grid_id").withColumn("atom_label", F.lit(-1))).unionByName(rest(whole, "atom_label").withColumn("grid_id", F.lit(-1)))
    matches = match_one_to_one(labelled, RUN, min_jaccard, count="n")
    grid_shapes = voxel_shape(own, [*RUN, "grid_id"], inside, least_points, count="n")
    atom_shapes = runs.join(voxel_shape(spots, [*BOX_KEYS, "atom_label"], spots, least_points, count="n"), BOX_KEYS)
    return compare_clusters(matches, grid_shapes, atom_shapes, RUN, least_points).withColumnRenamed("grid_id", "cluster_id")
