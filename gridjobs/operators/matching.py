"""Comparison of grid clusters with atom clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _size(count: str | None) -> Column:
    return F.sum(count) if count else F.count("*")


def _overlaps(labelled: DataFrame, keys: list[str], background: int, count: str | None) -> DataFrame:
    """Jaccard coefficient of each pair of overlapping clusters, from pair counts: no cluster is compared with all others."""
    pairs = labelled.where((F.col("grid_id") != background) & (F.col("atom_label") != background)).groupBy(*keys, "grid_id", "atom_label").agg(_size(count).alias("both"))
    g = labelled.where(F.col("grid_id") != background).groupBy(*keys, "grid_id").agg(_size(count).alias("g"))
    a = labelled.where(F.col("atom_label") != background).groupBy(*keys, "atom_label").agg(_size(count).alias("a"))
    d = pairs.join(g, [*keys, "grid_id"]).join(a, [*keys, "atom_label"])
    return d.withColumn("jaccard", F.col("both") / (F.col("g") + F.col("a") - F.col("both")))


def match_by_overlap(labelled: DataFrame, keys: Sequence[str] = ("step",), min_jaccard: float = 0.0, background: int = 0, count: str | None = None) -> DataFrame:
    """(keys, grid_id, atom_label, jaccard): each grid cluster's best atom cluster, lowest id on ties.

    ``labelled`` has one row per atom with grid_id and atom_label, or a row for ``count`` atoms. A grid cluster that overlaps none is matched with the lowest
    atom cluster at 0 if ``min_jaccard`` allows that; without any atom cluster nothing is matched.
    """
    keys = list(keys)
    d = _overlaps(labelled, keys, background, count)
    best = d.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "grid_id").orderBy(F.desc("jaccard"), "atom_label"))).where("r = 1").select(*keys, "grid_id", "atom_label", "jaccard")
    lowest = labelled.where(F.col("atom_label") != background).groupBy(*keys).agg(F.min("atom_label").alias("low"))
    ids = labelled.where(F.col("grid_id") != background).select(*keys, "grid_id").distinct()
    ids = ids.join(F.broadcast(lowest), keys) if keys else ids.crossJoin(F.broadcast(lowest))
    out = ids.where("low is not null").join(best, [*keys, "grid_id"], "left")
    out = out.select(*keys, "grid_id", F.coalesce("atom_label", "low").alias("atom_label"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"))
    return out.where(F.col("jaccard") >= min_jaccard)


def match_one_to_one(labelled: DataFrame, keys: Sequence[str] = ("step",), min_jaccard: float = 0.5, background: int = -1, count: str | None = None) -> DataFrame:
    """Matches with at least ``min_jaccard``, one per atom cluster: of several grid clusters the highest id."""
    keys = list(keys)
    m = match_by_overlap(labelled, keys, min_jaccard, background, count)
    return m.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "atom_label").orderBy(F.desc("grid_id")))).where("r = 1").drop("r")


def voxel_shape(cells: DataFrame, keys: Sequence[str], atoms: DataFrame | None = None, least_points: int = 8, count: str | None = None) -> DataFrame:
    """(keys, volume, surface, n_points): volume of each cluster's cells and area of their faces that touch no other cell of it.

    ``keys`` name a cluster; cells have xi, yi, zi and dx, dy, dz. Clusters with fewer points than ``least_points`` have volume and
    surface 0; ``atoms`` (keys, one row per point or for ``count`` points) says how many they have, and without it cells count as points.
    """
    keys = list(keys)
    d = cells.select(*keys, "xi", "yi", "zi", "dx", "dy", "dz").distinct()
    areas = {"x": F.col("dy") * F.col("dz"), "y": F.col("dx") * F.col("dz"), "z": F.col("dx") * F.col("dy")}
    sides = F.array(*(F.struct(*(F.lit(s if a == b else 0).alias(b) for b in "xyz"), areas[a].alias("area")) for a in "xyz" for s in (1, -1)))
    faces = d.select(*keys, "xi", "yi", "zi", F.explode(sides).alias("s"))
    faces = faces.select(*keys, *((F.col(f"{a}i") + F.col(f"s.{a}")).alias(f"{a}i") for a in "xyz"), F.col("s.area").alias("area"))
    bare = faces.join(d.select(*keys, "xi", "yi", "zi"), [*keys, "xi", "yi", "zi"], "left_anti").groupBy(*keys).agg(F.sum("area").alias("surface"))
    size = d.groupBy(*keys).agg(F.sum(F.col("dx") * F.col("dy") * F.col("dz")).alias("volume"), F.count("*").alias("n_cells")).join(bare, keys)
    size = size.join(atoms.groupBy(*keys).agg(_size(count).alias("n_points")), keys) if atoms is not None else size.withColumn("n_points", F.col("n_cells"))
    some = F.col("n_points") >= least_points
    return size.select(*keys, *(F.when(some, F.col(c)).otherwise(0.0).alias(c) for c in ("volume", "surface")), "n_points")


def compare_clusters(matches: DataFrame, grid_shapes: DataFrame, atom_shapes: DataFrame, keys: Sequence[str] = ("step",), least_points: int = 10) -> DataFrame:
    """Differences of volume and surface of matched clusters that have ``least_points`` points each, also in percent of the atom
    cluster's (0 where that is 0)."""
    keys = list(keys)
    named = lambda df, who, id_: df.where(F.col("n_points") >= least_points).select(*keys, id_, *(F.col(c).alias(f"{who}_{c}") for c in ("volume", "surface")))
    d = matches.join(named(grid_shapes, "grid", "grid_id"), [*keys, "grid_id"]).join(named(atom_shapes, "atom", "atom_label"), [*keys, "atom_label"])
    for c in ("volume", "surface"):
        diff = F.abs(F.col(f"grid_{c}") - F.col(f"atom_{c}"))
        d = d.withColumn(f"{c}_diff", diff).withColumn(f"{c}_diff_pct", F.when(F.col(f"atom_{c}") == 0, 0.0).otherwise(100.0 * diff / F.col(f"atom_{c}")))
    return d


def sweep_summary(rows: DataFrame, config: Sequence[str] = ("diffusion", "cell_size", "c_thr")) -> DataFrame:
    """Clusters, rows, mean and median percentage differences of each configuration, sorted by it."""
    pct = [f(F.col(f"{c}_diff_pct")).alias(f"{c}_diff_pct_{n}") for c in ("volume", "surface") for f, n in ((F.avg, "mean"), (F.median, "median"))]
    return rows.groupBy(*config).agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_rows"), *pct).orderBy(*config)


def sweep_pivot(rows: DataFrame, value: str = "volume_diff_pct", cluster_id: int = 0, thresholds: Sequence[float] | None = None) -> DataFrame:
    """One cluster's mean difference as a matrix: a row per cell size, a column per threshold."""
    return rows.where(F.col("cluster_id") == cluster_id).groupBy("cell_size").pivot("c_thr", list(thresholds) if thresholds else None).agg(F.avg(value))
