"""Other clusterers for comparison, on standardized points (point_id, x, y)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.operators.cliques import MARGIN, clique_components
from gridjobs.operators.grid import assign_cells, cell_counts, label_points
from gridjobs.operators.labelling import _numbered, cell_components
from gridjobs.operators.metrics import cluster_report
from gridjobs.operators.neighbors import meetings
from gridjobs.operators.prepare import minmax_scale


def _vectors(points: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(points)


def kmeans_labels(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Points with label 0..k-1."""
    model = KMeans(k=k, seed=seed, predictionCol="label").fit(_vectors(points))
    return model.transform(_vectors(points)).drop("features")


def gmm_labels(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Points with the likeliest of k full-covariance Gaussian components."""
    model = GaussianMixture(k=k, seed=seed, predictionCol="label").fit(_vectors(points))
    return model.transform(_vectors(points)).drop("features", "probability")


def dbscan_labels(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """Points with label: core points have ``min_pts`` points within ``eps``, themselves among them; touching core points share a
    cluster, other points within reach of one join the cluster of lowest id, and the rest is -1.

    Clusters are numbered from 0 by their smallest core point id. Points of a bucket (narrow enough that all are within ``eps``) of
    ``min_pts`` or more are core without a look at any neighbour; for the others neighbours are counted as they are met, and no
    table of pairs is made. Core points are joined bucket by bucket.
    """
    cells = {f"_c{c}": F.floor(F.col(c) / (eps / 2**0.5 * (1 - MARGIN))).cast("long") for c in ("x", "y")}
    p = points.select("point_id", "x", "y").withColumns(cells)
    full = p.groupBy(*cells).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pts)
    p = cut(p.join(full, list(cells), "left").select("point_id", "x", "y", F.col("_n").isNotNull().alias("_core")))
    few = p.where("not _core").select("point_id", "x", "y")
    enough = meetings(few, p.select("x", "y"), eps).groupBy(F.col("a_point_id").alias("point_id")).agg(F.count("*").alias("_m")).where(F.col("_m") >= min_pts)
    core = cut(p.where("_core").select("point_id", "x", "y").unionByName(few.join(enough.select("point_id"), "point_id", "left_semi")))
    named = cut(_numbered(clique_components(core, eps, dims=("x", "y"), id_col="point_id"), [], "label", 0).select("point_id", "label"))
    others = few.join(named.select("point_id"), "point_id", "left_anti")
    border = meetings(others, core.join(named, "point_id").select("x", "y", "label"), eps).groupBy(F.col("a_point_id").alias("point_id")).agg(F.min("b_label").alias("label"))
    return points.join(named.unionByName(border), "point_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def clique_labels(points: DataFrame, m: int, r: int) -> DataFrame:
    """Points with label: ``m`` bins along each min-max scaled axis, cells of at least ``r`` points, touching cells joined."""
    scaled = minmax_scale(points.withColumns({"ox": F.col("x"), "oy": F.col("y")}))
    grid = {"nx": F.lit(m), "ny": F.lit(m), "x_min": F.lit(0.0), "x_max": F.lit(1.0), "y_min": F.lit(0.0), "y_max": F.lit(1.0)}
    binned = assign_cells(scaled.withColumns(grid))
    dense = cell_counts(binned, ["nx", "ny"]).where(F.col("n") >= r)
    out = label_points(binned, cell_components(dense))
    return out.withColumns({"x": F.col("ox"), "y": F.col("oy")}).drop("ox", "oy", "i", "j", *grid)


def compare_methods(points: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]], with_silhouette: bool = True) -> DataFrame:
    """One row of scores per method; each is given the points (with truth) and returns them labelled."""
    both = None
    for name, f in methods.items():
        got = f(points).select("point_id", "x", "y", "truth", F.col("label").cast("int").alias("label"), F.lit(name).alias("method"))
        both = got if both is None else both.unionByName(got)
    return cluster_report(both, ["method"], with_silhouette)
