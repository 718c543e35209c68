"""Binning of points, cell tables, and which cells count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Threshold where no cell is dense.
NO_DENSE = 0.30


def _axis(value: Column, low: Column, high: Column, n: Column) -> Column:
    """Cell number along one axis, clamped; an axis without width has cells of width 1."""
    width = (high - low) / n
    return F.greatest(F.lit(0), F.least(F.floor((value - low) / F.when(width > 0, width).otherwise(1.0)), n - 1)).cast("int")


def assign_cells(points: DataFrame) -> DataFrame:
    """2D points that carry their grid (nx, ny, x_min, x_max, y_min, y_max) with cell numbers i and j, clamped to the grid."""
    c = F.col
    return points.withColumns({"i": _axis(c("x"), c("x_min"), c("x_max"), c("nx")), "j": _axis(c("y"), c("y_min"), c("y_max"), c("ny"))})


def box_cells(atoms: DataFrame, boxes: DataFrame, sizes: Sequence[tuple[float, float, float]], wrap: bool = True) -> DataFrame:
    """Atoms with cell numbers xi, yi, zi for every cell size (size_id, dx, dy, dz), and the lattice's extent mx, my, mz.

    With ``wrap`` an axis of length L has ceil(L / d) cells and numbers are taken modulo that; without, it has floor(L / d) cells
    and atoms beyond the last keep their number, so they meet no lattice cell.
    """
    spark = atoms.sparkSession
    s = spark.createDataFrame([(n, float(a), float(b), float(c)) for n, (a, b, c) in enumerate(sizes)], "size_id int, dx double, dy double, dz double")
    grid = boxes.crossJoin(F.broadcast(s))
    count = F.ceil if wrap else F.floor
    grid = grid.withColumns({f"m{a}": F.greatest(count((F.col(f"{a}hi") - F.col(f"{a}lo")) / F.col(f"d{a}")), F.lit(1)).cast("int") for a in "xyz"})
    grid = grid.select("step", "size_id", "dx", "dy", "dz", "mx", "my", "mz", *(f"{a}lo" for a in "xyz"))
    d = atoms.drop("xlo", "xhi", "ylo", "yhi", "zlo", "zhi").join(F.broadcast(grid), "step")
    at = {a: F.floor((F.col(a) - F.col(f"{a}lo")) / F.col(f"d{a}")).cast("int") for a in "xyz"}
    return d.withColumns({f"{a}i": F.pmod(at[a], F.col(f"m{a}")) if wrap else at[a] for a in "xyz"})


BOX_KEYS = ["step", "size_id"]
BOX_INFO = ["dx", "dy", "dz", "mx", "my", "mz", "xlo", "ylo", "zlo"]


def cell_counts(binned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points per occupied cell. Partial sums leave each task, so a cell of any size costs one row a task."""
    return binned.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))


def normalize_nonzero(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """norm: the count's place between the smallest and the largest of its grid; 0 where all are equal."""
    from gridjobs.operators.prepare import with_row

    m = cells.groupBy(*keys).agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    d = with_row(cells, m, keys)
    return d.withColumn("norm", F.when(F.col("_hi") > F.col("_lo"), (F.col("n") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def cell_means(binned: DataFrame, keys: Sequence[str] = tuple(BOX_KEYS), label: str = "c_label") -> DataFrame:
    """Mean label and count of every occupied 3D cell."""
    info = [c for c in BOX_INFO if c in binned.columns]
    return binned.groupBy(*keys, *info, "xi", "yi", "zi").agg(F.avg(label).alias("label_mean"), F.count("*").alias("cn"))


def cell_geometry(cells: DataFrame) -> DataFrame:
    """2D cells that carry their grid: corners x0, x1, y0, y1 and centre cx, cy; 3D cells: centre x, y, z."""
    c = F.col
    if "zi" in cells.columns:
        return cells.withColumns({a: c(f"{a}lo") + (c(f"{a}i") + 0.5) * c(f"d{a}") for a in "xyz"})
    dx, dy = (c("x_max") - c("x_min")) / c("nx"), (c("y_max") - c("y_min")) / c("ny")
    low = {"x0": c("x_min") + c("i") * dx, "y0": c("y_min") + c("j") * dy}
    return cells.withColumns(low).withColumns({"x1": c("x0") + dx, "y1": c("y0") + dy, "cx": c("x0") + dx / 2, "cy": c("y0") + dy / 2})


def full_lattice(cells: DataFrame, keys: Sequence[str] = tuple(BOX_KEYS)) -> DataFrame:
    """Every cell of each lattice; cn is 0 and label_mean null where it is empty. Cells outside their lattice fall out."""
    grids = cells.select(*keys, *BOX_INFO).distinct()
    all_ = grids.withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("mx") - 1)))
    for a in "yz":
        all_ = all_.withColumn(f"{a}i", F.explode(F.sequence(F.lit(0), F.col(f"m{a}") - 1)))
    return all_.join(cells.select(*keys, "xi", "yi", "zi", "label_mean", "cn"), [*keys, "xi", "yi", "zi"], "left").fillna({"cn": 0})


def label_points(binned: DataFrame, labels: DataFrame, keys: Sequence[str] = (), cell: Sequence[str] = ("i", "j")) -> DataFrame:
    """Binned points with the label of their cell, -1 where it has none. Labels are as many as cells at most; the join is left
    to the planner, which broadcasts them where they are small."""
    on = [*keys, *cell]
    return binned.join(labels.select(*on, "label"), on, "left").fillna({"label": -1})


def cell_members(binned: DataFrame, clusters: DataFrame, keys: Sequence[str] = tuple(BOX_KEYS)) -> DataFrame:
    """Atoms in each cluster's cells, whatever their own label."""
    on = [*keys, "xi", "yi", "zi"]
    return binned.join(clusters.select(*on, "cluster_id"), on).select(*keys, "cluster_id", "atom_id")


def dense_by_threshold(cells: DataFrame, threshold: Column | float) -> DataFrame:
    return cells.withColumn("dense", F.col("norm") >= (F.lit(threshold) if isinstance(threshold, float) else threshold))


def dense_by_quantile(cells: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Each cell once per quantile q, with the threshold thr of its grid and whether it is dense."""
    from gridjobs.operators.prepare import with_row

    qs = F.array(*map(F.lit, map(float, quantiles)))
    t = cells.groupBy(*keys).agg(F.percentile("norm", qs).alias("t")).select(*keys, F.explode(F.arrays_zip(qs.alias("q"), F.col("t").alias("thr"))).alias("z"))
    d = with_row(cells, t.select(*keys, F.col("z.q").alias("q"), F.col("z.thr").alias("thr")), keys)
    return d.withColumn("dense", F.col("norm") >= F.col("thr"))


def dense_by_count(cells: DataFrame, least: Column | int, keys: Sequence[str] = ()) -> DataFrame:
    """Cells with at least ``least`` points are dense; thr is the smallest norm among them, 0.30 where there is none."""
    from gridjobs.operators.prepare import with_row

    d = cells.withColumn("dense", F.col("n") >= (F.lit(least) if isinstance(least, int) else least))
    t = d.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("dense"), F.col("norm"))), F.lit(NO_DENSE)).alias("thr"))
    return with_row(d, t, keys)


def classify_cells(cells: DataFrame) -> DataFrame:
    """cell_class: dense or sparse; empty cells have no row."""
    return cells.withColumn("cell_class", F.when(F.col("dense"), "dense").otherwise("sparse"))


def diffusion_weight_scale(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scale): norm's quantile at 1 - share of dense cells, linear between ranks."""
    keys = list(keys)
    from gridjobs.operators.labelling import ranked
    from gridjobs.operators.prepare import with_row

    s = cells.groupBy(*keys).agg(F.count("*").alias("m"), F.count_if("dense").alias("d"))
    s = s.withColumn("at", (F.lit(1.0) - F.col("d") / F.col("m")) * (F.col("m") - 1)).withColumn("lo", F.floor("at"))
    r = ranked(cells.select(*keys, "norm"), keys, [F.col("norm")], "rank")
    t = with_row(r, s, keys).where((F.col("rank") == F.col("lo")) | (F.col("rank") == F.col("lo") + 1))
    low, high = F.max(F.when(F.col("rank") == F.col("lo"), F.col("norm"))), F.max(F.when(F.col("rank") == F.col("lo") + 1, F.col("norm")))
    share = F.max(F.col("at") - F.col("lo"))
    return t.groupBy(*keys).agg((low + F.coalesce(high - low, F.lit(0.0)) * share).alias("scale"))


def select_after_diffusion(cells: DataFrame, cthr: Column | float) -> DataFrame:
    """selected: dense, or sparse with a field value above cthr."""
    return cells.withColumn("selected", F.col("dense") | (F.col("c") > (F.lit(cthr) if isinstance(cthr, float) else cthr)))


def select_cells_3d(cells: DataFrame, thr: Column | float, value: str = "label_mean", strict: bool = False) -> DataFrame:
    """Cells whose value reaches thr; with ``strict`` those above it."""
    t = F.lit(thr) if isinstance(thr, float) else thr
    return cells.where(F.col(value) > t if strict else F.col(value) >= t)
