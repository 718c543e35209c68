"""Bounds, scaling and grid suggestions for 2D points."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.operators.neighbors import distinct_knn

#: Values of which one aggregation takes exact quantiles, and the accuracy of the sketch that narrows more of them.
BUFFERED, ACCURACY = 1_000_000, 10_000


def with_row(df: DataFrame, row: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``row`` (one row for each combination of keys) put beside every row."""
    return df.join(F.broadcast(row), list(keys)) if keys else df.crossJoin(F.broadcast(row))


def bounds(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n_points"))


def _lengths(b: DataFrame) -> DataFrame:
    return b.withColumns({"Lx": F.col("x_max") - F.col("x_min"), "Ly": F.col("y_max") - F.col("y_min")})


def padded_bounds(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bounds, each side moved out by 1e-9 of (range + 1), and the lengths Lx and Ly."""
    pad = lambda a: F.lit(1e-9) * (F.col(f"{a}_max") - F.col(f"{a}_min") + 1)
    b = bounds(points, keys).withColumns({"px": pad("x"), "py": pad("y")})
    moved = {f"{a}_{s}": F.col(f"{a}_{s}") + (1 if s == "max" else -1) * F.col(f"p{a}") for a in "xy" for s in ("min", "max")}
    return _lengths(b.withColumns(moved).drop("px", "py")).where("n_points > 0")


def standardize(points: DataFrame, cols: Sequence[str] = ("x", "y"), keys: Sequence[str] = ()) -> DataFrame:
    """(value - mean) / population deviation for each column; a constant column is only centred."""
    s = points.groupBy(*keys).agg(*(F.avg(c).alias(f"_m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"_s_{c}") for c in cols))
    d = with_row(points, s, keys)
    return d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}).drop(*(f"_{k}_{c}" for k in "ms" for c in cols))


def minmax_scale(points: DataFrame, cols: Sequence[str] = ("x", "y"), keys: Sequence[str] = ()) -> DataFrame:
    """(value - min) / (max - min + 1e-12) for each column."""
    s = points.groupBy(*keys).agg(*(F.min(c).alias(f"_l_{c}") for c in cols), *(F.max(c).alias(f"_h_{c}") for c in cols))
    d = with_row(points, s, keys)
    return d.withColumns({c: (F.col(c) - F.col(f"_l_{c}")) / (F.col(f"_h_{c}") - F.col(f"_l_{c}") + 1e-12) for c in cols}).drop(*(f"_{k}_{c}" for k in "lh" for c in cols))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], weight: str | None = None) -> list[float | None]:
    """Exact quantiles of a column, linear between ranks; none for an empty column. ``weight`` says how often a row counts.

    Up to ``BUFFERED`` rows one aggregation takes them. Beyond that the two ranks of each share are found by narrowing: a sketch
    gives two values that have the ranks between them, counts tell whether it has, and what lies between is looked at by itself. All
    shares go together, so the column is read some four times; a share whose bracket fails or holds too much is narrowed on by
    itself. Only counts and bracketing values reach the driver.
    """
    d = df.select(F.col(column).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).where("v is not null and w > 0")
    rows, n = d.agg(F.count("*"), F.sum("w")).first()
    if rows <= BUFFERED:
        return list(d.agg(F.percentile("v", F.array(*map(F.lit, map(float, shares))), F.col("w"))).first()[0] or [None] * len(shares))
    ranks = [sorted({math.floor((n - 1) * s), math.ceil((n - 1) * s)}) for s in shares]
    margin = 2.0 / ACCURACY
    ends = [e for r in ranks for e in (max(0.0, r[0] / n - margin), min(1.0, r[-1] / n + margin))]
    ends = d.agg(F.percentile_approx("v", ends, ACCURACY)).first()[0]
    pairs = list(zip(ends[::2], ends[1::2], strict=True))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    told = d.agg(*(x for a, b in pairs for x in (count(F.col("v") < a), count(F.col("v").between(a, b)), F.count_if(F.col("v").between(a, b))))).first()
    known = {}
    easy = [m for m, r in enumerate(ranks) if told[3 * m] <= r[0] and r[-1] < told[3 * m] + told[3 * m + 1] and told[3 * m + 2] <= BUFFERED]
    if easy:
        some = reduce(lambda a, b: a | b, (F.col("v").between(*pairs[m]) for m in easy))
        few = cut(d.where(some).groupBy("v").agg(F.sum("w").alias("w")))
        for m in easy:
            own = few.where(F.col("v").between(*pairs[m])).withColumn("upto", F.sum("w").over(Window.orderBy("v")))
            known[m] = list(own.agg(*(F.min(F.when(F.col("upto") > r - told[3 * m], F.col("v"))) for r in ranks[m])).first())
    out = []
    for m, share in enumerate(shares):
        values = known.get(m) or [_ranked(d, rank) for rank in ranks[m]]
        at = (n - 1) * share
        out.append(values[0] + (values[-1] - values[0]) * (at - math.floor(at)))
    return out


def _ranked(d: DataFrame, rank: int) -> float:
    """The value of rank ``rank`` (from 0) of values v that count w times each."""
    margin = 2.0 / ACCURACY
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    while True:
        rows, m = d.agg(F.count("*"), F.sum("w")).first()
        if rows <= BUFFERED:
            few = d.groupBy("v").agg(F.sum("w").alias("n"))
            upto = few.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
            return upto.where(F.col("upto") > rank).agg(F.min("v")).first()[0]
        ends = [max(0.0, rank / m - margin), min(1.0, rank / m + margin)]
        a, b = d.agg(F.percentile_approx("v", ends, ACCURACY)).first()[0]
        below, inside = d.agg(count(F.col("v") < a), count(F.col("v").between(a, b))).first()
        if not below <= rank < below + inside:
            margin *= 4
        elif a == b:
            return a
        elif inside == m:  # the bracket holds all: one side of the middle value goes on, or it is the one
            mid = d.agg(F.percentile_approx("v", 0.5, ACCURACY)).first()[0]
            less, same = d.agg(count(F.col("v") < mid), count(F.col("v") == mid)).first()
            if less <= rank < less + same:
                return mid
            d, rank = (d.where(F.col("v") < mid), rank) if rank < less else (d.where(F.col("v") > mid), rank - less - same)
        else:
            d, rank, margin = d.where(F.col("v").between(a, b)), rank - below, 2.0 / ACCURACY


def _one_row(df: DataFrame, value: float | None, name: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias(name))


def knn_spacing(points: DataFrame, k: int = 5, alpha: float = 1.0) -> DataFrame:
    """One row, knn_h: alpha times the median distance to the k-th other point, at least 1e-12; null with k points or fewer."""
    half = quantiles(cut(distinct_knn(points, k).select("distance", "n")), "distance", [0.5], "n")[0]
    return _one_row(points, None if half is None else max(1e-12, alpha * half), "knn_h")


def occupancy_spacing(points: DataFrame, target_occ: float = 4, max_bins: int = 200) -> DataFrame:
    """One row, occ_h: cell edge at which a cell holds about ``target_occ`` points, the bounds' aspect kept; rounding is half-even."""
    b = _lengths(bounds(points))
    cells = F.greatest(F.lit(1.0), F.rint(F.col("n_points") / F.lit(float(target_occ))))
    r = F.col("Lx") / (F.col("Ly") + 1e-12)
    b = b.withColumn("ny", F.rint(F.sqrt(cells / (r + 1e-12)))).withColumn("nx", F.rint(r * F.col("ny")))
    b = b.withColumns({c: F.greatest(F.lit(1.0), F.least(F.col(c), F.lit(float(max_bins)))) for c in ("nx", "ny")})
    return b.select(F.sqrt((F.col("Lx") / F.col("nx")) * (F.col("Ly") / F.col("ny"))).alias("occ_h"))


def fd_spacing(points: DataFrame) -> DataFrame:
    """One row, fd_h: geometric mean over the axes of twice the interquartile range over the cube root of the count."""
    n = points.count()
    if not n:
        return _one_row(points, None, "fd_h")
    wide = []
    for axis in "xy":
        low, high = quantiles(points, axis, [0.25, 0.75])
        wide.append(max(2.0 * (high - low) / (n ** (1.0 / 3.0) + 1e-12), 1e-12))
    return _one_row(points, math.sqrt(wide[0] * wide[1]), "fd_h")


def grid_size(length: str, h, max_bins: int):
    """Cells along an axis for cells of width h."""
    return F.greatest(F.lit(1), F.least(F.ceil(F.col(length) / h), F.lit(max_bins))).cast("int")


def spacing_seeds(points: DataFrame, k: int = 5, alpha: float = 1.0, target_occ: float | None = 4, fd_backup: bool = True, max_bins: int = 200) -> DataFrame:
    """One row: unpadded bounds and lengths, the three spacings (null where left out), h0 (their mean), the initial grid
    (nx0, ny0) and its cell edge h_est."""
    b = _lengths(bounds(points))
    none = lambda name: points.sparkSession.range(1).select(F.lit(None).cast("double").alias(name))
    for part in (knn_spacing(points, k, alpha), occupancy_spacing(points, target_occ, max_bins) if target_occ else none("occ_h"), fd_spacing(points) if fd_backup else none("fd_h")):
        b = b.crossJoin(F.broadcast(part))
    hs = F.filter(F.array("knn_h", "occ_h", "fd_h"), lambda h: h.isNotNull())
    mean = F.aggregate(hs, F.lit(0.0), lambda a, h: a + h, lambda a: a / F.greatest(F.size(hs), F.lit(1)))
    b = b.withColumn("h0", F.when(F.size(hs) > 0, mean).otherwise(F.greatest(F.lit(1e-12), 0.05 * F.greatest("Lx", "Ly"))))
    b = b.withColumns({"nx0": grid_size("Lx", F.col("h0"), max_bins), "ny0": grid_size("Ly", F.col("h0"), max_bins)})
    return b.withColumn("h_est", F.greatest(F.col("Lx") / F.col("nx0"), F.col("Ly") / F.col("ny0")))


def grids_around(seeds: DataFrame, sweep_pct: float = 0.2, max_bins: int = 200) -> DataFrame:
    """Distinct grids (cand_id, nx, ny, h) of seven widths around h_est, in order of their first width."""
    s = seeds.select("Lx", "Ly", "h_est", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n"))
    # evenly spaced in this order of operations, the last one exactly: a whole quotient of length and width must not flip
    lo, hi = F.lit(1 - sweep_pct) * F.col("h_est"), F.lit(1 + sweep_pct) * F.col("h_est")
    h = F.when(F.col("n") == 6, hi).otherwise(F.col("n") * ((hi - lo) / 6) + lo)
    s = s.withColumn("h", F.least(F.greatest(h, F.lit(1e-12)), F.greatest("Lx", "Ly", F.lit(1e-12))))
    s = s.withColumns({"nx": grid_size("Lx", F.col("h"), max_bins), "ny": grid_size("Ly", F.col("h"), max_bins)})
    g = s.groupBy("nx", "ny").agg(F.min("n").alias("n"), F.max(F.greatest(F.col("Lx") / F.col("nx"), F.col("Ly") / F.col("ny"))).alias("h"))
    return g.select((F.row_number().over(Window.orderBy("n")) - 1).alias("cand_id"), "nx", "ny", "h")


def suggest_grids(points: DataFrame, k: int = 5, alpha: float = 1.0, target_occ: float | None = 4, fd_backup: bool = True, sweep_pct: float = 0.2, max_bins: int = 200) -> DataFrame:
    """Grid candidates (cand_id, nx, ny, h) for a point table. At most seven rows, so their numbering is one small task."""
    return grids_around(spacing_seeds(points, k, alpha, target_occ, fd_backup, max_bins), sweep_pct, max_bins)


def preselect_grid(points: DataFrame, target_occ: float = 4, k: int = 5, alpha: float = 1.0, max_bins: int = 200) -> DataFrame:
    """Cells (nx, ny, i, j, n, norm) of the initial grid, binned within unpadded bounds."""
    from gridjobs.operators.grid import assign_cells, cell_counts, normalize_nonzero

    seeds = spacing_seeds(points, k, alpha, target_occ, True, max_bins)
    grid = seeds.select(F.col("nx0").alias("nx"), F.col("ny0").alias("ny"), "x_min", "x_max", "y_min", "y_max")
    return normalize_nonzero(cell_counts(assign_cells(with_row(points, grid)), ["nx", "ny"]), ["nx", "ny"])
