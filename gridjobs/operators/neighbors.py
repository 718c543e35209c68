"""Range joins: pairs within a radius and nearest neighbours, by buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.sources.points import finite

#: Points of a bucket or leaf that one task pairs; fuller buckets are cut into parts and each pair of parts is dealt out.
PART = 2_000
#: Distinct points of a leaf; points above and below that a first search of a leaf's slab looks at; visits of a leaf that one task takes.
LEAF, WINDOW, VISITS = 8_000, 8, 50_000


def squared_distance(a: str, b: str, dims: Sequence[str]) -> Column:
    return reduce(lambda s, d: s + d, ((F.col(f"{a}_{d}") - F.col(f"{b}_{d}")) * (F.col(f"{a}_{d}") - F.col(f"{b}_{d}")) for d in dims))


def radius_pairs(points: DataFrame, r: float, keys: Sequence[str] = (), dims: Sequence[str] = ("x", "y", "z"), id_col: str = "atom_id") -> DataFrame:
    """(keys, src, dst, distance) of all pairs with src < dst within distance ``r`` (inclusive).

    Space is cut into buckets of edge r. A point of a bucket can pair with its own bucket and the neighbouring ones, of which
    half (the forward ones) are enough. Points are keyed by bucket once and copied to the forward neighbours once, so it is one
    equi-join. The join's key has a part number on one side, over which the other side is copied in fuller buckets, so that a
    dense bucket is dealt out over tasks.
    """
    keys, dims = list(keys), list(dims)
    p = points.select(*keys, F.col(id_col).alias("id"), *dims)
    home = F.struct(*(F.floor(F.col(d) / r).cast("long").alias(d) for d in dims))
    p = p.withColumn("bucket", home)
    full = p.groupBy(*keys, "bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    forward = [o for o in product((-1, 0, 1), repeat=len(dims)) if o >= (0,) * len(dims)]
    near = F.array(*(F.struct(*((F.col(f"bucket.{d}") + o).alias(d) for d, o in zip(dims, off, strict=True))) for off in forward))
    same = F.array(*(F.lit(all(x == 0 for x in off)) for off in forward))
    left = p.select(*(F.col(k) for k in keys), F.col("id").alias("a_id"), *(F.col(d).alias(f"a_{d}") for d in dims), F.explode(F.arrays_zip(near.alias("bucket"), same.alias("same"))).alias("n"))
    left = left.select(*keys, "a_id", *(f"a_{d}" for d in dims), F.col("n.bucket").alias("bucket"), F.col("n.same").alias("same"))
    right = p.select(*keys, F.col("id").alias("b_id"), *(F.col(d).alias(f"b_{d}") for d in dims), "bucket")
    on = [*keys, "bucket"]
    left = left.join(full, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    right = right.join(full, on, "left").withColumn("part", F.pmod(F.xxhash64("b_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    pairs = left.join(right, [*on, "part"]).where(~F.col("same") | (F.col("a_id") < F.col("b_id")))
    d2 = squared_distance("a", "b", dims)
    return pairs.where(d2 <= r * r).select(*keys, F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst"), F.sqrt(d2).alias("distance"))


def meetings(left: DataFrame, right: DataFrame, r: float, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows of ``left`` beside each row of ``right`` within distance ``r``, for aggregates that are taken at once.

    Columns of ``left`` get the prefix a_, those of ``right`` b_. Each row of ``left`` is copied to the buckets around its own; rows
    of a fuller bucket of ``right`` are dealt out in parts, over which what comes to it is copied.
    """
    dims = list(dims)
    bucket = F.struct(*(F.floor(F.col(d) / r).cast("long").alias(d) for d in dims))
    b = right.withColumn("_bucket", bucket)
    full = b.groupBy("_bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")).where("_parts > 1")
    b = b.join(full, "_bucket", "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.coalesce("_parts", F.lit(1))).cast("int"))
    around = F.array(*(F.struct(*((F.floor(F.col(d) / r).cast("long") + o).alias(d) for d, o in zip(dims, off, strict=True))) for off in product((-1, 0, 1), repeat=len(dims))))
    a = left.withColumn("_bucket", F.explode(around)).join(full, "_bucket", "left")
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    a = a.select("_bucket", "_part", *(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = b.select("_bucket", "_part", *(F.col(c).alias(f"b_{c}") for c in right.columns))
    return a.join(b, ["_bucket", "_part"]).where(squared_distance("a", "b", dims) <= r * r).drop("_bucket", "_part")


def _brute(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
    out, rows = np.full((len(ax), k), np.inf), max(1, 1_000_000 // max(1, len(bx)))
    for at in range(0, len(ax), rows):
        dx, dy = ax[at : at + rows, None] - bx[None], ay[at : at + rows, None] - by[None]
        d = np.sqrt(dx * dx + dy * dy)
        d = np.partition(d, k - 1, 1)[:, :k] if d.shape[1] > k else d
        out[at : at + rows, : d.shape[1]] = d
    return out


def nearest(ax: np.ndarray, ay: np.ndarray, bound: np.ndarray, bx: np.ndarray, by: np.ndarray, k: int, window: int = WINDOW) -> np.ndarray:
    """Distances from each point a to its ``k`` nearest of the points b, a row each in no order, infinite where there are fewer; those of
    ``bound`` and more may be too large.

    The points b are cut into slabs of equal counts along x, each in order of y. A point looks at ``window`` points above and below in the
    slab where it lies and in both beside it. Where the k-th distance (or the bound) reaches out of what was looked at, it looks again
    in windows four times as wide, and at last at all points.
    """
    wide, m = 2 * window + 1, len(bx)
    if m <= 6 * wide or k > 3 * wide:
        return _brute(ax, ay, bx, by, k)
    low, high = by.min(), by.max()
    ratio = (bx.max() - bx.min()) / (high - low) if high > low else np.inf
    slabs = int(min(max(1.0, np.sqrt(m * ratio) / 2), m // wide))
    slab = np.empty(m, np.int64)
    slab[np.argsort(bx, kind="stable")] = np.arange(m) * slabs // m
    order = np.lexsort((by, slab))
    x, y, slab = bx[order], by[order], slab[order]
    start = np.searchsorted(slab, np.arange(slabs + 1))
    left, right = np.minimum.reduceat(x, start[:-1]), np.maximum.reduceat(x, start[:-1])
    height = lambda v: 0.999 * np.clip((v - low) / (high - low), 0.0, 1.0) if high > low else np.zeros(len(v))
    place, out = slab + height(y), np.full((len(ax), k), np.inf)
    for at in range(0, len(ax), 10_000):
        px, py = ax[at : at + 10_000], ay[at : at + 10_000]
        home, up = np.searchsorted(right[:-1], px), height(py)
        d, ends = np.full((len(px), 3 * wide), np.inf), []
        for n in range(3):
            there = np.nonzero((home + n >= 1) & (home + n <= slabs))[0]
            t = home[there] + n - 1
            first = np.clip(np.searchsorted(place, t + up[there]) - window, start[t], start[t + 1] - wide)
            to = first[:, None] + np.arange(wide)
            dx, dy = px[there, None] - x[to], py[there, None] - y[to]
            d[there, n * wide : (n + 1) * wide] = np.sqrt(dx * dx + dy * dy)
            below = np.where(first > start[t], py[there] - y[first], np.inf)
            above = np.where(first + wide < start[t + 1], y[first + wide - 1] - py[there], np.inf)
            ends.append((there, np.minimum(below, above)))
        got = np.partition(d, k - 1, 1)[:, :k]
        r = np.minimum(got.max(1), bound[at : at + 10_000])
        seen = np.minimum(np.where(home >= 2, px - right[np.maximum(home - 2, 0)], np.inf), np.where(home + 2 < slabs, left[np.minimum(home + 2, slabs - 1)] - px, np.inf))
        for there, end in ends:
            seen[there] = np.minimum(seen[there], end)
        again = np.nonzero(~((seen >= _beyond(r, px, py)) | (got.max(1) == 0)))[0]
        if len(again):
            got[again] = nearest(px[again], py[again], bound[at : at + 10_000][again], bx, by, k, 4 * window)
        out[at : at + 10_000] = got
    return out


def _beyond(r: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A little more than ``r``, for what rounding does to distances of such coordinates."""
    return r * (1 + 1e-9) + 4e-15 * np.maximum(abs(x), abs(y))


def leaves(points: DataFrame, n: int, leaf: int, id_col: str = "id") -> DataFrame:
    """Points with the slab and the block of about ``leaf`` points in which they lie: slabs of about equal counts along x, each cut into
    blocks of equal counts along y. A dense place makes more leaves, however small it is; equal points may be parted."""
    from gridjobs.operators.labelling import RANKED, ranked

    slabs = math.ceil(math.sqrt(math.ceil(n / leaf)))
    along = [F.col("x"), F.col("y"), F.col(id_col)]
    if n <= RANKED:
        d = ranked(points, [], along, "_at").withColumn("slab", F.floor(F.col("_at") * slabs / F.lit(n)).cast("int")).drop("_at")
    else:  # ranges are of about equal counts, which is all that slabs need
        d = cut(points.repartitionByRange(slabs, *along).withColumn("slab", F.spark_partition_id()))
    m = d.groupBy("slab").agg(F.count("*").alias("_m"))
    up = F.row_number().over(Window.partitionBy("slab").orderBy("y", "x", id_col)) - 1
    d = d.withColumn("_at", up).join(F.broadcast(m), "slab")
    return d.withColumn("block", F.floor(F.col("_at") * F.ceil(F.col("_m") / leaf) / F.col("_m")).cast("int")).drop("_at", "_m")


def _at_home(k: int):
    """Each point of a leaf with its k-th distance in it; ``open`` if that reaches out of the leaf's box, then with all k."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, y, n = g["x"].to_numpy(), g["y"].to_numpy(), g["n"].to_numpy()
        times = np.minimum(n, k + 1)
        near, few = np.zeros((len(g), k)), n <= k
        got = nearest(x[few], y[few], np.full(few.sum(), np.inf), np.repeat(x, times), np.repeat(y, times), k + 1)
        near[few] = np.sort(got, 1)[:, 1:]  # the first is the point itself
        far = near[:, -1]
        r = _beyond(far, x, y)
        out = (x - r <= x.min()) | (x + r >= x.max()) | (y - r <= y.min()) | (y + r >= y.max())
        out &= far > 0
        told = np.full(len(g), None, object)
        for at in np.nonzero(out)[0]:
            told[at] = near[at]
        return g.assign(distance=far, r=r, open=out, near=told)

    return run


def _reach(boxes: pd.DataFrame, k: int):
    """Rows (x, y, bound, slab, block) for open points: one for each leaf to visit, and one without a leaf that tells the bound.

    A leaf is visited if its box is nearer than the bound: the k-th distance at home or, if smaller, the distance to the far corner of
    a leaf that holds k points."""
    slab, lo_x, hi_x, lo_y, hi_y = (boxes[c].to_numpy() for c in ("slab", "lo_x", "hi_x", "lo_y", "hi_y"))
    block, holds = boxes["block"].to_numpy(), boxes["n"].to_numpy() >= k
    start = np.append(np.nonzero(np.append(True, slab[1:] != slab[:-1]))[0], len(slab))
    lo, hi = np.minimum.reduceat(lo_x, start[:-1]), np.maximum.reduceat(hi_x, start[:-1])

    def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(last - first, 0)
        at = np.repeat(np.arange(len(n)), n)
        return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x, y, r, bound = (g[c].to_numpy() for c in ("x", "y", "r", "distance"))
        at, s = spread(np.searchsorted(hi, x - r), np.searchsorted(lo, x + r, "right"))
        first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for n in np.unique(s):
            of, own = s == n, slice(start[n], start[n + 1])
            first[of] = start[n] + np.searchsorted(hi_y[own], (y - r)[at[of]])
            last[of] = start[n] + np.searchsorted(lo_y[own], (y + r)[at[of]], "right")
        pair, b = spread(first, last)
        at = at[pair]
        dx, dy = np.maximum(0, np.maximum(lo_x[b] - x[at], x[at] - hi_x[b])), np.maximum(0, np.maximum(lo_y[b] - y[at], y[at] - hi_y[b]))
        least = np.sqrt(dx * dx + dy * dy)
        dx, dy = np.maximum(abs(x[at] - lo_x[b]), abs(x[at] - hi_x[b])), np.maximum(abs(y[at] - lo_y[b]), abs(y[at] - hi_y[b]))
        home = (slab[b] == g["slab"].to_numpy()[at]) & (block[b] == g["block"].to_numpy()[at])
        bound = bound.copy()
        np.minimum.at(bound, at, np.where(holds[b] & ~home, np.sqrt(dx * dx + dy * dy), np.inf))
        go = ~home & (least < bound[at])
        at, b = at[go], b[go]
        all_, none = np.append(np.arange(len(g)), at), np.full(len(g), -1)
        return pd.DataFrame({"x": x[all_], "y": y[all_], "bound": bound[all_], "slab": np.append(none, slab[b]), "block": np.append(none, block[b])})

    def run(parts):
        for g in parts:
            for at in range(0, len(g), 500):
                yield one(g.iloc[at : at + 500])

    return run


def _visited(k: int):
    """The k nearest distances in a leaf for each point that visits it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        times = np.minimum(right["n"].to_numpy(), k)
        x, y, bound = (left[c].to_numpy() for c in ("x", "y", "bound"))
        got = nearest(x, y, bound, np.repeat(right["x"].to_numpy(), times), np.repeat(right["y"].to_numpy(), times), k)
        return pd.DataFrame({"x": x, "y": y, "bound": bound, "near": list(got)})

    return run


def distinct_knn(points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(x, y, n, distance) of every distinct 2D point: how many points lie there and the distance of each to its k-th nearest other
    point; no row with k points or fewer.

    Equal points are counted first. Distinct points are dealt into leaves of equal counts, so that a spot that holds most points costs a
    task no more rows than an even spread. The k-th distance within its leaf bounds a point's search; where that reaches out of the leaf's
    box, the point visits the leaves whose box is nearer than the bound and nearer than the far corner of any other leaf in reach that
    holds k points. That leaves nothing out: who is nearer than the answer lies in a visited leaf. Visits to a leaf are dealt out in
    parts. The driver gets the boxes of leaves. Points with null or non-finite coordinates take no part.
    """
    p = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite("x", "y"))
    p = cut(p.groupBy("x", "y").agg(F.count("*").alias("n")))
    rows, n = p.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= k:
        return p.select("x", "y", "n", F.lit(None).cast("double").alias("distance")).where(F.lit(False))
    d = cut(leaves(p, rows, max(leaf, 4 * (k + 1)), "n").select("x", "y", "n", "slab", "block"))
    kind = "x double, y double, n long, slab int, block int, distance double, r double, open boolean, near array<double>"
    home = cut(d.groupBy("slab", "block").applyInPandas(_at_home(k), kind))
    boxes = d.groupBy("slab", "block").agg(*(f(c).alias(f"{s}_{c}") for c in "xy" for s, f in (("lo", F.min), ("hi", F.max))), F.sum("n").alias("n"))
    boxes = boxes.toPandas().sort_values(["slab", "block"], ignore_index=True)
    visits = cut(home.where("open").select("x", "y", "slab", "block", "distance", "r").mapInPandas(_reach(boxes, k), "x double, y double, bound double, slab int, block int"))
    left = visits.where("slab >= 0")
    parts = left.groupBy("slab", "block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
    right = d.join(parts, ["slab", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.join(parts, ["slab", "block"]).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int"))
    on = ["slab", "block", "part"]
    found = left.groupBy(*on).cogroup(right.select(*on, "x", "y", "n").groupBy(*on)).applyInPandas(_visited(k), "x double, y double, bound double, near array<double>")
    none = F.lit(None)
    told = home.where("open").select("x", "y", none.cast("double").alias("bound"), "near", "n").unionByName(found.withColumn("n", none.cast("long")))
    told = told.unionByName(visits.where("slab < 0").select("x", "y", "bound", none.cast("array<double>").alias("near"), none.cast("long").alias("n")))
    kth = F.element_at(F.sort_array(F.flatten(F.collect_list("near"))), k)
    kth = told.groupBy("x", "y").agg(F.max("n").alias("n"), F.least(kth, F.min("bound")).alias("distance"))
    return home.where("not open").select("x", "y", "n", "distance").unionByName(kth)


def knn_distances(points: DataFrame, k: int, id_col: str = "point_id", leaf: int = LEAF) -> DataFrame:
    """(id, distance): distance of every 2D point to its k-th nearest other point, by ``distinct_knn``; no row with k points or fewer.
    Equal points are neighbours at distance 0. Ids are whole numbers."""
    p = points.select(F.col(id_col).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return p.join(cut(distinct_knn(points, k, leaf)), ["x", "y"]).select("id", "distance")
