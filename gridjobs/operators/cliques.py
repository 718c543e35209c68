"""Components of points within a radius, by buckets whose points all reach each other (clique cells)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.kernels import smallest_reachable
from gridjobs.functions.session import cut
from gridjobs.operators.components import components

#: Buckets along an edge of a tile, by dimensions; points of a bucket that a tile is given; thinned edges that one task finishes.
TILE, FULL, FINISH = {1: 4_096, 2: 128, 3: 24}, 64, 2_000_000
#: Pairs of points that are looked at together, and points of a bucket that one task pairs.
BLOCK, PART = 2_000_000, 2_000
#: Share by which buckets are narrower than their points' reach, for coordinates of up to 10**9 radii.
MARGIN = 1e-6
POINT, RIM, OPEN = 0, 1, 2


def linked_cells(x: np.ndarray, cell: np.ndarray, ids: np.ndarray, outline: np.ndarray, own: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For points in buckets: (bucket of each point, smallest id of each bucket, bucket's root, pairs left open).

    The root is the smallest bucket (in order of its smallest id) that is reached. Two buckets are linked if one point of each is
    within ``r``: surely if the farthest corners of their boxes are, surely not if the nearest are not, else a pair of points
    is searched, nearest buckets first, and only for buckets that are not joined already. Buckets with ``outline`` are given by their
    outermost points; where these do not decide, the pair is left open. Pairs without an ``own`` bucket are left to others.
    """
    dims = x.shape[1]
    low = cell.min(0) - _reach(dims)
    span = cell.max(0) - low + 1 + _reach(dims)
    weight = np.append(np.cumprod(span[:0:-1])[::-1], 1)
    code = (cell - low) @ weight
    order = np.lexsort((ids, code))
    start = np.nonzero(np.append(True, np.diff(code[order]) > 0))[0]
    size = np.diff(np.append(start, len(order)))
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(start)), size)
    first = order[start]
    lead, known = ids[first], code[first]
    sorted_x = x[order]
    box_low, box_high = np.minimum.reduceat(sorted_x, start), np.maximum.reduceat(sorted_x, start)
    by_lead = np.argsort(lead, kind="stable")
    number = np.empty(len(lead), np.int64)
    number[by_lead] = np.arange(len(lead))
    root = np.arange(len(lead))
    r2, left_open = r * r, []
    a_all, b_all = np.empty(0, np.int64), np.empty(0, np.int64)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal a_all, b_all, root
        a_all, b_all = np.append(a_all, number[a]), np.append(b_all, number[b])
        root = smallest_reachable(len(lead), a_all, b_all)
        a_all, b_all = np.arange(len(lead)), root  # a forest says the same

    found = []
    for o in _forward(dims):
        at = np.minimum(np.searchsorted(known, known + int(np.dot(o, weight))), len(known) - 1)
        a = np.nonzero(known[at] == known + int(np.dot(o, weight)))[0]
        a = a[own[first[a]] | own[first[at[a]]]]
        found.append((sum(max(0, abs(k) - 1) ** 2 for k in o), sum(k * k for k in o), a, at[a]))
    found.sort(key=lambda f: f[:2])
    undecided = []
    sure_a, sure_b = [], []
    for gap, _, a, b in found:
        nearest = np.maximum(np.maximum(box_low[a] - box_high[b], box_low[b] - box_high[a]), 0)
        farthest = np.maximum(box_high[a] - box_low[b], box_high[b] - box_low[a])
        sure = (farthest**2).sum(1) <= r2
        sure_a.append(a[sure])
        sure_b.append(b[sure])
        maybe = ~sure & ((nearest**2).sum(1) <= r2)
        undecided.append((gap, a[maybe], b[maybe]))
    if sure_a:
        join(np.concatenate(sure_a), np.concatenate(sure_b))
    for gap in sorted({g for g, _, _ in undecided}):
        a, b = (np.concatenate([u[k] for u in undecided if u[0] == gap]) for k in (1, 2))
        apart = root[number[a]] != root[number[b]]
        a, b = a[apart], b[apart]
        hit = np.zeros(len(a), bool)
        n = size[a] * size[b]
        ends = np.append(0, np.cumsum(n))
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK, "right")) - 1)
            of = np.repeat(np.arange(lo, hi), n[lo:hi])
            k = np.arange(len(of)) - np.repeat(ends[lo:hi] - ends[lo], n[lo:hi])
            d = sorted_x[start[a[of]] + k // size[b[of]]] - sorted_x[start[b[of]] + k % size[b[of]]]
            hit[lo:hi] = np.bincount(of - lo, (d * d).sum(1) <= r2, hi - lo) > 0
            lo = hi
        join(a[hit], b[hit])
        part = ~hit & (outline[first[a]] | outline[first[b]])
        left_open.append(np.stack([a[part], b[part]], 1))
    pairs = np.concatenate(left_open) if left_open else np.empty((0, 2), np.int64)
    pairs = pairs[root[number[pairs[:, 0]]] != root[number[pairs[:, 1]]]]
    return place, lead, lead[by_lead][root[number]], lead[pairs]


def _reach(dims: int) -> int:
    """How many buckets further a point within the radius can lie."""
    return int(dims**0.5 * (1 + 2 * MARGIN)) + 1


def _forward(dims: int) -> list[tuple[int, ...]]:
    """Offsets of buckets, each pair once, that can hold points within the radius, of which ``dims`` ** 0.5 edges are a little less."""
    reach = range(-_reach(dims), _reach(dims) + 1)
    return [o for o in product(reach, repeat=dims) if o > (0,) * dims and sum(max(0, abs(k) - 1) ** 2 for k in o) <= dims]


def clique_components(points: DataFrame, r: float, keys: Sequence[str] = (), dims: Sequence[str] = ("x", "y", "z"), id_col: str = "atom_id", tile: int | None = None) -> DataFrame:
    """(keys, id, root) of every point: root is the smallest id that is reached by steps of at most ``r``.

    Ids are whole numbers, each once within the keys. Points with a null or non-finite coordinate reach nothing and are their own root.

    Space is cut into buckets so narrow that all points of one are within ``r``, so each is one vertex, and edges are at most a
    constant number a bucket, however many points it holds. Tiles of buckets with a rim of their neighbours' are joined each in a task;
    only buckets on rims are joined between tasks. A tile is given all points of a bucket only up to ``FULL``; of fuller
    buckets come their outermost points in each direction, which link them to what is near in dense surroundings. The few
    pairs of buckets that are then still apart and undecided are looked at point by point, in parts that are dealt out.
    """
    if not r > 0:
        raise ValueError("the radius must be above 0")
    keys, dims = list(keys), list(dims)
    edge, reach, t = r / len(dims) ** 0.5 * (1 - MARGIN), _reach(len(dims)), tile or TILE[len(dims)]
    d = points.select(*keys, F.col(id_col).cast("long").alias("_id"), *(F.col(c).cast("double").alias(c) for c in dims))
    good = F.lit(True)
    for c in dims:
        good &= F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    cells = [f"_c{n}" for n in range(len(dims))]
    p = d.where(good).withColumns({c: F.floor(F.col(x) / edge).cast("long") for c, x in zip(cells, dims, strict=True)})
    on = [*keys, *cells]
    full = cut(p.groupBy(*on).agg(F.count("*").alias("_n"), F.min("_id").alias("_lead")).where(F.col("_n") > FULL))
    some_full = not full.isEmpty()
    given = p.withColumn("_outline", F.lit(False))
    if some_full:
        inside = p.join(full.select(*on, "_lead"), on)
        ends = [f(F.struct(x, *(c for c in dims if c != x))).alias(f"_{n}{x}") for x in dims for n, f in enumerate((F.min, F.max))]
        outer = inside.groupBy(*on, "_lead").agg(*ends)
        outer = outer.select(*on, F.col("_lead").alias("_id"), F.explode(F.array(*(F.struct(*(F.col(f"_{n}{x}")[c].alias(c) for c in dims)) for x in dims for n in (0, 1)))).alias("_p"))
        outer = outer.select(*keys, "_id", *(F.col(f"_p.{c}").alias(c) for c in dims), *cells, F.lit(True).alias("_outline"))
        given = given.join(full.select(*on), on, "left_anti").select(*outer.columns).unionByName(outer)
    tiles = [f"_t{n}" for n in range(len(dims))]
    for c, a in zip(cells, tiles, strict=True):
        given = given.withColumn(a, F.explode(F.sequence(F.floor((F.col(c) - reach) / t), F.floor((F.col(c) + reach) / t))))
    kinds = dict(d.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "kind int, u long, v long"])

    def label(g: pd.DataFrame) -> pd.DataFrame:
        cell, mine = g[cells].to_numpy(), g[tiles].to_numpy()[0]
        own = (cell // t == mine).all(1)
        inner = ((cell - reach) // t == mine).all(1) & ((cell + reach) // t == mine).all(1)
        ids, outline = g["_id"].to_numpy(), g["_outline"].to_numpy(bool)
        place, lead, root, pairs = linked_cells(g[dims].to_numpy(), cell, ids, outline, own, r)
        rim = np.zeros(len(lead), bool)
        rim[place[~inner]] = True
        rows = [(POINT, ids[own], root[place[own]]), (RIM, lead[rim], root[rim]), (OPEN, pairs[:, 0], pairs[:, 1])]
        out = pd.DataFrame({"kind": np.repeat([k for k, _, _ in rows], [len(u) for _, u, _ in rows]), "u": np.concatenate([u for _, u, _ in rows]), "v": np.concatenate([v for _, _, v in rows])})
        return out.assign(**{k: g[k].iloc[0] for k in keys})[[*keys, "kind", "u", "v"]]

    found = cut(given.groupBy(*keys, *tiles).applyInPandas(lambda g: label(g), schema))
    far = components(found.where(F.col("kind") == RIM).select(*keys, F.col("u").alias("src"), F.col("v").alias("dst")), keys, finish=FINISH)
    far = far.select(*keys, F.col("vertex").alias("v"), F.col("root").alias("_far"))
    rooted = found.where(F.col("kind") == POINT).join(far, [*keys, "v"], "left").select(*keys, F.col("u").alias("_id"), F.coalesce("_far", "v").alias("root"))
    if some_full:
        leads = rooted.withColumnRenamed("_id", "_lead").distinct()
        open_ = found.where(F.col("kind") == OPEN).select(*keys, F.col("u").alias("_a"), F.col("v").alias("_b")).distinct()
        for s in "ab":
            open_ = open_.join(leads.select(*keys, F.col("_lead").alias(f"_{s}"), F.col("root").alias(f"_root_{s}")), [*keys, f"_{s}"])
        open_ = cut(open_.where("_root_a <> _root_b"))
        inside = p.join(full.select(*on, "_lead"), on).select(*keys, "_id", "_lead")
        rooted = rooted.join(inside.select(*keys, "_id"), [*keys, "_id"], "left_anti").unionByName(inside.join(leads, [*keys, "_lead"]).select(*keys, "_id", "root"))
        if not open_.isEmpty():
            more = _searched(p, open_, keys, dims, cells, r, kinds)
            again = components(more, keys, finish=FINISH).select(*keys, F.col("vertex").alias("root"), F.col("root").alias("_far"))
            rooted = rooted.join(again, [*keys, "root"], "left").select(*keys, "_id", F.coalesce("_far", "root").alias("root"))
    alone = d.where(~good).select(*keys, "_id", F.col("_id").alias("root"))
    return rooted.unionByName(alone).select(*keys, F.col("_id").alias(id_col), "root")


def _searched(p: DataFrame, open_: DataFrame, keys: list[str], dims: list[str], cells: list[str], r: float, kinds: dict) -> DataFrame:
    """(keys, src, dst): roots of the open pairs of buckets of which some two points are within ``r``."""
    leads = p.groupBy(*keys, *cells).agg(F.min("_id").alias("_lead"), F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    named = p.join(leads, [*keys, *cells]).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    parts = leads.select(*keys, "_lead", "_parts")
    pairs = open_
    for s in "ab":
        pairs = pairs.join(parts.select(*keys, F.col("_lead").alias(f"_{s}"), F.col("_parts").alias(f"_n{s}")), [*keys, f"_{s}"])
        pairs = pairs.withColumn(f"_p{s}", F.explode(F.sequence(F.lit(0), F.col(f"_n{s}") - 1)))
    by = [*keys, "_a", "_b", "_pa", "_pb"]
    fresh = lambda df: df.toDF(*df.columns)
    side = {s: fresh(pairs.select(*by, "_root_a", "_root_b").join(named.select(*keys, F.col("_lead").alias(f"_{s}"), F.col("_part").alias(f"_p{s}"), *dims), [*keys, f"_{s}", f"_p{s}"])) for s in "ab"}

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left[dims].to_numpy(), right[dims].to_numpy()
        for at in range(0, len(a), 500):
            if len(b) and (((a[at : at + 500, None] - b[None]) ** 2).sum(2) <= r * r).any():
                one = left.iloc[:1]
                return one.assign(src=one["_root_a"], dst=one["_root_b"])[[*keys, "src", "dst"]]
        return left.iloc[:0].assign(src=pd.Series([], dtype="int64"), dst=pd.Series([], dtype="int64"))[[*keys, "src", "dst"]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "src long, dst long"])
    return side["a"].groupBy(*by).cogroup(side["b"].groupBy(*by)).applyInPandas(lambda x, y: near(x, y), schema)
