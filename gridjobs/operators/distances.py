"""Sums of distances from points to clusters without all pairs: a quadtree, power series for cells far apart, pairs for near ones."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.kernels import TERMS, grouped_sums, packed_series, series_far, series_of, series_read, series_shift, series_sum
from gridjobs.functions.session import cut
from gridjobs.operators.prepare import with_row

#: Distinct points of a leaf and of runs that need no tree, levels below those of an even spread, all levels, and leaves whose points
#: one task meets.
LEAF, WHOLE, SPARE, DEEPEST, MET = 1_000, 16_000, 6, 20, 64


def _kinds(df: DataFrame, cols: Sequence[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), more])


def _tree(p: DataFrame, keys: list[str], leaf: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """(cells of the tree: keys, lv, i, j, n, leaf; points with the leaf that holds them, its centre cx, cy and side). A cell of more
    than ``leaf`` points has its occupied quarters for children; without a run of more than ``whole`` points all are one leaf."""
    box = p.groupBy(*keys).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_edge"), F.count("*").alias("_n"))
    box = cut(box.withColumn("_edge", F.when(F.col("_edge") > 0, F.col("_edge")).otherwise(1.0)))
    most = box.agg(F.max("_n")).first()[0] or 1
    deep = 0 if most <= max(leaf, whole) else min(DEEPEST, math.ceil(math.log(most / leaf, 4)) + SPARE)
    at = {c: F.least(F.floor((F.col(a) - F.col(f"_{a}")) / F.col("_edge") * 2**deep), F.lit(2**deep - 1)).cast("int") for c, a in (("_i", "x"), ("_j", "y"))}
    p = with_row(p, box.drop("_n"), keys).withColumns(at)
    fine = p.groupBy(*keys, "_i", "_j").agg(F.count("*").alias("n")).withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(deep))))
    fine = cut(fine.withColumns({c: F.expr(f"shiftright(_{c}, {deep} - lv)") for c in "ij"}))
    cells = fine.groupBy(*keys, "lv", "i", "j").agg(F.sum("n").alias("n"))
    parent = {"lv": F.col("lv") - 1, "i": F.shiftright("i", 1), "j": F.shiftright("j", 1)}
    full = cells.where((F.col("n") > leaf) & (F.col("lv") < deep)).select(*keys, *(F.col(c).alias(f"_{c}") for c in parent))
    own = cells.select("*", *(e.alias(f"_{c}") for c, e in parent.items()))
    nodes = own.join(full, [*keys, "_lv", "_i", "_j"], "left_semi").unionByName(own.where("lv = 0")).select(*keys, "lv", "i", "j", "n", ((F.col("n") <= leaf) | (F.col("lv") == deep)).alias("leaf"))
    nodes = cut(nodes)
    home = fine.drop("n").join(nodes.where("leaf").select(*keys, "lv", "i", "j", F.ceil(F.col("n") / leaf).alias("_parts")), [*keys, "lv", "i", "j"])
    d = p.join(home, [*keys, "_i", "_j"]).withColumn("side", F.col("_edge") / F.pow(F.lit(2.0), "lv"))
    centre = {c: F.col(f"_{a}") + (F.col(k) + 0.5) * F.col("side") for c, a, k in (("cx", "x", "i"), ("cy", "y", "j"))}
    return nodes, d.withColumns(centre).withColumn("part", F.pmod(F.xxhash64("x", "y", "label"), F.col("_parts")).cast("int"))


def _met(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(far, near) pairs of cells t and s that cover all pairs of points once: far if their circles are a circle apart, near if they
    are not and both are leaves. Others are opened, level by level."""
    half = lambda s: F.pow(F.lit(2.0), -F.col(f"{s}_lv"))
    mid = lambda s, c: (F.col(f"{s}_{c}") + 0.5) * half(s)
    wide = half("t") + half("s")
    gap = sum((mid("t", c) - mid("s", c)) * (mid("t", c) - mid("s", c)) for c in "ij")
    kids = nodes.select(*keys, (F.col("lv") - 1).alias("_lv"), F.shiftright("i", 1).alias("_i"), F.shiftright("j", 1).alias("_j"), "lv", "i", "j", "leaf")
    one = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("lv", "i", "j", "leaf")]
    cols = [*keys, *(f"{s}_{c}" for s in "ts" for c in ("lv", "i", "j", "leaf"))]
    pairs = nodes.where("lv = 0").select(*keys, *one("t"), *one("s"))
    far, near = [], []
    while True:
        pairs = cut(pairs.select(*cols, (gap >= 2 * wide * wide).alias("_far")))
        far.append(pairs.where("_far").drop("_far"))
        near.append(pairs.where("not _far and t_leaf and s_leaf").drop("_far"))
        pairs = pairs.where("not _far and not (t_leaf and s_leaf)").select(*cols)
        if pairs.isEmpty():
            break
        for s in "ts":  # leaves have no cells below and stay
            below = kids.select(*keys, *(F.col(f"_{c}").alias(f"{s}_{c}") for c in ("lv", "i", "j")), *(F.col(c).alias(f"_k{c}") for c in ("lv", "i", "j", "leaf")))
            opened = pairs.join(below, [*keys, f"{s}_lv", f"{s}_i", f"{s}_j"], "left")
            pairs = opened.withColumns({f"{s}_{c}": F.coalesce(f"_k{c}", f"{s}_{c}") for c in ("lv", "i", "j", "leaf")}).select(*cols)
    for n in range(1, len(far)):
        far[0], near[0] = far[0].unionByName(far[n]), near[0].unionByName(near[n])
    return far[0], near[0]


def _up(leaves: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    """Series of all cells from those of the leaves, from children to parents."""
    kinds = _kinds(leaves, [*keys, "lv", "i", "j", "label", "n"], "data binary")

    def add(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, d in g.groupby("label"):
            total = sum(series_shift(m, i % 2, j % 2, True) for m, i, j in zip(d["data"], d["i"], d["j"], strict=True))
            out.append({**{k: d[k].iloc[0] for k in keys}, "lv": d["lv"].iloc[0] - 1, "i": d["i"].iloc[0] // 2, "j": d["j"].iloc[0] // 2, "label": label, "n": d["n"].sum(), "data": packed_series(total)})
        return pd.DataFrame(out)

    every, level = [], None
    for lv in range(deepest, 0, -1):
        own = leaves.where(F.col("lv") == lv)
        level = cut(own if level is None else own.unionByName(level))
        every.append(level)
        if lv > 1:
            level = level.groupBy(*keys, F.shiftright("i", 1).alias("_i"), F.shiftright("j", 1).alias("_j")).applyInPandas(lambda g: add(g), kinds)
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def _down(far: DataFrame, series: DataFrame, nodes: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    """Series around the leaves for what lies far from them, a row for each label: what cells far away say, and what parents pass on.
    Lengths are in sides of the run's square."""
    at = [*keys, "lv", "i", "j"]
    kinds = _kinds(series, [*at, "label", "n"], "data binary")
    s = series.select(*keys, *(F.col(c).alias(f"s_{c}") for c in ("lv", "i", "j")), "label", "n", "data")
    told = far.select(*keys, *(F.col(f"t_{c}").alias(c) for c in ("lv", "i", "j")), "s_lv", "s_i", "s_j").join(s, [*keys, "s_lv", "s_i", "s_j"])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        lv, i, j = (int(g[c].iloc[0]) for c in ("lv", "i", "j"))
        labels, place = np.unique(g["label"].to_numpy(), return_inverse=True)
        total, n = np.zeros((len(labels), TERMS, TERMS), complex), np.zeros(len(labels), np.int64)
        np.add.at(n, place, g["n"].to_numpy())
        for c in range(0, len(g), 256):
            e = g.iloc[c : c + 256]
            np.add.at(total, place[c : c + 256], series_far(e["data"], *(e[f"s_{c}"].to_numpy() for c in ("lv", "i", "j")), lv, i, j))
        out = pd.DataFrame({"lv": lv, "i": i, "j": j, "label": labels, "n": n, "data": [packed_series(m) for m in total]})
        for k in reversed(keys):
            out.insert(0, k, g[k].iloc[0])
        return out

    own = cut(told.groupBy(*at).applyInPandas(lambda g: gather(g), kinds))

    def add(g: pd.DataFrame) -> pd.DataFrame:
        lv, i, j = (g[c].iloc[0] for c in ("lv", "i", "j"))
        out = []
        for label, d in g.groupby("label"):
            total = sum(series_shift(m, i % 2, j % 2, False) if up else series_sum(m) for m, up in zip(d["data"], d["up"], strict=True))
            out.append({**{k: g[k].iloc[0] for k in keys}, "lv": lv, "i": i, "j": j, "label": label, "n": d["n"].sum(), "data": packed_series(total)})
        return pd.DataFrame(out)

    kids = nodes.select(*keys, "lv", "i", "j", F.shiftright("i", 1).alias("_i"), F.shiftright("j", 1).alias("_j"))
    leaf = nodes.where("leaf").select(*at)
    level, every = None, []
    for lv in range(0, deepest + 1):
        here = own.where(F.col("lv") == lv)
        if level is not None:
            passed = level.select(*keys, F.col("i").alias("_i"), F.col("j").alias("_j"), "label", "n", "data").join(kids.where(F.col("lv") == lv), [*keys, "_i", "_j"])
            both = here.select(*at, "label", "n", "data", F.lit(False).alias("up")).unionByName(passed.select(*at, "label", "n", "data", F.lit(True).alias("up")))
            here = both.groupBy(*at).applyInPandas(lambda g: add(g), kinds)
        level = cut(here)
        every.append(level.join(leaf.where(F.col("lv") == lv), at, "left_semi"))
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def cluster_distances(points: DataFrame, keys: Sequence[str] = (), leaf: int = LEAF, whole: int = WHOLE) -> DataFrame:
    """(keys, a, b, size, w) of distinct points (x, y, label): mean distance to the others of the own cluster (null if there are none),
    least mean distance to another cluster (null if there is none), size of the own cluster and how many points are equal to it.

    Sums of distances between cells that are far apart come from power series of 17 terms in each of the point's two conjugate
    coordinates, which shrink by a half at least with each term: of a pair's distance at most about 5e-8 is lost, of sums far less. Pairs of points are taken only
    between near leaves, so time grows as n log n. No task holds more than a leaf, ``MET`` near ones and a series for each cluster.
    """
    keys = list(keys)
    at = [*keys, "lv", "i", "j"]
    p = points.groupBy(*keys, "label", "x", "y").agg(F.count("*").alias("w"))
    nodes, placed = _tree(cut(p), keys, leaf, whole)
    deepest = nodes.agg(F.max("lv")).first()[0] or 0
    lists = [F.collect_list(c).alias(c) for c in ("label", "x", "y", "w")]
    packed = cut(placed.groupBy(*at, "part", "side", "cx", "cy").agg(*lists))
    far, near = _met(nodes, keys)
    kinds = _kinds(packed, at, "label long, n long, data binary")

    def begin(parts):
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                z = (r["x"] - r["cx"] + 1j * (r["y"] - r["cy"])) / r["side"]
                for label in np.unique(r["label"]):
                    own = r["label"] == label
                    out.append([*(r[c] for c in at), label, r["w"][own].sum(), packed_series(series_of(z[own], r["w"][own]))])
            yield pd.DataFrame(out, columns=[*at, "label", "n", "data"])

    series = _up(cut(packed.mapInPandas(begin, kinds)), keys, deepest) if deepest else None
    edge = packed.groupBy(*keys).agg(F.max(F.col("side") * F.pow(F.lit(2.0), "lv")).alias("edge"))
    t = [*keys, *(F.col(f"t_{c}").alias(c) for c in ("lv", "i", "j"))]
    near = near.select(*t, F.col("s_lv"), F.col("s_i"), F.col("s_j")).withColumn("_h", F.xxhash64("s_lv", "s_i", "s_j"))
    many = near.groupBy(*at).agg(F.ceil(F.count("*") / MET).alias("_m"))
    near = near.join(many, at).withColumn("chunk", F.pmod("_h", "_m").cast("int"))
    other = packed.select(*keys, *(F.col(c).alias(f"s_{c}") for c in ("lv", "i", "j")), "label", "x", "y", "w")
    other = near.select(*at, "chunk", "s_lv", "s_i", "s_j").join(other, [*keys, "s_lv", "s_i", "s_j"]).select(*at, "chunk", "label", "x", "y", "w")
    own = packed.select(*at, "part", "x", "y")
    # each part of a leaf meets each chunk of its near leaves
    ends = own.select(*at, "part").join(many, at)
    other = other.join(ends.drop("_m"), at)
    mine = own.join(many, at).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_m").cast("int") - 1))).drop("_m")

    renamed = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  two sides that come of one table

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        r = a.iloc[0]
        labels, n, sums = grouped_sums(r["x"], r["y"], *(np.concatenate(b[c].to_list()) for c in ("x", "y", "label", "w")))
        out = pd.DataFrame({"label": labels, "n": n, "data": [s.tobytes() for s in sums], "series": False})
        return out.assign(**{c: r[c] for c in (*at, "part")})[[*at, "part", "label", "n", "data", "series"]]

    on = [*at, "part"]
    told = renamed(mine).groupBy(*on, "chunk").cogroup(renamed(other).groupBy(*on, "chunk")).applyInPandas(lambda a, b: meet(a, b), _kinds(packed, on, "label long, n long, data binary, series boolean"))
    if series is not None:
        told = told.unionByName(_down(far, series, nodes, keys, deepest).join(packed.select(*on), at).withColumn("series", F.lit(True)).select(*told.columns))
    mine = with_row(packed, edge, keys)

    def means(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        r = a.iloc[0]
        labels, place = np.unique(b["label"].to_numpy(), return_inverse=True)
        size, total = np.zeros(len(labels), np.int64), np.zeros((len(labels), len(r["x"])))
        np.add.at(size, place, b["n"].to_numpy())
        z = (r["x"] - r["cx"] + 1j * (r["y"] - r["cy"])) / r["side"]
        for k, data, is_series in zip(place, b["data"], b["series"], strict=True):
            total[k] += series_read(data, z) * r["edge"] if is_series else np.frombuffer(data)
        k = np.searchsorted(labels, r["label"])
        col = np.arange(len(k))
        with np.errstate(divide="ignore", invalid="ignore"):
            a_ = total[k, col] / (size[k] - 1)
        mean = total / size[:, None]
        mean[k, col] = np.inf
        b_ = mean.min(0)
        out = pd.DataFrame({"a": np.where(size[k] > 1, a_, 0.0), "b": b_, "size": size[k], "w": r["w"]})
        for c in reversed(keys):
            out.insert(0, c, r[c])
        return out

    got = renamed(mine).groupBy(*on).cogroup(renamed(told).groupBy(*on)).applyInPandas(lambda a, b: means(a, b), _kinds(packed, keys, "a double, b double, size long, w long") if keys else "a double, b double, size long, w long")
    return got.withColumns({"a": F.when(F.col("size") > 1, F.col("a")), "b": F.when(F.col("b") < float("inf"), F.col("b"))})
