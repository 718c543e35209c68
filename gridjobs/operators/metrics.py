"""Scores of partitions. Labelled points have x, y, label (-1: noise) and, for external scores, truth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.operators.distances import LEAF, WHOLE, cluster_distances
from gridjobs.operators.prepare import with_row

#: Clusters of one block.
CLUSTERS = 2_000


def _one(df: DataFrame, keys: Sequence[str], *aggs) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def beside(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One-row-per-key tables joined; the first one's keys stay."""
    return reduce(lambda a, b: a.join(b, list(keys), "left") if keys else a.crossJoin(b), parts)


def coverage_k(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """coverage (share of labelled points), k (clusters), n and n_labelled. Labels are counted once each before they are summed."""
    s = labelled.groupBy(*keys, "label").agg(F.count("*").alias("m"))
    real = F.col("label") >= 0
    s = _one(s, keys, F.sum("m").alias("n"), F.coalesce(F.sum(F.when(real, F.col("m"))), F.lit(0)).alias("n_labelled"), F.count_if(real).alias("k"))
    return s.select(*keys, (F.col("n_labelled") / F.col("n")).alias("coverage"), "k", "n", "n_labelled")


def _away(x: str = "x", y: str = "y", cx: str = "cx", cy: str = "cy") -> Column:
    return F.sqrt((F.col(x) - F.col(cx)) * (F.col(x) - F.col(cx)) + (F.col(y) - F.col(cy)) * (F.col(y) - F.col(cy)))


def davies_bouldin(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """dbi: mean over clusters of the worst (s_i + s_j) / d_ij; null below two clusters. Points are summed to clusters before
    clusters meet."""
    keys = list(keys)
    p = labelled.where("label >= 0").select(*keys, "label", "x", "y")
    centre = p.groupBy(*keys, "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = p.join(centre, [*keys, "label"])
    return _dbi(d.groupBy(*keys, "label").agg(F.avg(_away()).alias("s"), F.first("cx").alias("cx"), F.first("cy").alias("cy")), keys)


def _dbi(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """dbi of clusters (keys, label, s, cx, cy).

    Runs of up to ``CLUSTERS`` clusters are compared as arrays, each in one task. Beyond that clusters are dealt into blocks of as many
    that lie together (slabs along x, cut along y, by rank, so that dense places make more blocks). Each block is compared with itself
    first; then a pair of blocks is compared only if the largest (s_i + s_j) over the least distance of their boxes is more than what
    some cluster of the one has found already. What is compared with what is decided on a row for each block.
    """
    keys = list(keys)
    c = cut(c.select(*keys, "label", "s", "cx", "cy"))
    most = c.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    listed = F.collect_list(F.struct("label", "s", "cx", "cy")).alias("mine")
    if most <= CLUSTERS:
        best = _worst(c.groupBy(*keys).agg(listed).withColumn("others", F.col("mine")), keys)
        best = best.groupBy(*keys, "label").agg(F.max("worst").alias("worst"), F.max("s").alias("s"), F.max("far").alias("far"))
        flat = (F.max("s") < 1e-8) | (F.max("far") < 1e-8)
        return best.where("worst >= 0").groupBy(*keys).agg(F.when(flat, F.lit(0.0)).otherwise(F.avg("worst")).alias("dbi"))
    at = [*keys, "_slab", "_block"]
    blocks = _blocks(c, keys).groupBy(*at).agg(listed, F.max("s").alias("s"), *(f(v).alias(f"{n}_{v}") for v in ("cx", "cy") for n, f in (("lo", F.min), ("hi", F.max))))
    blocks = cut(blocks)
    near = cut(_worst(blocks.select(*at, "mine", F.col("mine").alias("others")), at))
    pairs = close_blocks(blocks.drop("mine"), near.groupBy(*at).agg(F.min("worst").alias("found")), keys)
    mine, others = blocks.select(*at, "mine"), blocks.select(*keys, F.col("_slab").alias("_slab_b"), F.col("_block").alias("_block_b"), F.col("mine").alias("others"))
    more = _worst(pairs.join(mine, at).join(others, [*keys, "_slab_b", "_block_b"]).select(*at, "mine", "others"), at)
    best = near.unionByName(more).groupBy(*keys, "label").agg(F.max("worst").alias("worst"), F.max("s").alias("s"))
    extent = c.groupBy(*keys).agg(F.greatest(*(F.max(v) - F.min(v) for v in ("cx", "cy"))).alias("_wide"))
    d = beside([best.where("worst >= 0").groupBy(*keys).agg(F.avg("worst").alias("dbi"), F.max("s").alias("s")), extent], keys)
    return d.select(*keys, F.when((F.col("s") < 1e-8) | (F.col("_wide") < 1e-8), 0.0).otherwise(F.col("dbi")).alias("dbi"))


def _blocks(c: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters with the slab and the block of at most ``CLUSTERS`` in which they lie."""
    from gridjobs.operators.labelling import ranked

    n = c.groupBy(*keys).agg(F.count("*").alias("_k"))
    d = with_row(ranked(c, keys, [F.col("cx"), F.col("label")], "_at"), n, keys)
    slabs = F.ceil(F.sqrt(F.ceil(F.col("_k") / CLUSTERS)))
    d = d.withColumn("_slab", F.floor(F.col("_at") * slabs / F.col("_k")).cast("int")).drop("_at", "_k")
    return ranked(d, [*keys, "_slab"], [F.col("cy"), F.col("label")], "_at").withColumn("_block", F.floor(F.col("_at") / CLUSTERS).cast("int")).drop("_at")


def close_blocks(blocks: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different blocks (the second with _slab_b and _block_b) that may hold a worse partner than ``found`` for the first."""
    a = blocks.join(found, [*keys, "_slab", "_block"])
    b = blocks.select(*keys, *(F.col(v).alias(f"{v}_b") for v in ("_slab", "_block", "s", "lo_cx", "hi_cx", "lo_cy", "hi_cy")))
    d = a.join(b, keys) if keys else a.crossJoin(b)
    gap = {v: F.greatest(F.lit(0.0), F.col(f"lo_{v}") - F.col(f"hi_{v}_b"), F.col(f"lo_{v}_b") - F.col(f"hi_{v}")) for v in ("cx", "cy")}
    least = F.sqrt(gap["cx"] * gap["cx"] + gap["cy"] * gap["cy"])
    other = (F.col("_slab") != F.col("_slab_b")) | (F.col("_block") != F.col("_block_b"))
    # found * distance may round below the sum that it came from
    can = (F.col("s") + F.col("s_b")) * (1 + 1e-9) >= F.col("found") * least
    return d.where(other & can).select(*keys, "_slab", "_block", "_slab_b", "_block_b")


def _worst(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, worst, s, far): for each cluster of the list ``mine`` its largest (s_i + s_j) / d_ij and distance to one of ``others``."""
    kinds = ", ".join([*(f"`{k}` {t}" for k, t in pairs.select(*keys).dtypes), "label long, worst double, s double, far double"])

    def worst(parts):
        for part in parts:
            for r in part.to_dict("records"):
                a, b = (pd.DataFrame(list(r[v])) for v in ("mine", "others"))
                for at in range(0, len(a), 500):
                    x = a.iloc[at : at + 500]
                    dx, dy = (x[v].to_numpy(float)[:, None] - b[v].to_numpy(float)[None] for v in ("cx", "cy"))
                    far = np.sqrt(dx * dx + dy * dy)
                    both = x["s"].to_numpy(float)[:, None] + b["s"].to_numpy(float)[None]
                    ratio = np.divide(both, far, out=np.zeros_like(far), where=far > 0)
                    ratio[x["label"].to_numpy()[:, None] == b["label"].to_numpy()[None]] = -1.0
                    out = pd.DataFrame({"label": x["label"].to_numpy(), "worst": ratio.max(1), "s": x["s"].to_numpy(float), "far": far.max(1)})
                    for k in reversed(keys):
                        out.insert(0, k, r[k])
                    yield out

    return pairs.mapInPandas(worst, kinds)


def scores_by_cells(points: DataFrame, labels: DataFrame, grid: Sequence[str], runs: Sequence[str], every: DataFrame | None = None) -> DataFrame:
    """sil (0), dbi, cov, k and valid of runs that label cells, as ``partition_scores`` gives them for the labelled points.

    ``points``: (grid, i, j, x, y), each point once for each grid; ``labels``: (runs, i, j, label) with the grid's keys among those
    of the run; ``every``: the runs, if some may have no labelled cell. Counts, clusters and centres follow from sums over cells. Only distances to the centres need the points: these
    are joined once with what all runs say of their cell, and summed before anything is shuffled.
    """
    grid, runs = list(grid), list(runs)
    more = [k for k in runs if k not in grid]
    cells = cut(points.groupBy(*grid, "i", "j").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")))
    whole = cells.groupBy(*grid).agg(F.sum("n").alias("_all"))
    known = cut(labels.where("label >= 0").select(*runs, "i", "j", "label").join(cells, [*grid, "i", "j"]))
    centre = known.groupBy(*runs, "label").agg(F.sum("n").alias("m"), (F.sum("sx") / F.sum("n")).alias("cx"), (F.sum("sy") / F.sum("n")).alias("cy"))
    said = known.select(*runs, "i", "j", "label").join(centre, [*runs, "label"])
    said = said.groupBy(*grid, "i", "j").agg(F.collect_list(F.struct(*more, "label", "cx", "cy")).alias("said"))
    d = points.select(*grid, "i", "j", "x", "y").join(said, [*grid, "i", "j"]).select(*grid, "x", "y", F.explode("said").alias("z"))
    d = d.select(*grid, "x", "y", *(F.col(f"z.{c}").alias(c) for c in (*more, "label", "cx", "cy")))
    c = cut(d.groupBy(*runs, "label").agg(F.avg(_away()).alias("s"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.count("*").alias("m")))
    m = c.groupBy(*runs).agg(F.sum("m").alias("n_labelled"), F.count("*").alias("k")).join(_dbi(c, runs), runs, "left")
    every = labels.select(*runs).distinct() if every is None else every
    m = (every.join(whole, grid) if grid else every.crossJoin(whole)).join(m, runs, "left").fillna(0, ["n_labelled", "k"])
    inf, ok = F.lit(float("inf")), (F.col("n_labelled") >= 2) & (F.col("k") >= 2)
    cov = F.col("n_labelled") / F.col("_all")
    return m.select(*runs, F.lit(0.0).alias("sil"), F.when(ok, F.coalesce("dbi", inf)).otherwise(inf).alias("dbi"), cov.alias("cov"), F.when(ok, F.col("k")).otherwise(0).alias("k"), ok.alias("valid"))


def silhouette(labelled: DataFrame, keys: Sequence[str] = (), sample_size: int | None = None, squared: bool = False, seed: int = 0, leaf: int = LEAF, whole: int = WHOLE) -> DataFrame:
    """silhouette of each run: mean over labelled points; null where there are fewer than two clusters or as many as points.

    All labelled points with finite coordinates are scored and compared, unless a ``sample_size`` is asked for: then about that many of a
    run, by hash of their id and ``seed``. Sums of distances come from a quadtree (``cluster_distances``), pairs of points only from near
    leaves. With ``squared`` distances points are compared with clusters only, not with each other.
    """
    keys = list(keys)
    p = labelled.where("label >= 0").select(*keys, "point_id", "x", "y", F.col("label").cast("int").alias("label"))
    p = p.where(F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)))
    n = p.groupBy(*keys).agg(F.count("*").alias("_n"))
    p = with_row(p, n, keys)
    if sample_size is not None:
        p = p.where((F.col("_n") <= sample_size) | (F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * sample_size / F.col("_n")))
    if squared:
        return _squared_silhouette(p, keys)
    k = p.groupBy(*keys).agg(F.count_distinct("label").alias("k"))
    return _mean_width(cluster_distances(p, keys, leaf, whole), k, keys)


def _mean_width(one: DataFrame, k: DataFrame, keys: list[str]) -> DataFrame:
    """silhouette of each run from a, b and the size of the own cluster of points that count ``w`` times, and the number of clusters."""
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    out = beside([one.groupBy(*keys).agg((F.sum(s * F.col("w")) / F.sum("w")).alias("s"), F.sum("w").alias("points")), k], keys)
    return out.select(*keys, F.when((F.col("k") >= 2) & (F.col("k") < F.col("points")), F.col("s")).alias("silhouette"))


def _squared_silhouette(p: DataFrame, keys: list[str]) -> DataFrame:
    """Silhouette under squared distances: a cluster of m points with centre c and sum of squares q around it has the sum
    m |x - c|^2 + q to a point x. Shares of 2,000 points meet blocks of ``CLUSTERS`` clusters, one block in most runs."""
    centre = p.groupBy(*keys, "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = p.join(centre, [*keys, "label"])
    c = cut(d.groupBy(*keys, "label").agg(F.sum(_away() * _away()).alias("q"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.count("*").alias("m")))
    k = c.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("m").alias("_all"))
    blocks = with_row(c, k, keys).groupBy(*keys, F.pmod(F.xxhash64("label"), F.ceil(F.col("k") / CLUSTERS)).alias("block")).agg(F.collect_list(F.struct("label", "cx", "cy", "q", "m")).alias("clusters"))
    mine = with_row(p, k.select(*keys, "_all"), keys).groupBy(*keys, F.pmod(F.xxhash64("point_id", F.lit(2)), F.ceil(F.col("_all") / 2_000)).alias("share"))
    mine = mine.agg(F.collect_list(F.struct("point_id", "x", "y", "label")).alias("own"))
    pairs = mine.join(blocks, keys) if keys else mine.crossJoin(blocks)
    kinds = ", ".join([*(f"`{k}` {t}" for k, t in p.select(*keys).dtypes), "point_id long, a double, b double, size long"])

    def nearest(parts):
        for part in parts:
            for r in part.to_dict("records"):
                c = pd.DataFrame(list(r["clusters"]))
                every = pd.DataFrame(list(r["own"]))
                for at in range(0, len(every), 500):
                    x = every.iloc[at : at + 500]
                    d2 = sum((x[v].to_numpy(float)[:, None] - c[f"c{v}"].to_numpy(float)[None]) ** 2 for v in "xy")
                    q, m = c["q"].to_numpy(float)[None], c["m"].to_numpy()[None]
                    own = x["label"].to_numpy()[:, None] == c["label"].to_numpy()[None]
                    a = np.where(own, (m * d2 + q) / np.maximum(m - 1, 1), -1.0).max(1)
                    out = pd.DataFrame({"point_id": x["point_id"].to_numpy(), "a": a, "b": np.where(own, np.inf, d2 + q / m).min(1), "size": np.where(own, m, 0).max(1)})
                    for k in reversed(keys):
                        out.insert(0, k, r[k])
                    yield out

    one = pairs.mapInPandas(nearest, kinds).groupBy(*keys, "point_id").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("size").alias("size"), F.lit(1).alias("w"))
    return _mean_width(one, k.select(*keys, "k"), keys)


def partition_scores(labelled: DataFrame, keys: Sequence[str] = (), with_silhouette: bool = False) -> DataFrame:
    """sil, dbi, cov, k and valid of each run; with fewer than two labelled points or clusters sil is 0, dbi infinite and k 0."""
    keys = list(keys)
    m = coverage_k(labelled, keys)
    for part in [davies_bouldin(labelled, keys), *([silhouette(labelled, keys)] if with_silhouette else [])]:
        m = m.join(part, keys, "left") if keys else m.join(part, F.lit(True), "left")
    inf, ok = F.lit(float("inf")), (F.col("n_labelled") >= 2) & (F.col("k") >= 2)
    sil = F.coalesce("silhouette", F.lit(0.0)) if with_silhouette else F.lit(0.0)
    return m.select(*keys, F.when(ok, sil).otherwise(0.0).alias("sil"), F.when(ok, F.coalesce("dbi", inf)).otherwise(inf).alias("dbi"), F.col("coverage").alias("cov"), F.when(ok, F.col("k")).otherwise(0).alias("k"), ok.alias("valid"))


def weighted(scores: DataFrame, w_sil: Column | float = 0.0, w_dbi: Column | float = 0.8, w_cov: Column | float = 0.15) -> DataFrame:
    """score = w_sil * sil + w_dbi / (1 + dbi) + w_cov * cov, minus infinity where a run isn't valid."""
    w = [F.lit(x) if isinstance(x, (int, float)) else x for x in (w_sil, w_dbi, w_cov)]
    total = w[0] * F.col("sil") + w[1] / (1 + F.col("dbi")) + w[2] * F.col("cov")
    return scores.withColumn("score", F.when(F.col("valid"), total).otherwise(F.lit(float("-inf")))).drop("valid")


def score_partition(labelled: DataFrame, keys: Sequence[str] = (), w_sil: float = 0.0, w_dbi: float = 0.8, w_cov: float = 0.15) -> DataFrame:
    """sil, dbi, cov, k and score of each run; the silhouette is computed only where its weight isn't 0."""
    return weighted(partition_scores(labelled, keys, bool(w_sil)), w_sil, w_dbi, w_cov)


def contingency(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, truth, label, n): points by true class and cluster; noise is the class -1."""
    return labelled.groupBy(*keys, "truth", "label").agg(F.count("*").alias("n"))


def external_scores(cont: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ari, nmi, v_measure and fm of each run, from its contingency table. Pair counts are doubles."""
    keys = list(keys)
    n = F.col("n").cast("double")
    rows = cont.groupBy(*keys, "truth").agg(F.sum(n).alias("t"))
    cols = cont.groupBy(*keys, "label").agg(F.sum(n).alias("p"))
    h = lambda c: -F.sum(F.col(c) * F.log(c))
    sums = [
        _one(cont, keys, F.sum(n).alias("m"), F.sum(n * n).alias("sq"), F.sum(n * F.log(n)).alias("nln")),
        _one(rows, keys, F.sum(F.col("t") * F.col("t")).alias("tsq"), h("t").alias("th"), F.count("*").alias("tk")),
        _one(cols, keys, F.sum(F.col("p") * F.col("p")).alias("psq"), h("p").alias("ph"), F.count("*").alias("pk")),
    ]
    s = beside(sums, keys)
    c = F.col
    tp, fp, fn = c("sq") - c("m"), c("psq") - c("sq"), c("tsq") - c("sq")
    tn = c("m") * c("m") - fp - fn - c("sq")
    ari = F.when((fp == 0) & (fn == 0), 1.0).otherwise(F.try_divide(2.0 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    ht, hp = F.log("m") + c("th") / c("m"), F.log("m") + c("ph") / c("m")
    mi = F.greatest(F.log("m") + c("nln") / c("m") + c("th") / c("m") + c("ph") / c("m"), F.lit(0.0))
    alone = (c("tk") == 1) & (c("pk") == 1)
    nmi = F.when(alone, 1.0).when((c("tk") == 1) | (c("pk") == 1), 0.0).otherwise(mi / ((ht + hp) / 2))
    fm = F.when(tp == 0, 0.0).otherwise(tp / F.sqrt((tp + fp) * (tp + fn)))
    return s.select(*keys, ari.alias("ari"), nmi.alias("nmi"), nmi.alias("v_measure"), fm.alias("fm"))


def purity(cont: DataFrame, keys: Sequence[str] = (), nan_if_all_noise: bool = False) -> DataFrame:
    """Sum over clusters of the largest class in each, over all points, noise among them."""
    best = cont.groupBy(*keys, "label").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    real = F.col("label") >= 0
    none = F.lit(float("nan")) if nan_if_all_noise else F.lit(0.0)
    return _one(best, keys, F.coalesce(F.sum(F.when(real, F.col("top"))) / F.sum("all"), none).alias("purity"))


def cluster_report(labelled: DataFrame, keys: Sequence[str] = ("phase",), with_silhouette: bool = True) -> DataFrame:
    """All scores of each run; NaN where one is undefined. ``truth`` may be absent."""
    keys = list(keys)
    nan = F.lit(float("nan"))
    parts = [coverage_k(labelled, keys).drop("n", "n_labelled"), davies_bouldin(labelled, keys)]
    names = ["dbi"]
    if with_silhouette:
        parts.append(silhouette(labelled, keys))
        names.append("silhouette")
    if "truth" in labelled.columns:
        cont = contingency(labelled, keys)
        parts += [external_scores(cont, keys), purity(cont, keys)]
        names += ["ari", "nmi", "v_measure", "fm", "purity"]
    return beside(parts, keys).withColumns({c: F.coalesce(c, nan) for c in names})
