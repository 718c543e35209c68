"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.kernels import smallest_reachable
from gridjobs.functions.session import cut

#: Edges that one task holds while it thins its share.
BUFFER = 1_000_000
MAX_ROUNDS = 60


def _forest(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges (keys, u, v) -> an equivalent spanning forest, each vertex tied to the smallest one that it reaches."""
    keys, kinds = list(edges.columns[:-2]), edges.dtypes
    both = pd.concat([edges.rename(columns={"u": "x"}).drop(columns="v"), edges.rename(columns={"v": "x"}).drop(columns="u")], ignore_index=True)
    run = both.groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(both), np.int64)
    x = both["x"].to_numpy()
    order = np.lexsort((x, run))
    new = np.append(True, (run[order][1:] != run[order][:-1]) | (x[order][1:] != x[order][:-1]))
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    vertices = order[new]  # in order of their run and number
    root = smallest_reachable(len(vertices), at[: len(edges)], at[len(edges) :])
    out = both.iloc[vertices].rename(columns={"x": "u"}).assign(v=x[vertices][root])
    return out[list(edges.columns)].astype(dict(kinds))


def _thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a partition -> a spanning forest of them; at most ``BUFFER`` edges and the forest so far are held."""
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) > BUFFER:
            held = [_forest(pd.concat(held, ignore_index=True))]
            if len(held[0]) > BUFFER // 2:
                yield held.pop()
    if held:
        yield _forest(pd.concat(held, ignore_index=True))


def components(edges: DataFrame, keys: Sequence[str] = (), src: str = "src", dst: str = "dst", finish: int = 0) -> DataFrame:
    """(keys, vertex, root) for every vertex of ``edges``; root is the smallest vertex reachable within the keys.

    Edges with a null end or a null key take no part; self loops and repeated edges change nothing;
    an empty table gives an empty table. Vertices must be integers. Each task first thins its own edges to a forest;
    what is left goes through star rounds whose groupings combine before the shuffle, so a hub of any degree is
    summed in parts and its join side can be split by the adaptive skew join. One checkpoint a round cuts the lineage.
    With ``finish``, keys whose thinned edges number no more than that are each finished in one task, all keys at once, as arrays
    of some 50 bytes an edge, and the rounds are run only if a key has more.
    """
    keys = list(keys)
    e = edges.select(*keys, F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna().where("u <> v")
    thin = e.mapInPandas(_thin, e.schema)
    e = cut(thin.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if finish and (e.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]) <= finish:
        done = e.groupBy(*keys, *(() if keys else (F.lit(0).alias("_all"),))).applyInPandas(lambda g: _forest(g[[*keys, "u", "v"]]), e.schema)
        return done.withColumnsRenamed({"u": "vertex", "v": "root"})
    state = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.groupBy(*keys, F.col("u").alias("vertex")).agg(F.min("v").alias("root"))
    own = e.select(*keys, F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)
