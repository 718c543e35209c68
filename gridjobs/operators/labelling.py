"""Connected components of cells and atoms, and what clusters consist of."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridjobs.functions.kernels import grow, label_2d
from gridjobs.functions.session import cut
from gridjobs.operators.cliques import clique_components
from gridjobs.operators.components import components

#: Edge of a tile that one task labels, and thinned edges of a run that one task finishes.
TILE, FINISH = 512, 2_000_000
#: Rows that are ranked by one window; members of a cluster in one list.
RANKED, CHUNK = 1_000_000, 10_000
#: Cell numbers below this fit the packed vertex id of a 3D cell.
AXIS = 1 << 20


def _schema(df: DataFrame, cols: Sequence[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), more])


def _roots(cells: DataFrame, keys: list[str], connectivity: int, wrap: bool, tile: int, widest: int | None = None) -> DataFrame:
    """(keys, i, j, nx, ny, root) with root the smallest i * ny + j of each cell's component.

    Whether tiles are needed is known from ``widest``, the widest axis of all grids, or else asked of the cells.
    """
    d = cells.select(*keys, "i", "j", "nx", "ny")
    top = widest or d.agg(F.max(F.greatest("nx", "ny"))).first()[0]
    one = top is None or top <= tile

    def label(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["i", "j"])
        i, j, nx, ny = (g[c].to_numpy() for c in ("i", "j", "nx", "ny"))
        return g.assign(root=label_2d(i, j, int(nx[0]), int(ny[0]), connectivity, wrap and one))[[*keys, "i", "j", "nx", "ny", "root"]]

    kinds = _schema(d, [*keys, "i", "j", "nx", "ny"], "root long")
    if one:
        return d.groupBy(*keys, *(() if keys else (F.lit(0).alias("_all"),))).applyInPandas(lambda g: label(g), kinds)
    tiles = d.withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)})
    local = tiles.groupBy(*keys, "ti", "tj").applyInPandas(lambda g: label(g.drop(columns=["ti", "tj"])), kinds)
    rim = local.where((F.col("i") % tile).isin(0, tile - 1) | (F.col("j") % tile).isin(0, tile - 1) | (F.col("i") == F.col("nx") - 1) | (F.col("j") == F.col("ny") - 1))
    steps = ((0, 1), (1, 0)) if connectivity == 4 else ((0, 1), (1, -1), (1, 0), (1, 1))
    moved = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    out = rim.withColumn("s", moved).withColumns({"i": F.col("i") + F.col("s.a"), "j": F.col("j") + F.col("s.b")})
    if wrap:
        out = out.withColumns({"i": F.pmod("i", "nx"), "j": F.pmod("j", "ny")})
    pairs = out.select(*keys, "i", "j", F.col("root").alias("src")).join(rim.select(*keys, "i", "j", F.col("root").alias("dst")), [*keys, "i", "j"])
    far = components(pairs.where("src <> dst").distinct(), keys, finish=FINISH).select(*keys, F.col("root").alias("far"), F.col("vertex").alias("root"))
    return local.join(far, [*keys, "root"], "left").select(*keys, "i", "j", "nx", "ny", F.coalesce("far", "root").alias("root"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Rows with their place (from 0) within the keys, in an order that must leave no ties. ``df`` is evaluated once.

    Many rows are dealt by ranges of keys and order: each range is numbered by itself and begins where the ones before it, of
    which only the counts are summed, end. So no task has more than a range, whatever the keys.
    """
    keys, order = list(keys), list(order)
    d = cut(df)
    if d.count() <= RANKED:
        return d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    d = cut(d.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_range", F.spark_partition_id()))
    begin = d.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begin = begin.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return d.withColumn(name, own).join(begin, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def _numbered(rooted: DataFrame, keys: list[str], name: str, first: int) -> DataFrame:
    """Roots numbered in order; only one row per component is ranked."""
    ids = ranked(rooted.select(*keys, "root").distinct(), keys, ["root"], name)
    return rooted.join(ids.withColumn(name, (F.col(name) + first).cast("int")), [*keys, "root"])


def cell_components(cells: DataFrame, keys: Sequence[str] = (), connectivity: int = 4, periodic: bool = False, tile: int = TILE, widest: int | None = None) -> DataFrame:
    """(keys, i, j, label): components of the given 2D cells (with nx and ny), numbered from 0 in raster order of first cells.

    A grid up to ``tile`` cells wide is labelled by one task; wider ones tile by tile, and only cells on the rims are joined.
    """
    keys = list(keys)
    return _numbered(_roots(cells, keys, connectivity, periodic, tile, widest), keys, "label", 0).select(*keys, "i", "j", "label")


def seeded_components(cells: DataFrame, keys: Sequence[str] = (), connectivity: int = 4, periodic: bool = False, max_passes: int | None = None, tile: int = TILE, widest: int | None = None) -> DataFrame:
    """(keys, i, j, label) of cells that are ``selected`` or ``dense``: dense components are origins, other selected cells join
    the origin that reaches them; cells between origins that can't agree keep -1.

    Components of all these cells are independent: without an origin all stay -1, with one (and no limit on passes) all take it
    by a join, and only components with several origins are swept in raster order: one task each on a grid up to ``tile`` cells
    wide, tile by tile on wider ones.
    """
    keys = list(keys)
    widest = widest or cells.agg(F.max(F.greatest("nx", "ny"))).first()[0] or 1
    d = cells.where("selected or dense").select(*keys, "i", "j", "nx", "ny", "selected", "dense")
    on = [*keys, "i", "j"]
    seeds = cell_components(d.where("dense"), keys, connectivity, periodic, tile, widest).withColumnRenamed("label", "seed")
    whole = _roots(d, keys, connectivity, periodic, tile, widest).select(*on, "root")
    d = d.join(whole, on).join(seeds, on, "left").fillna({"seed": -1})
    range_ = d.where("seed >= 0").groupBy(*keys, "root").agg(F.min("seed").alias("lo"), F.max("seed").alias("hi"))
    d = d.join(range_, [*keys, "root"], "left").fillna({"hi": -1})
    contested = (F.col("hi") >= 0) & ((F.col("lo") < F.col("hi")) if max_passes is None else F.lit(True))
    plain = d.where(~contested).select(*on, F.when(F.col("hi") >= 0, F.when(F.col("selected") | (F.col("seed") >= 0), F.col("hi"))).otherwise(-1).cast("int").alias("label"))

    def sweep(g: pd.DataFrame) -> pd.DataFrame:
        a = [g[c].to_numpy() for c in ("i", "j", "seed", "selected")]
        got, _ = grow(*a, int(g["nx"].iloc[0]), int(g["ny"].iloc[0]), connectivity, periodic, max_passes)
        return g.assign(label=got)[[*on, "label"]]

    if widest > tile:
        return plain.unionByName(_grow_tiles(d.where(contested), keys, connectivity, periodic, max_passes, tile))
    swept = d.where(contested).groupBy(*keys, "root").applyInPandas(lambda g: sweep(g), _schema(d, on, "label int"))
    return plain.unionByName(swept)


def _grow_tiles(cells: DataFrame, keys: list[str], connectivity: int, wrap: bool, max_passes: int | None, tile: int) -> DataFrame:
    """(keys, i, j, label) of cells grown from their seeds, each tile a task.

    A tile grows its cells from its own seeds and what its neighbours say of their rims: (pass, label) of each labelled cell. Rounds go
    on for the tiles to which something else is said than before, until nothing is. What a cell becomes hangs only on visits before its
    own, so a round settles at least the first visit that was still wrong and all that follows from it inside tiles, and the state in
    which all rims agree is that of the sweeps. There are about as many rounds as a label's way crosses rims, however many passes
    the sweeps take. A round writes rims only. Two tiles can go on telling each other of a label that neither has from elsewhere, a pass
    later each round: so after 6 rounds, then 12 more and so on, what is said from the first change on is forgotten. All before is
    settled, and what was right is said again.
    """
    at = [*keys, "ti", "tj"]
    home = {"ti": F.floor(F.col("i") / tile).cast("int"), "tj": F.floor(F.col("j") / tile).cast("int")}
    d = cut(cells.select(*keys, "i", "j", "nx", "ny", "seed", "selected").withColumns(home))
    names, kinds = [*at, "fi", "fj", "i", "j", "pass", "label"], _schema(d, at, "fi int, fj int, i int, j int, pass long, label long")
    moves = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not (a and b))]

    def grown(g: pd.DataFrame, said: pd.DataFrame | None) -> pd.DataFrame:
        told = None if said is None else dict(zip(zip(said["i"].tolist(), said["j"].tolist()), zip(said["pass"].tolist(), said["label"].tolist())))
        label, passes = grow(*(g[c].to_numpy() for c in ("i", "j", "seed", "selected")), int(g["nx"].iloc[0]), int(g["ny"].iloc[0]), connectivity, wrap, max_passes, told)
        return g.assign(label=label, **{"pass": passes})

    def speak(g: pd.DataFrame, said: pd.DataFrame | None) -> pd.DataFrame:
        """Labelled rim cells once for each other tile that they touch, with the tile they come from as fi and fj."""
        if not len(g):
            return pd.DataFrame(columns=names)
        x = grown(g, said).query("label >= 0").rename(columns={"ti": "fi", "tj": "fj"})
        out = []
        for a, b in moves:
            u, v = x["i"] + a, x["j"] + b
            u, v = (u % x["nx"], v % x["ny"]) if wrap else (u, v)
            y = x.assign(ti=u // tile, tj=v // tile)
            out.append(y[(y["ti"] != y["fi"]) | (y["tj"] != y["fj"])][names])
        return pd.concat(out).drop_duplicates()

    def settle(g: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        return grown(g, said)[[*keys, "i", "j", "label"]] if len(g) else pd.DataFrame(columns=[*keys, "i", "j", "label"])

    said = cut(d.groupBy(*at).applyInPandas(lambda g: speak(g, None), kinds))
    news, visit = said.select(*at).distinct(), F.struct("pass", "i", "j")
    rounds, step, forget = 0, 6, 6
    while not news.isEmpty():
        again = d.join(news, at, "left_semi").groupBy(*at).cogroup(said.join(news, at, "left_semi").groupBy(*at))
        now = said.join(news.withColumnsRenamed({"ti": "fi", "tj": "fj"}), [*keys, "fi", "fj"], "left_anti").select(*names)
        now = cut(now.unionByName(again.applyInPandas(lambda g, h: speak(g, h), kinds)))
        changed = cut(said.unionByName(now).groupBy(*names).count().where("count = 1"))
        news, rounds = changed.select(*at).distinct(), rounds + 1
        if rounds == forget:
            step, forget = 2 * step, rounds + 2 * step
            first = changed.groupBy(*keys).agg(F.min(visit).alias("_first"))
            marked = now.join(first, keys, "left") if keys else now.crossJoin(first)
            marked = cut(marked.withColumn("_late", F.coalesce(visit >= F.col("_first"), F.lit(False))))
            late, now = marked.where("_late"), marked.where("not _late").select(*names)
            news = news.unionByName(late.select(*at)).unionByName(late.select(*keys, F.col("fi").alias("ti"), F.col("fj").alias("tj"))).distinct()
        said = now
    last = d.groupBy(*at).cogroup(said.groupBy(*at))
    return last.applyInPandas(lambda g, h: settle(g, h), _schema(d, [*keys, "i", "j"], "label int"))


def _packed(prefix: str = "") -> Column:
    c = lambda a: F.col(f"{prefix}{a}").cast("long")
    return (c("xi") * AXIS + c("yi")) * AXIS + c("zi")


def cell_components_3d(cells: DataFrame, keys: Sequence[str] = ("step", "size_id"), radius: float = 1.01, by_size: bool = False, drop_singletons: bool = False) -> DataFrame:
    """(keys, cluster_id, xi, yi, zi): components of 3D cells within an index distance, without wrap.

    Ids run from 1 in order of each component's first cell, or with ``by_size`` from 0 by falling size; isolated cells are kept
    unless ``drop_singletons``.
    """
    keys = list(keys)
    d = cells.select(*keys, "xi", "yi", "zi").distinct().withColumn("vertex", _packed())
    reach = int(radius)
    steps = [o for o in product(range(-reach, reach + 1), repeat=3) if (0, 0, 0) < o and sum(x * x for x in o) <= radius * radius]
    if steps:
        near = F.explode(F.array(*(F.lit((a * AXIS + b) * AXIS + c) for a, b, c in steps)))
        e = d.select(*keys, F.col("vertex").alias("src"), near.alias("by")).withColumn("dst", F.col("src") + F.col("by"))
        e = e.join(d.select(*keys, F.col("vertex").alias("dst")), [*keys, "dst"], "left_semi")
        d = d.join(components(e, keys, finish=FINISH), [*keys, "vertex"], "left")
    else:
        d = d.withColumn("root", F.col("vertex"))
    d = d.withColumn("root", F.coalesce("root", "vertex"))
    if not (by_size or drop_singletons):
        return _numbered(d, keys, "cluster_id", 1).select(*keys, "cluster_id", "xi", "yi", "zi")
    sizes = d.groupBy(*keys, "root").agg(F.count("*").alias("size"))
    if drop_singletons:
        sizes = sizes.where("size > 1")
    order = [F.desc("size"), F.col("root")] if by_size else [F.col("root")]
    ids = ranked(sizes, keys, order, "cluster_id").withColumn("cluster_id", (F.col("cluster_id") + (0 if by_size else 1)).cast("int"))
    return d.join(ids, [*keys, "root"]).select(*keys, "cluster_id", "xi", "yi", "zi")


def atom_components(atoms: DataFrame, keys: Sequence[str] = ("step",), cutoff: float = 1.5, thr: float | None = None, strict: bool = False) -> DataFrame:
    """(keys, atom_id, label) of all atoms: components of those whose c_label reaches ``thr`` under distance ``cutoff``.

    Labels run from 1 in order of each component's first atom, 0 for atoms that are left out; with ``strict`` the threshold must
    be exceeded, labels run from 0 and left out is -1.
    """
    keys = list(keys)
    c = F.col("c_label")
    over = F.lit(True) if thr is None else F.coalesce(c > thr if strict else c >= thr, F.lit(False))
    rooted = cut(clique_components(atoms.where(over), cutoff, keys))
    named = _numbered(rooted, keys, "label", 0 if strict else 1).select(*keys, "atom_id", "label")
    return named.unionByName(atoms.where(~over).select(*keys, "atom_id", F.lit(-1 if strict else 0).alias("label")))


def cluster_members(df: DataFrame, keys: Sequence[str], members: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """(keys, chunk, members): the sorted members of each cluster in lists of ``chunk`` (the last one shorter), numbered from 0, so
    that a cluster of any size comes whole and no row grows with it."""
    keys = list(keys)
    one = F.struct(*members) if len(members) > 1 else F.col(members[0])
    d = ranked(df.select(*keys, *members), keys, [F.col(m) for m in members], "_at")
    return d.groupBy(*keys, F.floor(F.col("_at") / chunk).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(one)).alias("members"))


def cluster_sizes(labelled: DataFrame, keys: Sequence[str] = (), label: str = "label", noise: int = -1) -> DataFrame:
    """Size and rank by falling size of each cluster; noise is counted apart, without a rank."""
    keys = list(keys)
    s = labelled.groupBy(*keys, label).agg(F.count("*").alias("size"))
    real = s.where(F.col(label) != noise)
    rank = ranked(real, keys, [F.desc("size"), F.col(label)], "size_rank").withColumn("size_rank", (F.col("size_rank") + 1).cast("int"))
    return rank.select(*s.columns, "size_rank").unionByName(s.where(F.col(label).isNull() | (F.col(label) == noise)).withColumn("size_rank", F.lit(None).cast("int")))
