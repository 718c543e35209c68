"""Diffusion of cell fields: masked on 2D grids, free or imputing on 3D lattices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridjobs.functions.kernels import Masked2D, diffuse_3d
from gridjobs.functions.session import cut
from gridjobs.operators.labelling import TILE, _roots, _schema

#: Cells of a lattice that one task holds; edge of the tiles of larger ones, and steps that a tile takes between halos.
WHOLE, EDGE, HALO = 4_000_000, 64, 16
#: Up to this rate a group's changes never grow again, so each group can be run for itself.
STEADY = 0.25
#: Sparse cells that touch each other and are one task; steps that a 2D tile takes between halos, and checks where it needs none.
TOUCHING, STRIDE, CHECKS = 1_000_000, 40, 16


def _first_check(min_iters: int, check_every: int) -> int:
    return max(1, -(-min_iters // check_every)) * check_every


def diffuse_masked_2d(
    cells: DataFrame, keys: Sequence[str] = (), betas: Sequence[float] = (0.10,), max_iters: int = 50_000, min_iters: int = 60, tol: float = 1e-6, check_every: int = 10, periodic: bool = False, tile: int = TILE, widest: int | None = None, touching: int = TOUCHING
) -> tuple[DataFrame, DataFrame]:
    """Field and run statistics of every rate: (cells x beta with c, stats by keys and beta).

    ``cells`` has i, j, nx, ny, norm, dense and scale (norm at which a cell's weight is 1). Dense cells hold 1, cells without a
    row 0, sparse cells start from 0 and move. Stats: iters_used, max_delta_last and stop (converged or max_iters).

    Dense and empty cells never change, so each group of touching sparse cells is a problem of its own and a task of its own,
    whatever the iteration count. The stop is global: a group runs until its own largest change is below ``tol`` at a check and its
    state is kept; those that are done before the last one then go on from there to the same check. Groups of more than ``touching``
    cells, and rates above 0.25, where changes may rise again, go tile by tile (see ``_lockstep``).
    """
    keys = list(keys)
    on = [*keys, "i", "j"]
    first = _first_check(min_iters, check_every)
    spark = cells.sparkSession
    rates = spark.createDataFrame([(n, float(b)) for n, b in enumerate(betas)], "beta_no int, beta double")
    sparse = cells.where(~F.col("dense")).select(*on, "nx", "ny", "norm", "scale")
    sides = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    around = sparse.select(*on, "nx", "ny", F.explode(sides).alias("s")).withColumns({"ni": F.col("i") + F.col("s.a"), "nj": F.col("j") + F.col("s.b")})
    if periodic:
        around = around.withColumns({"ni": F.pmod("ni", "nx"), "nj": F.pmod("nj", "ny")})
    inside = F.col("ni").between(0, F.col("nx") - 1) & F.col("nj").between(0, F.col("ny") - 1)
    dense = cells.where("dense").select(*keys, F.col("i").alias("ni"), F.col("j").alias("nj"), F.lit(1).alias("is_dense"))
    sums = around.join(dense, [*keys, "ni", "nj"], "left").groupBy(*on).agg(F.coalesce(F.sum("is_dense"), F.lit(0)).alias("dense_near"), F.count_if(inside).alias("in_grid"))
    weight = F.least(F.greatest(F.col("norm") / F.greatest("scale", F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    g = sparse.withColumn("w", weight).join(sums, on).join(_roots(sparse, keys, 4, periodic, tile, widest).select(*on, "root"), on)
    g = cut(g)
    steady = [float(b) for b in betas if b <= STEADY]
    if steady and (widest or tile + 1) ** 2 > touching and not g.groupBy(*keys, "root").count().where(F.col("count") > touching).isEmpty():
        steady = []
    ends = max_iters, first, check_every, tol
    runs = (cells.select(*keys).distinct() if keys else spark.range(1).select()).crossJoin(F.broadcast(rates))
    alone = F.col("beta").isin(steady) if steady else F.lit(False)
    parts = [_settled(g.crossJoin(F.broadcast(rates.where(alone))), keys, ends, periodic)] if steady else []
    if len(steady) < len(betas):
        parts.append(_lockstep(g.crossJoin(F.broadcast(rates.where(~alone))), keys, ends, periodic, tile))
    moved, found = (reduce(DataFrame.unionByName, p) for p in zip(*parts, strict=True))
    stats = runs.join(found, [*keys, "beta_no"], "left").withColumn("iters_used", F.coalesce("iters_used", F.lit(min(max_iters, first))))
    field = cells.crossJoin(F.broadcast(rates)).join(moved, [*on, "beta_no"], "left")
    field = field.withColumn("c", F.when(F.col("dense"), F.lit(1.0)).otherwise(F.coalesce("c", F.lit(0.0))))
    checked = F.col("iters_used") >= check_every
    stats = stats.withColumn("max_delta_last", F.when(checked, F.coalesce(F.nanvl("delta", F.lit(0.0)), F.lit(0.0)))).drop("delta")
    good = (F.col("iters_used") < max_iters) & (F.col("max_delta_last") < tol)
    return field, stats.withColumn("stop", F.when(F.coalesce(good, F.lit(False)), "converged").otherwise("max_iters"))


Ends = tuple[int, int, int, float]


def _made(d: pd.DataFrame, periodic: bool) -> Masked2D:
    return Masked2D(*(d[c].to_numpy() for c in ("i", "j", "dense_near", "in_grid", "w")), int(d["nx"].iloc[0]), int(d["ny"].iloc[0]), periodic)


def _settled(g: DataFrame, keys: list[str], ends: Ends, periodic: bool) -> tuple[DataFrame, DataFrame]:
    """(cells with c, runs with iters_used and delta) for groups that are a task each: run till they settle, then all to the last stop."""
    max_iters, first, check_every, tol = ends
    on, group = [*keys, "i", "j"], [*keys, "beta_no", "root"]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        m, beta, delta, last = _made(d, periodic), float(d["beta"].iloc[0]), np.nan, np.nan
        begin, stop = 0, max_iters
        if "c" in d:
            m.c[:-1], begin, stop, last = d["c"].to_numpy(), int(d["at"].iloc[0]), int(d["iters_used"].iloc[0]), float(d["delta"].iloc[0])
        it = begin
        while it < stop:
            it += 1
            delta = m.step(beta)
            if it % check_every == 0:
                last = delta
                if "c" not in d and delta < tol:
                    break
        return d.assign(c=m.c[:-1], at=it, delta=last)[[*group, "i", "j", "nx", "ny", "dense_near", "in_grid", "w", "beta", "c", "at", "delta"]]

    kinds = _schema(g, [*group, "i", "j", "nx", "ny", "dense_near", "in_grid", "w", "beta"], "c double, at int, delta double")
    state = cut(g.groupBy(*group).applyInPandas(lambda d: run(d), kinds))
    stop = state.groupBy(*keys, "beta_no").agg(F.least(F.lit(max_iters), F.greatest(F.lit(first), F.max("at"))).alias("iters_used"))
    todo = state.join(stop, [*keys, "beta_no"])
    done = todo.where("at >= iters_used").drop("iters_used")
    final = cut(done.unionByName(todo.where("at < iters_used").groupBy(*group).applyInPandas(lambda d: run(d), kinds)))
    deltas = final.groupBy(*keys, "beta_no").agg(F.max("at").alias("iters_used"), F.max("delta").alias("delta"))
    return final.select(*on, "beta_no", "c"), deltas


def _lockstep(g: DataFrame, keys: list[str], ends: Ends, periodic: bool, tile: int) -> tuple[DataFrame, DataFrame]:
    """The same tile by tile, all of a run in step.

    A superstep is a job: each tile takes some checks' steps on its own cells and a halo of its neighbours' that is as wide, so what it
    lacks beyond the halo can't reach its own cells. What it tells of each check is its own cells' largest change; the largest of all
    tiles decides at which check the run stops. Runs that stop within a superstep are taken there anew from the state before it, the
    others go on. Each state is written to the shared folder. Grids of one tile need no halo and take longer supersteps each time.
    """
    max_iters, first, check_every, tol = ends
    on, run_keys = [*keys, "i", "j"], [*keys, "beta_no"]
    cols = [*run_keys, "i", "j", "nx", "ny", "dense_near", "in_grid", "w", "beta", "c"]
    state = cut(g.withColumn("c", F.lit(0.0)).select(*cols))
    top = state.agg(F.max(F.greatest("nx", "ny"))).first()[0] or 0
    whole = top <= tile
    checks = CHECKS if whole else max(1, min(STRIDE, tile) // check_every)
    if not whole and checks * check_every > tile:
        raise ValueError("a tile must be at least as wide as the steps between two checks")
    halo = checks * check_every
    kinds = _schema(state, cols[:-1], "c double, deltas array<double>")

    def stepped(before: DataFrame) -> DataFrame:
        """Own cells of each tile after the steps of its run, one of them with the tile's change at each check."""
        d = before.withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)})
        if not whole:
            for a, n in (("i", "nx"), ("j", "ny")):
                # a halo is no wider than a tile; over the grid's edge it meets the first or the last tile, which may be narrow, and maybe one more
                ends_ = [F.col(a) - halo, F.col(a) + halo]
                near = [F.col(a), *(F.greatest(F.lit(0), F.least(x, F.col(n) - 1)) for x in ends_)]
                if periodic:
                    near += [F.pmod(x, F.col(n)) for x in ends_] + [F.when(ends_[0] < 0, F.col(n) - 1).otherwise(F.col(a)), F.when(ends_[1] >= F.col(n), 0).otherwise(F.col(a))]
                d = d.withColumn(f"_t{a}", F.explode(F.array_distinct(F.array(*(F.floor(x / tile) for x in near)))))
        else:
            d = d.withColumns({"_ti": F.col("ti"), "_tj": F.col("tj")})

        def run(t: pd.DataFrame) -> pd.DataFrame:
            own = ((t["ti"] == t["_ti"]) & (t["tj"] == t["_tj"])).to_numpy()
            n = int(t["steps"].iloc[0])
            m, beta, deltas = _made(t, periodic), float(t["beta"].iloc[0]), []
            m.c[:-1] = t["c"].to_numpy()
            for it in range(1, n + 1):
                delta = m.step(beta, own)
                if it % check_every == 0:
                    deltas.append(delta)
            out = t.assign(c=m.c[:-1])[own]
            out["deltas"] = [deltas if k == 0 else None for k in range(len(out))]
            return out[[*cols, "deltas"]]

        return d.groupBy(*run_keys, "_ti", "_tj").applyInPandas(lambda t: run(t), kinds)

    done, fields, stops, earlier = 0, [], [], None
    while not state.isEmpty():
        steps = min(checks * check_every, max_iters - done)
        after = cut(stepped(state.withColumn("steps", F.lit(steps))))
        told = after.where("deltas is not null").select(*run_keys, F.posexplode("deltas").alias("at", "delta")).groupBy(*run_keys, "at").agg(F.max("delta").alias("delta"))
        told = cut(told.withColumn("at", F.col("at") * check_every + check_every))
        enough = (F.col("at") + done >= first) & (F.col("delta") < tol)
        stop = told.where(enough).groupBy(*run_keys).agg(F.min("at").alias("steps"))
        if done + steps >= max_iters:
            rest = state.select(*run_keys).distinct().join(stop, run_keys, "left")
            stop = rest.withColumn("steps", F.coalesce("steps", F.lit(steps)))
        stop = cut(stop)
        if not stop.isEmpty():
            # the change at the last check, which in a short last superstep is that of the one before
            known = told if steps >= check_every or earlier is None else earlier.groupBy(*run_keys).agg(F.max_by("delta", "at").alias("delta")).withColumn("at", F.lit(0))
            last = stop.join(known, run_keys, "left").where("at is null or at <= steps").groupBy(*run_keys, "steps").agg(F.max_by("delta", "at").alias("delta"))
            stops.append(last.select(*run_keys, (F.col("steps") + done).cast("int").alias("iters_used"), "delta"))
            fields.append(after.join(stop.where(F.col("steps") == steps), run_keys, "left_semi").select(*on, "beta_no", "c"))
            part = stop.where(F.col("steps") < steps)
            if not part.isEmpty():
                fields.append(cut(stepped(state.join(part, run_keys))).select(*on, "beta_no", "c"))
        state = after.drop("deltas").join(stop, run_keys, "left_anti")
        earlier = told
        done += steps
        if whole:
            checks *= 2
    empty = g.limit(0)
    fields = fields or [empty.select(*on, "beta_no", F.lit(0.0).alias("c"))]
    stops = stops or [empty.select(*run_keys, F.lit(0).alias("iters_used"), F.lit(0.0).alias("delta"))]
    return reduce(DataFrame.unionByName, fields), reduce(DataFrame.unionByName, stops)


def _lattice(d: pd.DataFrame, value: str) -> tuple[np.ndarray, tuple]:
    shape = tuple(int(d[c].iloc[0]) for c in ("mx", "my", "mz"))
    at = tuple(d[c].to_numpy() for c in ("xi", "yi", "zi"))
    field = np.zeros(shape)
    field[at] = d[value].fillna(0.0).to_numpy()
    return field, at


def diffuse_free_3d(cells: DataFrame, keys: Sequence[str] = ("step", "size_id"), beta: float = 0.10, iters: int = 500, whole: int = WHOLE) -> DataFrame:
    """Occupied cells with c: the mean label after ``iters`` steps on the periodic lattice, clipped to [0, 1]; empty cells take
    part with 0. Lattices of up to ``whole`` cells are a task each, larger ones go tile by tile."""
    return _diffused(cells, list(keys), beta, iters, False, whole)


def impute_3d(lattice: DataFrame, keys: Sequence[str] = ("step", "size_id"), beta: float = 0.10, iters: int = 500, whole: int = WHOLE) -> DataFrame:
    """All cells of a lattice with c: empty cells start at 0 and are filled by diffusion, known ones keep their mean."""
    return _diffused(lattice, list(keys), beta, iters, True, whole)


def _diffused(cells: DataFrame, keys: list[str], beta: float, iters: int, impute: bool, whole: int) -> DataFrame:
    def run(d: pd.DataFrame) -> pd.DataFrame:
        field, at = _lattice(d, "label_mean")
        known = None
        if impute:
            known = np.zeros(field.shape, bool)
            known[at] = d["cn"].to_numpy() > 0
        return d.assign(c=diffuse_3d(field, beta, iters, known, clip=not impute)[at])

    most = cells.agg(F.max(F.col("mx").cast("long") * F.col("my") * F.col("mz"))).first()[0]
    if most is None or most <= whole:
        return cells.groupBy(*keys).applyInPandas(lambda d: run(d), _schema(cells, cells.columns, "c double"))
    return _tiled(cells, keys, beta, iters, impute)


def _tiled(cells: DataFrame, keys: list[str], beta: float, iters: int, impute: bool, tile: int = EDGE, halo: int = HALO) -> DataFrame:
    """Diffusion of lattices that are larger than a task should hold.

    Each axis is cut evenly into tiles of ``tile`` cells or more. A tile with a halo of h cells from its 26 neighbours can take h
    steps alone; then halos are sent anew. Wrapping is part of which tiles are neighbours, so every cell goes through the same
    operations as on the whole lattice. The state of each round is written to the shared folder.
    """
    dims, tids, names = ["mx", "my", "mz"], ["tx", "ty", "tz"], [*cells.columns, "c"]
    grids = cells.select(*keys, *dims).distinct()
    counts = {t: F.greatest(F.lit(1), F.floor(F.col(m) / tile)).cast("int") for t, m in zip(tids, dims, strict=True)}
    least = grids.agg(F.min(F.least(*(F.floor(F.col(m) / counts[t]) for t, m in zip(tids, dims, strict=True))))).first()[0]
    h = max(1, min(halo, int(least)))
    tiles = grids
    for t in tids:
        tiles = tiles.withColumn(t, F.explode(F.sequence(F.lit(0), counts[t] - 1)))
    # cell c of m lies in tile t if t * m // n <= c
    place = {t: F.floor(((F.col(f"{a}i").cast("long") + 1) * counts[t] - 1) / F.col(m)).cast("int") for t, m, a in zip(tids, dims, "xyz", strict=True)}
    dealt = cells.withColumns(place)
    on = [*keys, *tids]
    edges = lambda m, n: [k * m // n for k in range(n + 1)]
    cuts = lambda r: [edges(int(r[m]), max(1, int(r[m]) // tile)) for m in dims]
    kinds = _schema(cells, [*keys, *dims], "tx int, ty int, tz int, field binary, known binary")

    def low_and_shape(r) -> tuple[list[int], list[int]]:
        c = [(e[int(r[t])], e[int(r[t]) + 1]) for e, t in zip(cuts(r), tids, strict=True)]
        return [a for a, _ in c], [b - a for a, b in c]

    def build(one: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        low, shape = low_and_shape(one.iloc[0])
        field, known = np.zeros(shape), np.zeros(shape, bool)
        if len(own):
            at = tuple(own[f"{a}i"].to_numpy() - o for a, o in zip("xyz", low, strict=True))
            field[at] = own["label_mean"].fillna(0.0).to_numpy()
            if impute:
                known[at] = own["cn"].to_numpy() > 0
        return one[[*keys, *dims, *tids]].assign(field=[field.tobytes()], known=[known.tobytes()])

    renamed = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  two sides that come of one table
    state = cut(renamed(tiles).groupBy(*on).cogroup(dealt.groupBy(*on)).applyInPandas(lambda a, b: build(a, b), kinds))
    sides = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

    def send(parts):
        for part in parts:
            for _, r in part.iterrows():
                _, shape = low_and_shape(r)
                field = np.frombuffer(r["field"]).reshape(shape)
                known = np.frombuffer(r["known"], bool).reshape(shape)
                ns = [len(e) - 1 for e in cuts(r)]
                out = []
                for side in sides:  # to the neighbour on that side goes the slab that touches it, which lies on its other side
                    own = tuple(slice(None) if s == 0 else slice(-h, None) if s > 0 else slice(0, h) for s in side)
                    to = [(int(r[t]) + s) % n for t, s, n in zip(tids, side, ns, strict=True)]
                    out.append((*(r[k] for k in keys), *(int(r[m]) for m in dims), *to, *(-s for s in side), field[own].tobytes(), known[own].tobytes()))
                yield pd.DataFrame(out, columns=[*keys, *dims, *tids, "ax", "ay", "az", "field", "known"])

    def step(count: int):
        def run(d: pd.DataFrame) -> pd.DataFrame:
            r = d.iloc[0]
            _, shape = low_and_shape(r)
            field, known = np.zeros([n + 2 * h for n in shape]), np.zeros([n + 2 * h for n in shape], bool)
            for _, piece in d.iterrows():
                side = [int(piece[c]) for c in ("ax", "ay", "az")]
                at = tuple(slice(h, h + n) if s == 0 else slice(0, h) if s < 0 else slice(h + n, None) for s, n in zip(side, shape, strict=True))
                size = [n if s == 0 else h for s, n in zip(side, shape, strict=True)]
                field[at] = np.frombuffer(piece["field"]).reshape(size)
                known[at] = np.frombuffer(piece["known"], bool).reshape(size)
            c = diffuse_3d(field, beta, count, known if impute else None, clip=not impute)
            inner = (slice(h, -h),) * 3
            return d.iloc[:1][[*keys, *dims, *tids]].assign(field=[c[inner].tobytes()], known=[known[inner].tobytes()])

        return run

    sent = _schema(cells, [*keys, *dims], "tx int, ty int, tz int, ax int, ay int, az int, field binary, known binary")
    done = 0
    while done < iters:
        count = min(h, iters - done)
        state = cut(state.mapInPandas(send, sent).groupBy(*on).applyInPandas(step(count), kinds))
        done += count

    def told(own: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own.assign(c=[])[names]
        low, shape = low_and_shape(one.iloc[0])
        at = tuple(own[f"{a}i"].to_numpy() - o for a, o in zip("xyz", low, strict=True))
        return own.assign(c=np.frombuffer(one["field"].iloc[0]).reshape(shape)[at])[names]

    return dealt.groupBy(*on).cogroup(renamed(state).groupBy(*on)).applyInPandas(lambda a, b: told(a, b), _schema(cells, cells.columns, "c double"))
