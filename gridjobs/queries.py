"""Registered queries of the grid clustering jobs, and SQL for the same results.

Points come from ``events`` (hours since the first event, value), labelled points from ``embeddings`` (two components), snapshots
from ``lineitem`` (years as steps). Doubles are rounded so that two engines can be compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridjobs.functions.session import cut, shared_dir
from gridjobs.operators import baselines, diffusion, grid, labelling, matching, metrics, neighbors, prepare, search
from gridjobs.operators.components import components
from gridjobs.plans import comparison, pipeline
from gridjobs.sources import points as sources

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NX, NY = 30, 20


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, halves away from zero, without a negative zero; numbers that are not finite or too large stay."""
    m = 10.0**digits

    def short(c):
        near = F.signum(c) * F.floor(F.abs(c) * m + 0.5) / m + F.lit(0.0)
        return F.when(F.abs(c) < 1e12, near).otherwise(c)

    return df.select(*(short(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# Inputs


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(at).alias("first"))
    hours = e.crossJoin(F.broadcast(first)).select(F.col("event_id").alias("point_id"), ((at - F.col("first")) / F.lit(3.6e9)).alias("x"), F.col("value").cast("double").alias("y"), F.col("event_type").alias("truth"))
    return sources.points_from(hours)


P = """p as (select event_id as point_id, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 3.6e9 as x, value::double as y, event_type as truth
  from events where ts is not null and value is not null and isfinite(value::double))"""


def vector_points(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    p = e.select(F.col("vec_id").alias("point_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), F.col("label").cast("int").alias("truth"))
    return prepare.standardize(p) if scaled else p


V = "v as (select vec_id as point_id, embedding[1]::double as x, embedding[2]::double as y, label::int as truth from embeddings where embedding is not null)"


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as atoms: the year is the step, the label a multiple of 1/8, and the id a hash of what tells the rows apart."""
    t = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    row = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(d("l_extendedprice") * 100).cast("long"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return t.select(
        F.year("l_shipdate").cast("long").alias("step"), F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long").alias("atom_id"),
        d("l_quantity").alias("x"), (d("l_extendedprice") / 2100).alias("y"), (d("l_discount") * 500).alias("z"), (F.round(d("l_tax") * 100) / 8).alias("c_label"),
        *(F.lit(v).alias(c) for c, v in zip(sources.BOX, (0.0, 50.0001) * 3, strict=True)),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.snapshots_from(line_items(spark, sf_dir))


A = """a as (select year(l_shipdate)::bigint as step, ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || round(l_extendedprice::double * 100)::bigint || '|' || strftime(l_shipdate, '%Y-%m-%d')), 1, 15))::bigint as atom_id,
  l_quantity::double as x, l_extendedprice::double / 2100 as y, l_discount::double * 500 as z, round(l_tax::double * 100) / 8 as c_label from lineitem)"""


def vector_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one snapshot of atoms: three components, label scaled to (0, 1]."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.lit(0).cast("long").alias("step"), F.col("vec_id").alias("atom_id"), *(F.get("embedding", F.lit(n)).cast("double").alias(c) for n, c in enumerate("xyz")), ((F.col("label") + 1) / 10.0).alias("c_label"))


W = "w as (select 0::bigint as step, vec_id as atom_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, (label + 1) / 10.0::double as c_label from embeddings where embedding is not null)"


def binned_events(spark: SparkSession, sf_dir: str, nx: int = NX, ny: int = NY) -> DataFrame:
    return search.bin_candidates(event_points(spark, sf_dir), spark.createDataFrame([(nx, ny)], "nx int, ny int"))


def event_cells(spark: SparkSession, sf_dir: str, nx: int = NX, ny: int = NY) -> DataFrame:
    return grid.normalize_nonzero(grid.cell_counts(binned_events(spark, sf_dir, nx, ny), ["nx", "ny", *search.BOUNDS]))


def binned_sql(nx: int = NX, ny: int = NY, source: str = "p") -> str:
    return f"""b as (select min(x) - 1e-9 * (max(x) - min(x) + 1) as x_min, max(x) + 1e-9 * (max(x) - min(x) + 1) as x_max, min(y) - 1e-9 * (max(y) - min(y) + 1) as y_min, max(y) + 1e-9 * (max(y) - min(y) + 1) as y_max from {source}),
q as (select {source}.*, b.*, greatest(0, least(floor((x - x_min) / ((x_max - x_min) / {nx})), {nx - 1}))::int as i, greatest(0, least(floor((y - y_min) / ((y_max - y_min) / {ny})), {ny - 1}))::int as j from {source}, b)"""


NORM = "c0 as (select i, j, count(*) as n from q group by i, j), c as (select i, j, n, case when max(n) over () > min(n) over () then (n - min(n) over ())::double / (max(n) over () - min(n) over ()) else 0 end as norm from c0)"
CELLS = f"{P}, {binned_sql()}, {NORM}"


def components_sql(cells: str, name: str, near: str = "abs(s.i - c.i) + abs(s.j - c.j) = 1", code: str = f"i * {NY} + j", key: str | None = None) -> str:
    """Labels of cells by reachability, in raster order, as CTE ``name``."""
    k, on = (f"{key}, ", f" and s.{key} = c.{key}") if key else ("", "")
    kk = f"c.{key}, " if key else ""
    part = f"partition by {key} " if key else ""
    return f"""{name}_s as (select *, ({code})::bigint as code from {cells}),
{name}_r({k}a, b) as (select {k}code, code from {name}_s union select {kk}r.a, s.code from {name}_r r join {name}_s c on c.code = r.b{f" and c.{key} = r.{key}" if key else ""} join {name}_s s on {near}{on}),
{name}_m as (select {k}a, min(b) as root from {name}_r group by {k}a),
{name} as (select {name}_s.*, root, (dense_rank() over ({part.replace(key, f"{name}_s.{key}") if key else ""}order by root) - 1)::int as label from {name}_s join {name}_m on {name}_m.a = {name}_s.code{f" and {name}_m.{key} = {name}_s.{key}" if key else ""})"""


# Sources and sinks


@query("s1_read_points", f"with {P} select point_id, round(x, 6) as x, round(y, 6) as y, truth from p")
def read_points(spark, sf_dir):
    """Points written as CSV and read back."""
    path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    event_points(spark, sf_dir).select("point_id", "x", "y", "truth").write.csv(path, header=True)
    return rounded(sources.read_points(spark, path).select("point_id", "x", "y", "truth"))


@query("s1_read_points_without_ids", f"with {P} select truth as class, count(*) as n, round(min(x), 6) as x, round(max(y), 6) as y, (select count(*) from p) as n_ids, 0::bigint as first_id, (select count(*) - 1 from p) as last_id from p group by truth")
def read_points_without_ids(spark, sf_dir):
    """Points of a CSV file that has only coordinates and a class: their ids are their places."""
    path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    event_points(spark, sf_dir).select("x", "y", F.col("truth").alias("class")).write.csv(path, header=True)
    p = sources.read_points(spark, path)
    truth = sources.find_truth_column(p)
    ids = p.agg(F.count_distinct("point_id").alias("n_ids"), F.min("point_id").alias("first_id"), F.max("point_id").alias("last_id"))
    return rounded(p.groupBy(truth).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("y").alias("y")).crossJoin(F.broadcast(ids)))


SNAPSHOTS = "select step, 0.0::double as xlo, 50.0001::double as xhi, count(*) as n, sum(c_label) as labels, round(avg(x), 6) as x, round(avg(z), 6) as z from a group by step"


def snapshot_table(a: DataFrame) -> DataFrame:
    s = a.groupBy("step").agg(F.count("*").alias("n"), F.sum("c_label").alias("labels"), F.avg("x").alias("x"), F.avg("z").alias("z"))
    return rounded(sources.snapshot_boxes(a).select("step", "xlo", "xhi").join(s, "step"))


@query("s2_read_snapshots", f"with {A} {SNAPSHOTS}")
def read_snapshots(spark, sf_dir):
    """Snapshots written as Parquet and read back."""
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    line_items(spark, sf_dir).write.parquet(path)
    return snapshot_table(sources.read_snapshots(spark, path, "parquet"))


@query("s2_read_snapshots_without_ids", f"with {A}, s as ({SNAPSHOTS}) select *, (select sum(n)::bigint from s) as n_ids from s")
def read_snapshots_without_ids(spark, sf_dir):
    """Snapshots of a CSV file without atom ids."""
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    line_items(spark, sf_dir).drop("atom_id").write.csv(path, header=True)
    a = sources.read_snapshots(spark, path).withColumn("step", F.col("step").cast("long"))
    return snapshot_table(a).crossJoin(F.broadcast(a.agg(F.count_distinct("atom_id").alias("n_ids"))))


@query("s3_find_truth_column", "select label::int as truth, count(*) as n from embeddings group by label")
def find_truth_column(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.col(sources.find_truth_column(e)).cast("int").alias("truth")).agg(F.count("*").alias("n"))


@query("s4_decode_labels", "select label::varchar as label, label::int as label_int, count(*) as n from embeddings group by label")
def decode_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("b'"), F.col("label").cast("string"), F.lit("'")).alias("label"))
    return sources.decode_labels(e, "label").groupBy("label", "label_int").agg(F.count("*").alias("n"))


@query("s5_write_candidates", f"with {CELLS}, k as (select i, count(*) as n_cells, max(norm) as score from c group by i) select i, n_cells, round(score, 6) as score from k")
def write_candidates(spark, sf_dir):
    path = f"{shared_dir(spark)}/candidates-{uuid.uuid4().hex}"
    rows = event_cells(spark, sf_dir).groupBy("i").agg(F.count("*").alias("n_cells"), F.max("norm").alias("score"))
    sources.write_candidates(rows, path)
    return rounded(spark.read.schema("i int, n_cells long, score double").csv(path, header=True))


@query("s6_write_read_summary", f"with {CELLS} select {NX}::bigint as nx, {NY}::bigint as ny, count(*) as n_cells, sum(n)::bigint as n_points from c")
def summary(spark, sf_dir):
    path = f"{shared_dir(spark)}/summary-{uuid.uuid4().hex}"
    one = event_cells(spark, sf_dir).groupBy("nx", "ny").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_points"))
    sources.write_summary(one.select(F.lit("fixed").alias("mode"), F.struct("nx", "ny").alias("grid"), F.struct("n_cells", "n_points").alias("stats")), path)
    back = sources.read_summary(spark, path, "mode string, grid struct<nx: long, ny: long>, stats struct<n_cells: long, n_points: long>")
    return back.select("grid.nx", "grid.ny", "stats.n_cells", "stats.n_points")


# Preparation and grid suggestion

BOUNDS_SQL = ", ".join(f"round({c}, 6) as {c}" for c in ("x_min", "x_max", "y_min", "y_max"))


@query("p1_padded_bounds", f"with {P}, {binned_sql()} select {BOUNDS_SQL}, round(x_max - x_min, 6) as \"Lx\", round(y_max - y_min, 6) as \"Ly\" from b")
def padded_bounds(spark, sf_dir):
    return rounded(prepare.padded_bounds(event_points(spark, sf_dir)).select(*search.BOUNDS, "Lx", "Ly"))


@query("p2_standardize", f"with {P} select point_id, round((x - avg(x) over ()) / stddev_pop(x) over (), 5) + 0.0 as x, round((y - avg(y) over ()) / stddev_pop(y) over (), 5) + 0.0 as y from p")
def standardize(spark, sf_dir):
    return rounded(prepare.standardize(event_points(spark, sf_dir)).select("point_id", "x", "y"), 5)


@query("p3_minmax_scale", f"with {P} select point_id, round((x - min(x) over ()) / (max(x) over () - min(x) over () + 1e-12), 6) as x, round((y - min(y) over ()) / (max(y) over () - min(y) over () + 1e-12), 6) as y from p")
def minmax_scale(spark, sf_dir):
    return rounded(prepare.minmax_scale(event_points(spark, sf_dir)).select("point_id", "x", "y"))


KNN = """k as (select a.point_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, row_number() over (partition by a.point_id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as r from v a join v b on a.point_id <> b.point_id)"""


@query("p4_knn_spacing", f"with {V}, {KNN} select round(greatest(1e-12, median(d)), 6) as knn_h from k where r = 5")
def knn_spacing(spark, sf_dir):
    return rounded(prepare.knn_spacing(vector_points(spark, sf_dir), 5))


@query("p4_knn_spacing_events", f"with {P}, k as (select a.point_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 5)[5] as d from p a join p b on a.point_id <> b.point_id group by a.point_id) select round(greatest(1e-12, median(d)), 6) as knn_h from k")
def knn_spacing_events(spark, sf_dir):
    return rounded(prepare.knn_spacing(event_points(spark, sf_dir), 5))


OCC = """o0 as (select max(x) - min(x) as lx, max(y) - min(y) as ly, greatest(1, round_even(count(*) / 4.0, 0)) as cells from {s}), o1 as (select *, lx / (ly + 1e-12) as r from o0),
o2 as (select *, round_even(sqrt(cells / (r + 1e-12)), 0) as ny0 from o1), o3 as (select lx, ly, greatest(1, least(round_even(r * ny0, 0), 200)) as nx, greatest(1, least(ny0, 200)) as ny from o2), occ as (select sqrt((lx / nx) * (ly / ny)) as occ_h from o3)"""


@query("p5_occupancy_spacing", f"with {P}, {OCC.format(s='p')} select round(occ_h, 6) as occ_h from occ")
def occupancy_spacing(spark, sf_dir):
    return rounded(prepare.occupancy_spacing(event_points(spark, sf_dir)))


FD = "fd as (select sqrt(greatest(2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / (pow(count(*), 1.0 / 3) + 1e-12), 1e-12) * greatest(2 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / (pow(count(*), 1.0 / 3) + 1e-12), 1e-12)) as fd_h from {s})"


@query("p6_fd_spacing", f"with {P}, {FD.format(s='p')} select round(fd_h, 6) as fd_h from fd")
def fd_spacing(spark, sf_dir):
    return rounded(prepare.fd_spacing(event_points(spark, sf_dir)))


SEEDS = f"""{V}, {KNN}, kh as (select greatest(1e-12, median(d)) as knn_h from k where r = 5), {OCC.format(s="v")}, {FD.format(s="v")},
sd as (select (select max(x) - min(x) from v) as lx, (select max(y) - min(y) from v) as ly, ((select knn_h from kh) + (select occ_h from occ) + (select fd_h from fd)) / 3 as h0),
se as (select *, greatest(1, least(ceil(lx / h0), 200)) as nx0, greatest(1, least(ceil(ly / h0), 200)) as ny0 from sd), sf as (select *, greatest(lx / nx0, ly / ny0) as h_est from se)"""


@query("p7_suggest_grids", f"""with {SEEDS}, g as (select t as n, greatest(1e-12, least(case when t = 6 then 1.2::double * h_est else t * ((1.2::double * h_est - 0.8::double * h_est) / 6) + 0.8::double * h_est end, greatest(lx, ly))) as h, lx, ly from sf, range(7) r(t)),
g2 as (select n, greatest(1, least(ceil(lx / h), 200))::int as nx, greatest(1, least(ceil(ly / h), 200))::int as ny, lx, ly from g),
g3 as (select nx, ny, min(n) as n, max(greatest(lx / nx, ly / ny)) as h from g2 group by nx, ny) select (row_number() over (order by n) - 1)::int as cand_id, nx, ny, round(h, 6) as h from g3""")
def suggest_grids(spark, sf_dir):
    return rounded(prepare.suggest_grids(vector_points(spark, sf_dir)))


@query("p8_preselect_grid", f"""with {SEEDS}, q as (select greatest(0, least(floor((x - (select min(x) from v)) / (lx / nx0)), nx0 - 1))::int as i, greatest(0, least(floor((y - (select min(y) from v)) / (ly / ny0)), ny0 - 1))::int as j from v, sf), {NORM}
select (select nx0::int from sf) as nx, (select ny0::int from sf) as ny, i, j, n, round(norm, 6) as norm from c""")
def preselect_grid(spark, sf_dir):
    return rounded(prepare.preselect_grid(vector_points(spark, sf_dir)).select("nx", "ny", "i", "j", "n", "norm"))


# Cells


@query("g1_assign_cells", f"with {P}, {binned_sql()} select point_id, i, j from q")
def assign_cells(spark, sf_dir):
    return binned_events(spark, sf_dir).select("point_id", "i", "j")


SIZES = ((7.3, 7.3, 7.3), (9.7, 11.1, 13.9))


def box_sql(wrap: bool) -> str:
    count, at = ("ceil", "((floor({c} / {d})::bigint % {m}) + {m}) % {m}") if wrap else ("floor", "floor({c} / {d})::bigint")
    m = {a: f"{count}(50.0001 / d{a})::bigint" for a in "xyz"}
    cells = ", ".join(f"({at.format(c=a, d=f'd{a}', m=m[a])})::int as {a}i" for a in "xyz")
    return f"sz(size_id, dx, dy, dz) as (values (0, 7.3::double, 7.3::double, 7.3::double), (1, 9.7::double, 11.1::double, 13.9::double)), bx as (select a.*, size_id, dx, dy, dz, {', '.join(f'{m[a]}::int as m{a}' for a in 'xyz')}, {cells} from a, sz)"


BOXED = f"{A}, {box_sql(True)}, cm as (select step, size_id, any_value(dx) as dx, any_value(dy) as dy, any_value(dz) as dz, any_value(mx) as mx, any_value(my) as my, any_value(mz) as mz, xi, yi, zi, avg(c_label) as label_mean, count(*) as cn from bx group by step, size_id, xi, yi, zi)"


def boxed(spark, sf_dir, wrap=True, sizes=SIZES):
    a = snapshots(spark, sf_dir)
    return grid.box_cells(a, sources.snapshot_boxes(a), sizes, wrap)


@query("g2_assign_cells_periodic", f"with {A}, {box_sql(True)} select size_id, atom_id, xi, yi, zi from bx")
def assign_cells_periodic(spark, sf_dir):
    return boxed(spark, sf_dir).select("size_id", "atom_id", "xi", "yi", "zi")


@query("g2b_assign_cells_strict", f"with {A}, {box_sql(False)} select size_id, atom_id, xi, yi, zi from bx where xi < mx and yi < my and zi < mz")
def assign_cells_strict(spark, sf_dir):
    return boxed(spark, sf_dir, False).where("xi < mx and yi < my and zi < mz").select("size_id", "atom_id", "xi", "yi", "zi")


@query("g3_cell_counts", f"with {CELLS} select i, j, n from c")
def cell_counts(spark, sf_dir):
    return grid.cell_counts(binned_events(spark, sf_dir))


@query("g4_normalize_nonzero", f"with {CELLS} select i, j, n, round(norm, 6) as norm from c")
def normalize_nonzero(spark, sf_dir):
    return rounded(event_cells(spark, sf_dir).select("i", "j", "n", "norm"))


@query("g5_cell_means", f"with {BOXED} select step, size_id, xi, yi, zi, round(label_mean, 6) as label_mean, cn from cm")
def cell_means(spark, sf_dir):
    return rounded(grid.cell_means(boxed(spark, sf_dir)).select("step", "size_id", "xi", "yi", "zi", "label_mean", "cn"))


@query("g6_cell_geometry", f"with {CELLS} select i, j, round(x_min + i * (x_max - x_min) / {NX}, 5) as x0, round(y_min + (j + 1) * (y_max - y_min) / {NY}, 5) as y1, round(x_min + (i + 0.5) * (x_max - x_min) / {NX}, 5) as cx, round(y_min + (j + 0.5) * (y_max - y_min) / {NY}, 5) as cy from c, b")
def cell_geometry(spark, sf_dir):
    return rounded(grid.cell_geometry(event_cells(spark, sf_dir)).select("i", "j", "x0", "y1", "cx", "cy"), 5)


LATTICE = f"""{BOXED}, gr as (select distinct step, size_id, mx, my, mz from cm), la as (select step, size_id, x.v::int as xi, y.v::int as yi, z.v::int as zi from gr, range(100) x(v), range(100) y(v), range(100) z(v) where x.v < mx and y.v < my and z.v < mz),
lt as (select la.*, label_mean, coalesce(cn, 0) as cn from la left join cm using (step, size_id, xi, yi, zi))"""


@query("g7_full_lattice", f"with {LATTICE} select step, size_id, xi, yi, zi, round(label_mean, 6) as label_mean, cn from lt")
def full_lattice(spark, sf_dir):
    return rounded(grid.full_lattice(grid.cell_means(boxed(spark, sf_dir))).select("step", "size_id", "xi", "yi", "zi", "label_mean", "cn"))


DENSE = f"{CELLS}, d as (select * from c where norm >= 0.1)"
LABELS = f"{DENSE}, {components_sql('d', 'l')}"


def dense_labels(spark, sf_dir, thr=0.1, **kw):
    return labelling.cell_components(grid.dense_by_threshold(event_cells(spark, sf_dir), thr).where("dense"), widest=max(NX, NY), **kw)


@query("g8_label_points", f"with recursive {LABELS} select point_id, coalesce(label, -1) as label from q left join l on q.i = l.i and q.j = l.j")
def label_points(spark, sf_dir):
    return grid.label_points(binned_events(spark, sf_dir), dense_labels(spark, sf_dir)).select("point_id", "label")


NEAR_3D = "abs(s.xi - c.xi) + abs(s.yi - c.yi) + abs(s.zi - c.zi) = 1"
BIG = f"{BOXED}, h as (select *, step * 10 + size_id as run from cm where label_mean >= 0.55)"
CLUSTERS_3D = f"{BIG}, {components_sql('h', 'k3', NEAR_3D, '(xi * 1000 + yi) * 1000 + zi', 'run')}"


def clusters_3d(spark, sf_dir, **kw):
    return labelling.cell_components_3d(grid.select_cells_3d(grid.cell_means(boxed(spark, sf_dir)), 0.55), **kw)


@query("g9_cell_members", f"with recursive {CLUSTERS_3D} select step, size_id, label + 1 as cluster_id, count(*) as n_atoms, min(atom_id) as first_atom from bx join k3 using (step, size_id, xi, yi, zi) group by step, size_id, label")
def cell_members(spark, sf_dir):
    m = grid.cell_members(boxed(spark, sf_dir), clusters_3d(spark, sf_dir))
    return m.groupBy("step", "size_id", "cluster_id").agg(F.count("*").alias("n_atoms"), F.min("atom_id").alias("first_atom"))


# Which cells count


@query("m1_dense_by_threshold", f"with {CELLS} select i, j, norm >= 0.1 as dense from c")
def dense_by_threshold(spark, sf_dir):
    return grid.dense_by_threshold(event_cells(spark, sf_dir), 0.1).select("i", "j", "dense")


QUANTILES = (0.3, 0.5, 0.8)


@query("m2_dense_by_quantile", f"with {CELLS} select t.q, round(thr, 6) as thr, count(*) filter (norm >= thr - 1e-12) as n_dense from c, (select q::double as q, (select quantile_cont(norm, [0.3, 0.5, 0.8]) from c)[k] as thr from (values (0.3, 1), (0.5, 2), (0.8, 3)) v(q, k)) t group by t.q, thr")
def dense_by_quantile(spark, sf_dir):
    d = grid.dense_by_quantile(event_cells(spark, sf_dir), QUANTILES)
    return rounded(d.groupBy("q", "thr").agg(F.count_if("dense").alias("n_dense")))


@query("m3_dense_by_count", f"with {CELLS} select i, j, n >= 12 as dense, round(coalesce(min(norm) filter (n >= 12) over (), 0.3), 6) as thr from c")
def dense_by_count(spark, sf_dir):
    return rounded(grid.dense_by_count(event_cells(spark, sf_dir), 12).select("i", "j", "dense", "thr"))


@query("m4_classify_cells", f"with {CELLS} select case when norm >= 0.1 then 'dense' else 'sparse' end as cell_class, count(*) as n_cells, sum(n)::bigint as n_points from c group by 1")
def classify_cells(spark, sf_dir):
    c = grid.classify_cells(grid.dense_by_threshold(event_cells(spark, sf_dir), 0.1))
    return c.groupBy("cell_class").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_points"))


@query("m5_diffusion_weight_scale", f"""with {CELLS}, t as (select count(*) as m, count(*) filter (norm >= 0.1) as d from c), r as (select norm, row_number() over (order by norm) - 1 as k from c),
s as (select (1 - d::double / m) * (m - 1) as pos from t) select round(max(norm) filter (k = floor(pos)) + coalesce(max(norm) filter (k = floor(pos) + 1) - max(norm) filter (k = floor(pos)), 0) * (max(pos) - floor(max(pos))), 6) as scale from r, s""")
def diffusion_weight_scale(spark, sf_dir):
    return rounded(grid.diffusion_weight_scale(grid.dense_by_threshold(event_cells(spark, sf_dir), 0.1)))


def masked_sql(steps: int, beta: float, scale: float = 0.1) -> str:
    """The first steps of masked diffusion, one CTE each."""
    out = [f"f0 as (select i, j, norm, norm >= 0.1 as dense, least(greatest(norm / {scale}, 0), 1) as w, case when norm >= 0.1 then 1.0::double else 0.0::double end as c from c)"]
    for k in range(1, steps + 1):
        out.append(f"""f{k} as (select a.i, a.j, a.norm, a.dense, a.w, case when a.dense then 1.0::double else greatest(0, least(1, a.c + {beta} * a.w * (coalesce(sum(o.c), 0) - a.c *
  ((a.i > 0)::int + (a.i < {NX - 1})::int + (a.j > 0)::int + (a.j < {NY - 1})::int)))) end as c from f{k - 1} a left join f{k - 1} o on abs(o.i - a.i) + abs(o.j - a.j) = 1 group by a.i, a.j, a.norm, a.dense, a.w, a.c)""")
    return ", ".join(out)


def masked(spark, sf_dir, betas=(0.1,), **kw):
    c = grid.dense_by_threshold(event_cells(spark, sf_dir), 0.1).withColumn("scale", F.lit(0.1))
    return diffusion.diffuse_masked_2d(c, (), betas, widest=max(NX, NY), **kw)


@query("d1_diffuse_masked_2d", f"with {CELLS}, {masked_sql(4, 0.1)} select i, j, dense, round(c, 6) as c from f4")
def diffuse_masked_2d(spark, sf_dir):
    return rounded(masked(spark, sf_dir, max_iters=4)[0].select("i", "j", "dense", "c"))


def converged_sql(betas=(0.1,), limit: int = 1_500, scale: float = 0.1, cells: str = "c", thr: float = 0.1) -> str:
    """Masked diffusion to its stop: field (beta, i, j, norm, dense, c) and stats (beta, iters_used, max_delta_last, stop)."""
    rates = ", ".join(f"({b}::double)" for b in betas)
    return f"""st as (select beta, i, j, norm, norm >= {thr} as dense, least(greatest(norm / {scale}::double, 0), 1) as w, (i > 0)::int + (i < {NX - 1})::int + (j > 0)::int + (j < {NY - 1})::int as around from {cells}, (values {rates}) t(beta)),
fm(it, beta, i, j, norm, dense, w, around, c, d, most) as (select 0, beta, i, j, norm, dense, w, around, case when dense then 1.0::double else 0.0::double end, 0.0::double, 1.0::double from st
  union all select it + 1, beta, i, j, norm, dense, w, around, case when dense then 1.0::double else greatest(0, least(1, c + g)) end, case when dense then 0.0::double else abs(g) end, max(case when dense then 0.0::double else abs(g) end) over (partition by beta)
  from (select a.it, a.beta, a.i, a.j, a.norm, a.dense, a.w, a.around, a.c, a.beta * a.w * (coalesce(sum(o.c), 0) - a.c * a.around) as g
    from fm a left join (select beta, i + u as i, j + v as j, c from fm, (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(u, v)) o on o.beta = a.beta and o.i = a.i and o.j = a.j
    where a.it < {limit} and not (a.it >= 60 and a.it % 10 = 0 and a.most < 1e-6) group by a.it, a.beta, a.i, a.j, a.norm, a.dense, a.w, a.around, a.c) z),
ends as (select beta, max(it) as it from fm group by beta),
field as (select fm.* from fm join ends using (beta, it)),
stats as (select beta, it as iters_used, any_value(most) as max_delta_last, case when any_value(most) < 1e-6 then 'converged' else 'max_iters' end as stop from field group by beta, it)"""


@query("d1_diffuse_masked_2d_full", f"with recursive {CELLS}, {converged_sql()} select i, j, dense, round(c, 6) as c from field")
def diffuse_masked_2d_full(spark, sf_dir):
    return rounded(masked(spark, sf_dir)[0].select("i", "j", "dense", "c"))


@query("d1_diffuse_until_converged")
def diffuse_until_converged(spark, sf_dir):
    return rounded(masked(spark, sf_dir, (0.05, 0.2, 0.4))[1].select("beta", "iters_used", "max_delta_last", "stop"), 9)


@query("d1_diffuse_stops", f"with recursive {CELLS}, {converged_sql((0.05, 0.1, 0.2), 6_000)} select beta, iters_used, round(max_delta_last, 9) as max_delta_last, stop from stats")
def diffuse_stops(spark, sf_dir):
    """Where three rates that settle stop; the rate of 0.4 above goes on to the last step, which is too many for SQL."""
    return rounded(masked(spark, sf_dir, (0.05, 0.1, 0.2))[1].select("beta", "iters_used", "max_delta_last", "stop"), 9)


@query("m6_select_after_diffusion", f"with {CELLS}, {masked_sql(4, 0.1)} select i, j, dense or c > 0.05 as selected from f4")
def select_after_diffusion(spark, sf_dir):
    return grid.select_after_diffusion(masked(spark, sf_dir, max_iters=4)[0], 0.05).select("i", "j", "selected")


@query("m6_select_after_diffusion_full", f"with recursive {CELLS}, {converged_sql()} select i, j, dense or c > 0.05 as selected from field")
def select_after_diffusion_full(spark, sf_dir):
    return grid.select_after_diffusion(masked(spark, sf_dir)[0], 0.05).select("i", "j", "selected")


@query("m7_select_cells_3d", f"with {BOXED} select step, size_id, xi, yi, zi from cm where label_mean >= 0.55")
def select_cells_3d(spark, sf_dir):
    return grid.select_cells_3d(grid.cell_means(boxed(spark, sf_dir)), 0.55).select("step", "size_id", "xi", "yi", "zi")


def lattice_sql(steps: int, known: bool) -> str:
    """The first steps of diffusion on the periodic lattice of the second cell size."""
    out = ["f0 as (select step, xi, yi, zi, cn, coalesce(label_mean, 0) as v, coalesce(label_mean, 0) as c from lt where size_id = 1)"]
    near = [("mx", "xi"), ("my", "yi"), ("mz", "zi")]
    dims = {"mx": 6, "my": 5, "mz": 4}
    for k in range(1, steps + 1):
        joins, terms = [], []
        for n, (m, a) in enumerate(near):
            for sign in (1, -1):
                t = f"t{n}{'p' if sign > 0 else 'm'}"
                on = " and ".join(f"{t}.{b} = (a.{b} + {sign} + {dims[m]}) % {dims[m]}" if b == a else f"{t}.{b} = a.{b}" for _, b in near)
                joins.append(f"join f{k - 1} {t} on {t}.step = a.step and {on}")
                terms.append(f"{t}.c")
        new = f"a.c + 0.1 * ({' + '.join(terms)} - 6 * a.c)"
        new = f"case when a.cn > 0 then a.v else {new} end" if known else f"greatest(0, least(1, {new}))"
        out.append(f"f{k} as (select a.step, a.xi, a.yi, a.zi, a.cn, a.v, {new} as c from f{k - 1} a {' '.join(joins)})")
    return ", ".join(out)


def steps_sql(steps: int, known: bool) -> str:
    """Diffusion on the periodic lattices of all sizes, step by step, as CTE ``fs``."""
    new = "a.c + 0.1 * (sum(o.c) - 6 * a.c)"
    new = f"case when a.cn > 0 then a.v else {new} end" if known else f"greatest(0, least(1, {new}))"
    return f"""ms as (select distinct step, size_id, mx, my, mz from cm), fs(it, step, size_id, xi, yi, zi, mx, my, mz, cn, v, c) as (select 0, step, size_id, xi, yi, zi, mx, my, mz, cn, coalesce(label_mean, 0), coalesce(label_mean, 0) from lt join ms using (step, size_id)
  union all select a.it + 1, a.step, a.size_id, a.xi, a.yi, a.zi, a.mx, a.my, a.mz, a.cn, a.v, {new} from fs a join (select step, size_id, (xi + du + mx) % mx as xi, (yi + dv + my) % my as yi, (zi + dw + mz) % mz as zi, c
      from fs, (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(du, dv, dw)) o using (step, size_id, xi, yi, zi) where a.it < {steps} group by a.it, a.step, a.size_id, a.xi, a.yi, a.zi, a.mx, a.my, a.mz, a.cn, a.v, a.c)"""


@query("d2_diffuse_free_3d", f"with {LATTICE}, {lattice_sql(3, False)} select step, xi, yi, zi, round(c, 6) as c from f3 where cn > 0")
def diffuse_free_3d(spark, sf_dir):
    c = grid.cell_means(boxed(spark, sf_dir)).where("size_id = 1")
    return rounded(diffusion.diffuse_free_3d(c, iters=3).select("step", "xi", "yi", "zi", "c"))


@query("d2_diffuse_free_3d_full", f"with recursive {LATTICE}, {steps_sql(500, False)} select step, size_id, xi, yi, zi, round(c, 6) as c from fs where it = 500 and cn > 0")
def diffuse_free_3d_full(spark, sf_dir):
    c = grid.cell_means(boxed(spark, sf_dir))
    return rounded(diffusion.diffuse_free_3d(c).select("step", "size_id", "xi", "yi", "zi", "c"))


@query("d2_diffuse_free_3d_tiled", f"with recursive {LATTICE}, {steps_sql(40, False)} select step, size_id, xi, yi, zi, round(c, 6) as c from fs where it = 40 and cn > 0")
def diffuse_free_3d_tiled(spark, sf_dir):
    """The first steps on finer lattices' terms: every lattice goes tile by tile."""
    c = grid.cell_means(boxed(spark, sf_dir))
    return rounded(diffusion.diffuse_free_3d(c, iters=40, whole=0).select("step", "size_id", "xi", "yi", "zi", "c"))


KNOWN = LATTICE.replace("from bx group by", "from bx where c_label >= 0.8 group by")


@query("d3_impute_3d", f"with {KNOWN}, {lattice_sql(3, True)} select step, xi, yi, zi, round(c, 6) as c from f3")
def impute_3d(spark, sf_dir):
    c = grid.full_lattice(grid.cell_means(boxed(spark, sf_dir).where("c_label >= 0.8")).where("size_id = 1"))
    return rounded(diffusion.impute_3d(c, iters=3).select("step", "xi", "yi", "zi", "c"))


@query("d3_impute_3d_full", f"with recursive {KNOWN}, {steps_sql(500, True)} select step, size_id, xi, yi, zi, round(c, 6) as c from fs where it = 500")
def impute_3d_full(spark, sf_dir):
    c = grid.full_lattice(grid.cell_means(boxed(spark, sf_dir).where("c_label >= 0.8")))
    return rounded(diffusion.impute_3d(c).select("step", "size_id", "xi", "yi", "zi", "c"))


# Components


@query("c1_cell_components", f"with recursive {LABELS} select i, j, label from l")
def cell_components(spark, sf_dir):
    return dense_labels(spark, sf_dir)


WRAPPED = f"(abs(s.i - c.i) in (0, 1, {NX - 1}) and abs(s.j - c.j) in (0, 1, {NY - 1}))"


@query("c1_cell_components_8_wrapped", f"with recursive {DENSE}, {components_sql('d', 'l', WRAPPED)} select i, j, label from l")
def cell_components_wrapped(spark, sf_dir):
    return dense_labels(spark, sf_dir, connectivity=8, periodic=True, tile=8)


def grown_sql(chosen: str) -> str:
    """Labels grown from dense cells over cells of ``chosen`` (i, j, dense, selected), as CTE ``gr``: raster sweeps one cell at a time."""
    return f"""{components_sql(f"(select i, j from {chosen} where dense)", "seed")},
spot as (select i * {NY} + j as pos, c.dense, coalesce(seed.label, -1) as label from {chosen} c left join seed using (i, j) where c.dense or c.selected),
todo as (select coalesce(list(pos order by pos), []) as todo, count(*) as m from spot where label < 0),
start as (select list(coalesce(label, -1) order by p) as lab from range({NX * NY}) t(p) left join spot on pos = p),
gs(k, changed, lab) as (select case when m > 0 then 1 else 0 end, false, lab from start, todo
  union all select case when k < m then k + 1 when changed or hit then 1 else 0 end, case when k < m then changed or hit else false end, case when hit then lab[:pos] || [near[1]] || lab[pos + 2:] else lab end
  from (select k, m, changed, lab, pos, near, len(near) = 1 and lab[pos + 1] < 0 as hit from (select k, m, changed, lab, pos, list_distinct(list_filter([case when pos // {NY} > 0 then lab[pos + 1 - {NY}] end, case when pos // {NY} < {NX - 1} then lab[pos + 1 + {NY}] end, case when pos % {NY} > 0 then lab[pos] end, case when pos % {NY} < {NY - 1} then lab[pos + 2] end], lambda x: x >= 0)) as near
    from (select k, m, changed, lab, todo[k] as pos from gs, todo where k > 0) z1) z2) z3),
gr as (select (pos // {NY})::int as i, (pos % {NY})::int as j, lab[pos + 1]::int as label from spot, (select lab from gs where k = 0) z)"""


@query("c2_seeded_components", f"with recursive {CELLS}, {converged_sql()}, ch as (select i, j, dense, dense or c > 0.05 as selected from field), {grown_sql('ch')} select * from gr")
def seeded_components(spark, sf_dir):
    c = cut(grid.select_after_diffusion(masked(spark, sf_dir)[0], 0.05))
    return labelling.seeded_components(c, widest=max(NX, NY)).select("i", "j", "label")


@query("c3_cell_components_3d", f"with recursive {CLUSTERS_3D} select step, size_id, xi, yi, zi, label + 1 as cluster_id from k3")
def cell_components_3d(spark, sf_dir):
    return clusters_3d(spark, sf_dir).select("step", "size_id", "xi", "yi", "zi", "cluster_id")


@query("c3b_cell_components_by_size", f"""with recursive {CLUSTERS_3D}, sz2 as (select run, root, count(*) as size from k3 group by run, root having count(*) > 1),
ids as (select run, root, (row_number() over (partition by run order by size desc, root) - 1)::int as cluster_id from sz2) select step, size_id, xi, yi, zi, cluster_id from k3 join ids using (run, root)""")
def cell_components_by_size(spark, sf_dir):
    return clusters_3d(spark, sf_dir, by_size=True, drop_singletons=True).select("step", "size_id", "xi", "yi", "zi", "cluster_id")


PAIRS = f"{W}, pr as (select a.atom_id as src, b.atom_id as dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from w a join w b on a.atom_id < b.atom_id where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.03 ** 2)"


@query("c4_radius_pairs", f"with {PAIRS} select src, dst, round(d, 6) as distance from pr")
def radius_pairs(spark, sf_dir):
    return rounded(neighbors.radius_pairs(vector_atoms(spark, sf_dir), 0.03, ["step"]).drop("step"))


@query("c5_components", f"with recursive {PAIRS}, e as (select src, dst from pr union all select dst, src from pr), r(a, b) as (select distinct src, src from e union select r.a, e.dst from r join e on e.src = r.b) select a as vertex, min(b) as root from r group by a")
def graph_components(spark, sf_dir):
    return components(neighbors.radius_pairs(vector_atoms(spark, sf_dir), 0.03, ["step"])).select("vertex", "root")


ATOMS = f"""{W}, w2 as (select * from w where c_label >= 0.3), pr as (select a.atom_id as src, b.atom_id as dst from w2 a join w2 b on a.atom_id <> b.atom_id where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.05 ** 2),
r(a, b) as (select atom_id, atom_id from w2 union select r.a, pr.dst from r join pr on pr.src = r.b), m as (select a as atom_id, min(b) as root from r group by a), lab as (select atom_id, dense_rank() over (order by root)::int as label from m)"""


@query("c6_atom_components", f"with recursive {ATOMS} select w.atom_id, coalesce(label, 0) as label from w left join lab using (atom_id)")
def atom_components(spark, sf_dir):
    return labelling.atom_components(vector_atoms(spark, sf_dir), cutoff=0.05, thr=0.3).drop("step")


LINE_ATOMS = f"""{A}, w2 as (select *, round(z)::int as zi from a where c_label >= 0.5), pr as (select a.atom_id as src, b.atom_id as dst from w2 a join (select *, x + o as nx from w2, (values (-1), (0), (1)) t(o)) b on a.step = b.step and a.zi = b.zi and a.x = b.nx and a.atom_id <> b.atom_id
    where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 2.25),
r(a, b) as (select atom_id, atom_id from w2 union select r.a, pr.dst from r join pr on pr.src = r.b), m as (select a as atom_id, min(b) as root from r group by a),
lab as (select step, atom_id, dense_rank() over (partition by step order by root)::int as label from m join w2 using (atom_id))"""


@query("c6_atom_components_lineitem", f"with recursive {LINE_ATOMS} select a.step, a.atom_id, coalesce(label, 0) as label from a left join lab using (step, atom_id)")
def atom_components_lineitem(spark, sf_dir):
    return labelling.atom_components(snapshots(spark, sf_dir), cutoff=1.5, thr=0.5)


@query("c7_cluster_members", f"with recursive {ATOMS}, n as (select *, (row_number() over (partition by label order by atom_id) - 1) // 50 as chunk from lab) select label, chunk::int as chunk, string_agg(atom_id::varchar, ',' order by atom_id) as members from n group by label, chunk")
def cluster_members(spark, sf_dir):
    a = labelling.atom_components(vector_atoms(spark, sf_dir), cutoff=0.05, thr=0.3).where("label > 0")
    m = labelling.cluster_members(a, ["label"], ["atom_id"], chunk=50)
    return m.select("label", "chunk", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


LABELLED = f"{LABELS}, y as (select point_id, x, y, truth, coalesce(label, -1) as label from q left join l on q.i = l.i and q.j = l.j)"


def labelled_events(spark, sf_dir):
    return grid.label_points(binned_events(spark, sf_dir), dense_labels(spark, sf_dir)).select("point_id", "x", "y", "truth", "label")


@query("c8_cluster_sizes", f"with recursive {LABELLED} select label, count(*) as size, case when label <> -1 then (row_number() over (partition by label <> -1 order by count(*) desc, label))::int end as size_rank from y group by label")
def cluster_sizes(spark, sf_dir):
    return labelling.cluster_sizes(labelled_events(spark, sf_dir))


# Metrics


@query("q1_coverage_k", f"with recursive {LABELLED} select round(avg((label >= 0)::int), 6) as coverage, count(distinct label) filter (label >= 0) as k from y")
def coverage_k(spark, sf_dir):
    return rounded(metrics.coverage_k(labelled_events(spark, sf_dir)).select("coverage", "k"))


def labelled_vectors(spark, sf_dir):
    return vector_points(spark, sf_dir).withColumn("label", F.col("truth") - 1)


SIL = f"""with {V}, u as (select point_id, x, y, truth - 1 as label from v where truth > 0), d as (select a.point_id, a.label, b.label as other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as total, count(*) as m from u a join u b on true group by 1, 2, 3),
s as (select point_id, max(m) filter (label = other) as size, max(total / nullif(m - 1, 0)) filter (label = other) as a, min(total / m) filter (label <> other) as b from d group by point_id)
select round(avg(case when size = 1 then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end), 6) as silhouette from s"""


@query("q2_silhouette", SIL)
def silhouette(spark, sf_dir):
    return rounded(metrics.silhouette(labelled_vectors(spark, sf_dir)))


DBI = """ce as (select label, avg(x) as cx, avg(y) as cy from y where label >= 0 group by label), sc as (select label, any_value(cx) as cx, any_value(cy) as cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) as s from y join ce using (label) group by label),
wo as (select a.label, max(case when (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 > 0 then (a.s + b.s) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) else 0 end) as worst from sc a join sc b on a.label <> b.label group by a.label), db as (select avg(worst) as dbi from wo)"""


@query("q3_davies_bouldin", f"with recursive {LABELLED}, {DBI} select round(dbi, 6) as dbi from db")
def davies_bouldin(spark, sf_dir):
    return rounded(metrics.davies_bouldin(labelled_events(spark, sf_dir)))


@query("q4_score_partition", f"with recursive {LABELLED}, {DBI} select 0.0::double as sil, round(dbi, 6) as dbi, round(avg((label >= 0)::int), 6) as cov, count(distinct label) filter (label >= 0) as k, round(0.8 / (1 + dbi) + 0.15 * avg((label >= 0)::int), 6) as score from y, db group by dbi")
def score_partition(spark, sf_dir):
    return rounded(metrics.score_partition(labelled_events(spark, sf_dir)))


@query("q5_contingency", f"with recursive {LABELLED} select truth, label, count(*) as n from y group by truth, label")
def contingency(spark, sf_dir):
    return metrics.contingency(labelled_events(spark, sf_dir))


EXTERNAL = f"""with recursive {LABELLED}, ct as (select truth, label, count(*)::double as n from y group by 1, 2), t as (select truth, sum(n) as n from ct group by 1), pl as (select label, sum(n) as n from ct group by 1),
z as (select (select sum(n) from ct) as m, (select sum(n * n) from ct) as sq, (select sum(n * n) from t) as tsq, (select sum(n * n) from pl) as psq),
zz as (select m, sq - m as tp, psq - sq as fp, tsq - sq as fn, m * m - psq - tsq + sq as tn from z),
e as (select -sum(n / m * ln(n / m)) as ht from t, z), f as (select -sum(n / m * ln(n / m)) as hp from pl, z), g as (select sum(ct.n / m * ln(ct.n * m / (t.n * pl.n))) as mi from ct join t using (truth) join pl using (label), z)
select round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) as ari, round(mi / ((ht + hp) / 2), 6) as nmi, round(mi / ((ht + hp) / 2), 6) as v_measure, round(tp / sqrt((tp + fp) * (tp + fn)), 6) as fm from zz, e, f, g"""


@query("q6_external_scores", EXTERNAL)
def external_scores(spark, sf_dir):
    return rounded(metrics.external_scores(metrics.contingency(labelled_events(spark, sf_dir))))


@query("q7_purity", f"with recursive {LABELLED}, ct as (select truth, label, count(*) as n from y group by 1, 2), mx as (select label, max(n) as top from ct where label >= 0 group by label) select round(sum(top) / (select sum(n) from ct), 6) as purity from mx")
def purity(spark, sf_dir):
    return rounded(metrics.purity(metrics.contingency(labelled_events(spark, sf_dir))))


def report_sql(source: str, key: str, reported: str = "phase") -> str:
    """All scores of labelled points (key, point_id, x, y, truth, label) by key, silhouette included, as CTE ``rep``."""
    k = key
    return f"""n0 as (select {k}, count(*)::double as m, avg((label >= 0)::int) as coverage, count(distinct label) filter (label >= 0) as k from {source} group by {k}),
ce as (select {k}, label, avg(x) as cx, avg(y) as cy from {source} where label >= 0 group by {k}, label), sc as (select {k}, label, any_value(cx) as cx, any_value(cy) as cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) as s from {source} join ce using ({k}, label) group by {k}, label),
wo as (select a.{k}, a.label, max(case when (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 > 0 then (a.s + b.s) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) else 0 end) as worst from sc a join sc b on a.{k} = b.{k} and a.label <> b.label group by a.{k}, a.label), db as (select {k}, avg(worst) as dbi from wo group by {k}),
sd as (select a.{k}, a.point_id, a.label, b.label as other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as total, count(*) as m from {source} a join {source} b on a.{k} = b.{k} where a.label >= 0 and b.label >= 0 group by 1, 2, 3, 4),
sp as (select {k}, point_id, max(m) filter (label = other) as size, max(total / nullif(m - 1, 0)) filter (label = other) as a, min(total / m) filter (label <> other) as b from sd group by 1, 2),
si as (select {k}, avg(case when size = 1 then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end) as silhouette from sp group by {k}),
ct as (select {k}, truth, label, count(*)::double as n from {source} group by 1, 2, 3), tt as (select {k}, truth, sum(n) as n from ct group by 1, 2), tl as (select {k}, label, sum(n) as n from ct group by 1, 2),
z0 as (select {k}, sum(n * n) as sq from ct group by 1), z1 as (select {k}, sum(n * n) as tsq, -sum(n / m * ln(n / m)) as ht from tt join n0 using ({k}) group by 1), z2 as (select {k}, sum(n * n) as psq, -sum(n / m * ln(n / m)) as hp from tl join n0 using ({k}) group by 1),
mi as (select ct.{k}, sum(ct.n / m * ln(ct.n * m / (tt.n * tl.n))) as mi from ct join tt using ({k}, truth) join tl using ({k}, label) join n0 using ({k}) group by 1),
pu as (select {k}, sum(top) as top from (select {k}, label, max(n) as top from ct where label >= 0 group by 1, 2) group by 1),
zz as (select {k}, sq - m as tp, psq - sq as fp, tsq - sq as fn, m * m - psq - tsq + sq as tn from z0 join z1 using ({k}) join z2 using ({k}) join n0 using ({k})),
rep as (select {k} as {reported}, round(coverage, 6) as coverage, k, round(dbi, 6) as dbi, round(silhouette, 6) as silhouette, round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) as ari,
  round(greatest(mi, 0) / ((ht + hp) / 2), 6) as nmi, round(greatest(mi, 0) / ((ht + hp) / 2), 6) as v_measure, round(tp / sqrt((tp + fp) * (tp + fn)), 6) as fm, round(top / m, 6) as purity
  from n0 join db using ({k}) join si using ({k}) join zz using ({k}) join z1 using ({k}) join z2 using ({k}) join mi using ({k}) join pu using ({k}))"""


@query("q8_cluster_report", f"with {V}, y as (select 'before' as phase, point_id, x, y, truth, truth - 1 as label from v union all select 'after', point_id, x, y, truth, (truth - 1) % 2 from v), {report_sql('y', 'phase')} select * from rep")
def cluster_report(spark, sf_dir):
    p = labelled_vectors(spark, sf_dir)
    return rounded(metrics.cluster_report(p.withColumn("phase", F.lit("before")).unionByName(p.withColumn("phase", F.lit("after")).withColumn("label", F.col("label") % 2))))


# Sweeps and whole runs


@query("r4_normalize_weights", "with w as (select label::int as id, label::double - 1 as w_sil, 0.3::double as w_dbi, label / 10.0::double as w_cov from (select distinct label from embeddings)), c as (select id, greatest(0, least(1, w_sil)) as a, greatest(0, least(1, w_dbi)) as b, greatest(0, least(1, w_cov)) as c from w) select id, round(a / (a + b + c), 6) as w_sil, round(b / (a + b + c), 6) as w_dbi, round(c / (a + b + c), 6) as w_cov from c")
def normalize_weights(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("id")).distinct()
    d = d.select("id", (F.col("id").cast("double") - 1).alias("w_sil"), F.lit(0.3).alias("w_dbi"), (F.col("id") / 10.0).alias("w_cov"))
    return rounded(search.normalize_weights(d))


@query("r6_best_candidate", f"with {CELLS} select i, j, n from (select *, row_number() over (partition by i order by n desc, j) as r from c) where r = 1")
def best_candidate(spark, sf_dir):
    return search.best_candidate(grid.cell_counts(binned_events(spark, sf_dir)), ["i"], "n", "j")


GRIDS = ((30, 20), (24, 16), (40, 25))


def stage_a_sql(cand: int, nx: int, ny: int, quantiles, where: str = "true") -> str:
    """Scores of one grid at some quantiles: dense cells, components, labelled points, their centres and distances."""
    qs = ", ".join(f"({q}::double, {n})" for n, q in enumerate(quantiles))
    code = f"i * {ny} + j"
    return f"""(with recursive {P}, pf as (select * from p where {where}), {binned_sql(nx, ny, "pf")}, {NORM}, th as (select dense_q, qn, (select quantile_cont(norm, {list(quantiles)}) from c)[qn + 1] as dense_thr from (values {qs}) t(dense_q, qn)),
d as (select qn, i, j from c, th where norm >= dense_thr), {components_sql("d", "l", code=code, key="qn")},
y as (select qn, x, y, label from q join l using (i, j)), ce as (select qn, label, avg(x) as cx, avg(y) as cy from y group by 1, 2), sc as (select qn, label, any_value(cx) as cx, any_value(cy) as cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) as s, count(*) as m from y join ce using (qn, label) group by 1, 2),
wo as (select a.qn, a.label, max(case when (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 > 0 then (a.s + b.s) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) else 0 end) as worst from sc a join sc b on a.qn = b.qn and a.label <> b.label group by 1, 2),
db as (select qn, avg(worst) as dbi from wo group by 1), kk as (select qn, count(*) as k, sum(m)::double / (select count(*) from q) as cov from sc group by 1)
select ({cand} * {len(quantiles)} + qn)::int as ordinal, {cand} as cand_id, {nx} as nx, {ny} as ny, dense_q, dense_thr, 0.0::double as sil, case when k >= 2 then dbi else 'inf'::double end as dbi, cov, case when k >= 2 then k else 0 end as k,
  case when k >= 2 then 0.8 / (1 + dbi) + 0.15 * cov else '-inf'::double end as score from kk join th using (qn) left join db using (qn))"""


ROUNDED_A = "ordinal, cand_id, nx, ny, dense_q, round(dense_thr, 6) as dense_thr, sil, round(dbi, 6) as dbi, round(cov, 6) as cov, k, round(score, 6) as score"


@query("r1_stage_a_grid", f"select {ROUNDED_A} from ({' union all '.join(stage_a_sql(n, nx, ny, QUANTILES) for n, (nx, ny) in enumerate(GRIDS))}) z")
def stage_a_grid(spark, sf_dir):
    g = spark.createDataFrame([(n, *g) for n, g in enumerate(GRIDS)], "cand_id int, nx int, ny int")
    return rounded(search.stage_a_grid(event_points(spark, sf_dir), g, QUANTILES))


TRIED = ((0.5, 3), (8, 3), (8, 1000), (16, 5))


def stage_a_eval_sql(cand: int, part: float, r: int) -> str:
    """One candidate of the second kind (cell width, least count) on the labelled vectors."""
    return f"""(with recursive {V}, b as (select min(x) - 1e-9 * (max(x) - min(x) + 1) as x_min, max(x) + 1e-9 * (max(x) - min(x) + 1) as x_max, min(y) - 1e-9 * (max(y) - min(y) + 1) as y_min, max(y) + 1e-9 * (max(y) - min(y) + 1) as y_max from v),
g as (select *, (x_max - x_min) / {part}::double as h from b), gg as (select *, greatest(1, least(ceil((x_max - x_min) / h), 200))::int as nx, greatest(1, least(ceil((y_max - y_min) / h), 200))::int as ny from g),
q as (select x, y, greatest(0, least(floor((x - x_min) / ((x_max - x_min) / nx)), nx - 1))::int as i, greatest(0, least(floor((y - y_min) / ((y_max - y_min) / ny)), ny - 1))::int as j from v, gg), cn as (select i, j, count(*) as n from q group by 1, 2),
d as (select i, j from cn where n >= {r}), {components_sql("d", "l", code="i * 1000 + j")}, y as (select x, y, label from q join l using (i, j)), {DBI}, kk as (select count(distinct label) as k, count(*)::double / (select count(*) from v) as cov from y),
t as (select gg.h, nx, ny, nx * ny < 2 as few, (select count(*) from d) as dense, k, cov, dbi from gg, kk, db)
select {cand} as cand_id, round(h, 6) as h, {r} as r, 0.0::double as w_sil, 0.8::double as w_dbi, 0.2::double as w_cov, nx, ny, case when few then null else 0.0::double end as sil, case when few then null when k >= 2 then round(dbi, 6) else 'inf'::double end as dbi, case when few then null else round(cov, 6) end as cov,
  case when few then null when k >= 2 then k else 0 end as k, case when not few and k >= 2 then round(0.8 / (1 + dbi) + 0.2 * cov, 6) end as score, case when few then 'too-few-cells' when dense < 1 then 'no-dense' when k < 2 then 'bad-score' else 'ok' end as reason from t)"""


@query("r2_stage_a_eval", " union all ".join(stage_a_eval_sql(n, d, r) for n, (d, r) in enumerate(TRIED)))
def stage_a_eval(spark, sf_dir):
    box = prepare.padded_bounds(vector_points(spark, sf_dir)).first()
    rows = [(n, box["Lx"] / d, r, 0.0, 0.8, 0.2) for n, (d, r) in enumerate(TRIED)]
    return rounded(search.stage_a_eval(vector_points(spark, sf_dir), spark.createDataFrame(rows, "cand_id int, h double, r int, w_sil double, w_dbi double, w_cov double")))


@query("r3_stage_a_search")
def stage_a_search(spark, sf_dir):
    p = vector_points(spark, sf_dir)
    return rounded(search.stage_a_search(p, cut(prepare.spacing_seeds(p)), draws=8))


def stage_b_sql(ordinal: int, beta: float, cthr: float) -> str:
    """One rate and threshold: diffusion to its stop, growth, labelled points scored."""
    return f"""(with recursive {CELLS}, {converged_sql((beta,), 6_000)}, ch as (select i, j, dense, dense or c > {cthr} as selected from field), {grown_sql('ch')}, y as (select x, y, label from q join gr using (i, j) where label >= 0), {DBI},
kk as (select count(distinct label) as k, count(*)::double / (select count(*) from q) as cov from y) select {beta}::double as beta, {cthr}::double as cthr, 0.0::double as sil, case when k >= 2 then round(dbi, 6) else 'inf'::double end as dbi, round(cov, 6) as cov, case when k >= 2 then k else 0 end as k,
  case when k >= 2 then round(0.8 / (1 + dbi) + 0.15 * cov, 6) else '-inf'::double end as score, iters_used, stop, {ordinal} as ordinal from kk, db, stats)"""


BETAS, CTHRS = (0.05, 0.1), (0.05, 0.1, 0.2)


@query("r5_stage_b_sweep", " union all ".join(stage_b_sql(len(CTHRS) * n + m, b, c) for n, b in enumerate(BETAS) for m, c in enumerate(CTHRS)))
def stage_b_sweep(spark, sf_dir):
    c = cut(grid.dense_by_threshold(event_cells(spark, sf_dir), 0.1).withColumn("scale", F.lit(0.1)))
    return rounded(search.stage_b_sweep(binned_events(spark, sf_dir), c, BETAS, CTHRS)[0])


RUN = f"""{CELLS}, {converged_sql()}, ch as (select i, j, dense, dense or c > 0.1 as selected from field), {grown_sql('ch')}, {components_sql('(select i, j from ch where selected)', 'sl')},
ph as (select 'before' as phase, i, j, label from seed union all select 'after_std', i, j, label from sl union all select 'after_seeded', i, j, label from gr)"""


@query("r7_run_fixed_2d", f"with recursive {RUN} select phase, coalesce(label, -1) as label, count(*) as n from (select * from q, (values ('before'), ('after_std'), ('after_seeded')) t(phase)) z left join ph using (phase, i, j) group by 1, 2")
def run_fixed_2d(spark, sf_dir):
    labelled = pipeline.run_fixed_2d(event_points(spark, sf_dir), NX, NY, 0.1, 0.1, dense_thr=0.1)[0]
    return labelled.groupBy("phase", "label").agg(F.count("*").alias("n"))


@query("r8_run_tuned_2d")
def run_tuned_2d(spark, sf_dir):
    out = pipeline.run_tuned_2d(vector_points(spark, sf_dir), pipeline.Tuning(quantiles=(0.3, 0.6), betas=(0.1,), cthrs=(0.1, 0.15)))
    return rounded(out["report"])


SWEEP_GRIDS, SWEEP_Q = ((20, 10), (16, 8)), (0.3, 0.6)


def dataset_points(spark, sf_dir):
    return event_points(spark, sf_dir).withColumnRenamed("truth", "dataset")


def sweep_grids(spark):
    return spark.createDataFrame([(n, *g) for n, g in enumerate(SWEEP_GRIDS)], "cand_id int, nx int, ny int")


#: The kinds of events, for SQL, which can't go through them by itself (fixed values).
KINDS = ("click", "error", "purchase", "signup", "view")
SWEPT_SQL = " union all ".join(f"select '{d}' as dataset, * from {stage_a_sql(n, nx, ny, SWEEP_Q, chr(39).join(('truth = ', d, '')))} z{n}" for d in KINDS for n, (nx, ny) in enumerate(SWEEP_GRIDS))


@query("r9_dataset_sweep", f"select dataset, 'grid' as strategy, nx, ny, round(dense_thr, 6) as dense_thr, null::int as r, sil, round(dbi, 6) as dbi, round(cov, 6) as cov, k, round(score, 6) as score from (select *, row_number() over (partition by dataset order by score desc, ordinal) as place from ({SWEPT_SQL}) s) b where place = 1")
def dataset_sweep(spark, sf_dir):
    return rounded(pipeline.dataset_sweep(dataset_points(spark, sf_dir), sweep_grids(spark), SWEEP_Q, strategies=["grid"]))


@query("r9_dataset_sweep_search")
def dataset_sweep_search(spark, sf_dir):
    return rounded(pipeline.dataset_sweep(dataset_points(spark, sf_dir), sweep_grids(spark), SWEEP_Q, strategies=["search"], search={"draws": 4, "rounds": 1}))


STEPPED = f"""{LATTICE}, {steps_sql(500, False)}, vv as (select step, size_id, xi, yi, zi, 'raw' as diffusion, label_mean as v from cm union all select step, size_id, xi, yi, zi, 'diffused', c from fs where it = 500 and cn > 0),
hs as (select step, size_id, xi, yi, zi, diffusion, c_thr, step * 100 + size_id * 10 + (c_thr = 0.55)::int * 2 + (diffusion = 'raw')::int as run from vv, (values (0.5::double), (0.55::double)) t(c_thr) where v >= c_thr)"""


@query("r10_sweep_3d", f"with recursive {STEPPED}, {components_sql('hs', 'ks', NEAR_3D, '(xi * 1000 + yi) * 1000 + zi', 'run')} select step, size_id, c_thr, diffusion, count(*) as n_selected, count(distinct label) as n_clusters from ks group by all")
def sweep_3d(spark, sf_dir):
    a = snapshots(spark, sf_dir)
    return search.sweep_3d(a, sources.snapshot_boxes(a), SIZES, (0.5, 0.55))


# Grid against atoms


def grid_and_atoms(spark, sf_dir):
    """Vector atoms with grid_id (their coarse cell, by component label) and atom_label (their class); 0 is background."""
    a = vector_atoms(spark, sf_dir)
    side = lambda c: F.when(F.col(c) > 0.06, 2).when(F.col(c) > -0.06, 1).otherwise(0)
    return a.select("step", "atom_id", (side("x") * 3 + side("y")).alias("grid_id"), F.round(F.col("c_label") * 10 - 1).cast("int").alias("atom_label"))


GA = f"{W}, ga as (select step, atom_id, (case when x > 0.06 then 2 when x > -0.06 then 1 else 0 end) * 3 + (case when y > 0.06 then 2 when y > -0.06 then 1 else 0 end) as grid_id, round(c_label * 10 - 1)::int as atom_label from w)"
JACCARD = """jg as (select grid_id, count(*) as g from ga where grid_id <> {b} group by 1), ja as (select atom_label, count(*) as a from ga where atom_label <> {b} group by 1), jb as (select grid_id, atom_label, count(*) as n from ga group by 1, 2),
jj as (select grid_id, atom_label, coalesce(n, 0)::double / (g + a - coalesce(n, 0)) as j from jg cross join ja left join jb using (grid_id, atom_label)), jr as (select *, row_number() over (partition by grid_id order by j desc, atom_label) as r from jj)"""


@query("x1_match_by_overlap", f"with {GA}, {JACCARD.format(b=0)} select grid_id, atom_label, round(j, 6) as jaccard from jr where r = 1")
def match_by_overlap(spark, sf_dir):
    return rounded(matching.match_by_overlap(grid_and_atoms(spark, sf_dir)).drop("step"))


@query("x1b_match_one_to_one", f"with {GA}, {JACCARD.format(b=-1)}, o as (select *, row_number() over (partition by atom_label order by grid_id desc) as k from jr where r = 1 and j >= 0.05) select grid_id, atom_label, round(j, 6) as jaccard from o where k = 1")
def match_one_to_one(spark, sf_dir):
    return rounded(matching.match_one_to_one(grid_and_atoms(spark, sf_dir), min_jaccard=0.05).drop("step"))


VOXELS = f"""{CLUSTERS_3D}, vx as (select run, label + 1 as cluster_id, xi, yi, zi, dx, dy, dz from k3), fa as (select v.*, s.a, s.b, s.c, case when s.a <> 0 then dy * dz when s.b <> 0 then dx * dz else dx * dy end as area from vx v, (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(a, b, c)),
su as (select run, cluster_id, sum(area) as surface from fa where not exists (select 1 from vx o where o.run = fa.run and o.cluster_id = fa.cluster_id and o.xi = fa.xi + fa.a and o.yi = fa.yi + fa.b and o.zi = fa.zi + fa.c) group by 1, 2),
vo as (select run, cluster_id, sum(dx * dy * dz) as volume, count(*) as n_points from vx group by 1, 2)"""


def shapes_3d(spark, sf_dir):
    cells = grid.select_cells_3d(grid.cell_means(boxed(spark, sf_dir)), 0.55)
    k = labelling.cell_components_3d(cells).join(cells.select("step", "size_id", "xi", "yi", "zi", "dx", "dy", "dz"), ["step", "size_id", "xi", "yi", "zi"])
    return matching.voxel_shape(k, ["step", "size_id", "cluster_id"], least_points=2)


@query("x2_voxel_shape", f"with recursive {VOXELS} select run // 10 as step, (run % 10)::int as size_id, cluster_id, round(case when n_points >= 2 then volume else 0 end, 3) as volume, round(case when n_points >= 2 then surface else 0 end, 3) as surface, n_points from su join vo using (run, cluster_id)")
def voxel_shape(spark, sf_dir):
    return rounded(shapes_3d(spark, sf_dir), 3)


def matched_shapes(spark, sf_dir):
    """Clusters of both cell sizes as if those of the second were the atoms', matched by the atoms that they share."""
    atoms = cut(boxed(spark, sf_dir).select("step", "size_id", "atom_id", "xi", "yi", "zi", "c_label", "dx", "dy", "dz", "mx", "my", "mz"))
    cells = cut(grid.select_cells_3d(grid.cell_means(atoms), 0.55))
    clusters = cut(labelling.cell_components_3d(cells))
    members = cut(grid.cell_members(atoms, clusters))
    one, two = (members.where(f"size_id = {n}").select("step", "atom_id", F.col("cluster_id").alias(c)) for n, c in ((0, "grid_id"), (1, "atom_label")))
    both = one.join(two, ["step", "atom_id"], "full").fillna(-1, ["grid_id", "atom_label"])
    k = clusters.join(cells.select("step", "size_id", "xi", "yi", "zi", "dx", "dy", "dz"), ["step", "size_id", "xi", "yi", "zi"])
    s = cut(matching.voxel_shape(k, ["step", "size_id", "cluster_id"], least_points=2))
    g, a = (s.where(f"size_id = {n}").drop("size_id").withColumnRenamed("cluster_id", c) for n, c in ((0, "grid_id"), (1, "atom_label")))
    return matching.compare_clusters(matching.match_one_to_one(both, min_jaccard=0.01), g, a, least_points=1)


MATCHED = f"""{VOXELS}, sh as (select run // 10 as step, run % 10 as size_id, cluster_id, case when n_points >= 2 then volume else 0 end as volume, case when n_points >= 2 then surface else 0 end as surface from su join vo using (run, cluster_id)),
me as (select step, size_id, atom_id, label + 1 as cluster_id from bx join k3 using (step, size_id, xi, yi, zi)), m0 as (select step, atom_id, cluster_id as g from me where size_id = 0), m1 as (select step, atom_id, cluster_id as a from me where size_id = 1),
j0 as (select step, g, count(*) as ng from m0 group by 1, 2), j1 as (select step, a, count(*) as na from m1 group by 1, 2), jb as (select step, g, a, count(*) as n from m0 join m1 using (step, atom_id) group by 1, 2, 3),
jj as (select step, g, a, n::double / (ng + na - n) as j from jb join j0 using (step, g) join j1 using (step, a)), j2 as (select *, row_number() over (partition by step, g order by j desc, a) as r from jj), mt as (select *, row_number() over (partition by step, a order by g desc) as r2 from j2 where r = 1 and j >= 0.01),
cc as (select g.step, g.cluster_id, mt.a, abs(g.volume - a.volume) as vd, case when a.volume = 0 then 0 else 100 * abs(g.volume - a.volume) / a.volume end as vp, abs(g.surface - a.surface) as sd, case when a.surface = 0 then 0 else 100 * abs(g.surface - a.surface) / a.surface end as sp
  from mt join sh g on g.step = mt.step and g.cluster_id = mt.g and g.size_id = 0 join sh a on a.step = mt.step and a.cluster_id = mt.a and a.size_id = 1 where r2 = 1)"""


@query("x3_compare_clusters", f"with recursive {MATCHED} select step, cluster_id as grid_id, a as atom_label, round(vd, 3) as volume_diff, round(vp, 3) as volume_diff_pct, round(sd, 3) as surface_diff, round(sp, 3) as surface_diff_pct from cc")
def compare_clusters(spark, sf_dir):
    return rounded(matched_shapes(spark, sf_dir).select("step", "grid_id", "atom_label", "volume_diff", "volume_diff_pct", "surface_diff", "surface_diff_pct"), 3)


#: The sweep of the comparison: thresholds, least points and least overlap, which are low as the table has no real clusters.
SWEPT = {"thresholds": (0.5, 0.55), "atom_thr": 0.45, "min_jaccard": 0.001, "least_points": 2}


def sweep_rows(spark, sf_dir):
    a = snapshots(spark, sf_dir)
    rows = comparison.compare_sweep(a, sources.snapshot_boxes(a), SIZES, **SWEPT)
    return rows.withColumnRenamed("size_id", "cell_size")


SWEEP = f"""{STEPPED}, {components_sql('hs', 'ks', NEAR_3D, '(xi * 1000 + yi) * 1000 + zi', 'run')}, {LINE_ATOMS.removeprefix(A + ", ")},
ksz as (select run, root, count(*) as size from ks group by 1, 2 having count(*) > 1), kid as (select run, root, row_number() over (partition by run order by size desc, root) - 1 as grid_id from ksz),
kg as (select run, step, size_id, c_thr, diffusion, xi, yi, zi, grid_id from ks join kid using (run, root)), kd as (select kg.*, s.dx, s.dy, s.dz from kg join sz s using (size_id)),
ga as (select run, step, size_id, c_thr, diffusion, grid_id, atom_id from kg join bx using (step, size_id, xi, yi, zi)), la2 as (select step, atom_id, label - 1 as atom_label from lab),
jg as (select run, step, size_id, c_thr, diffusion, grid_id, count(*) as g from ga group by all), ja as (select step, atom_label, count(*) as a from la2 group by all), jb as (select run, grid_id, atom_label, count(*) as n from ga join la2 using (step, atom_id) group by all),
jj as (select jg.*, atom_label, n::double / (g + a - n) as j from jb join jg using (run, grid_id) join ja using (step, atom_label)), j2 as (select *, row_number() over (partition by run, grid_id order by j desc, atom_label) as r from jj),
mt as (select *, row_number() over (partition by run, atom_label order by grid_id desc) as r2 from j2 where r = 1 and j >= 0.001),
sides(a, b, c) as (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
gsu as (select run, grid_id, sum(case when a <> 0 then dy * dz when b <> 0 then dx * dz else dx * dy end) as surface from (select v.*, s.* from kd v, sides s) f where not exists (select 1 from kd o where o.run = f.run and o.grid_id = f.grid_id and o.xi = f.xi + f.a and o.yi = f.yi + f.b and o.zi = f.zi + f.c) group by 1, 2),
gvo as (select run, grid_id, sum(dx * dy * dz) as volume from kd group by 1, 2), ac as (select distinct step, size_id, atom_label, xi, yi, zi, dx, dy, dz from bx join la2 using (step, atom_id)),
asu as (select step, size_id, atom_label, sum(case when a <> 0 then dy * dz when b <> 0 then dx * dz else dx * dy end) as surface from (select v.*, s.* from ac v, sides s) f where not exists (select 1 from ac o where o.step = f.step and o.size_id = f.size_id and o.atom_label = f.atom_label and o.xi = f.xi + f.a and o.yi = f.yi + f.b and o.zi = f.zi + f.c) group by all),
avo as (select step, size_id, atom_label, sum(dx * dy * dz) as volume from ac group by all),
sw as (select mt.step, mt.size_id as cell_size, c_thr, diffusion, mt.grid_id as cluster_id, abs(gvo.volume - avo.volume) as vd, 100 * abs(gvo.volume - avo.volume) / avo.volume as vp, 100 * abs(gsu.surface - asu.surface) / asu.surface as sp
  from mt join gsu using (run, grid_id) join gvo using (run, grid_id) join asu on asu.step = mt.step and asu.size_id = mt.size_id and asu.atom_label = mt.atom_label join avo on avo.step = mt.step and avo.size_id = mt.size_id and avo.atom_label = mt.atom_label join ja on ja.step = mt.step and ja.atom_label = mt.atom_label where r2 = 1 and g >= 2 and ja.a >= 2)"""


@query("x4_sweep_summary", f"with recursive {SWEEP} select diffusion, cell_size, c_thr, count(distinct cluster_id) as n_clusters, count(*) as n_rows, round(avg(vp), 3) as volume_diff_pct_mean, round(median(vp), 3) as volume_diff_pct_median, round(avg(sp), 3) as surface_diff_pct_mean, round(median(sp), 3) as surface_diff_pct_median from sw group by 1, 2, 3")
def sweep_summary(spark, sf_dir):
    return rounded(matching.sweep_summary(sweep_rows(spark, sf_dir)), 3)


@query("x5_sweep_pivot", f'with recursive {SWEEP} select cell_size, round(avg(vp) filter (c_thr = 0.5), 3) as "0.5", round(avg(vp) filter (c_thr = 0.55), 3) as "0.55" from sw where cluster_id = 0 group by cell_size')
def sweep_pivot(spark, sf_dir):
    return rounded(matching.sweep_pivot(sweep_rows(spark, sf_dir), thresholds=SWEPT["thresholds"]), 3)


# Other clusterers


@query("b1_kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return baselines.kmeans_labels(vector_points(spark, sf_dir, True), 4).select("point_id", "label")


@query("b2_gmm_labels")
def gmm_labels(spark, sf_dir):
    return baselines.gmm_labels(vector_points(spark, sf_dir, True), 3).select("point_id", "label")


DBSCAN = f"""with recursive {V}, nb as (select a.point_id as a, b.point_id as b from v a join v b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.02 ** 2), co as (select a from nb group by a having count(*) >= 5),
ce as (select nb.a, nb.b from nb join co on co.a = nb.a join co c2 on c2.a = nb.b), r(a, b) as (select a, a from co union select r.a, ce.b from r join ce on ce.a = r.b), m as (select a, min(b) as root from r group by a), cl as (select a, (dense_rank() over (order by root) - 1)::int as label from m),
bo as (select nb.a, min(cl.label) as near from nb join cl on cl.a = nb.b group by nb.a) select point_id, coalesce(cl.label, bo.near, -1)::int as label from v left join cl on cl.a = point_id left join bo on bo.a = point_id"""


@query("b3_dbscan_labels", DBSCAN)
def dbscan_labels(spark, sf_dir):
    return baselines.dbscan_labels(vector_points(spark, sf_dir), 0.02, 5).select("point_id", "label")


CLIQUE = f"""with recursive {V}, s0 as (select point_id, (x - min(x) over ()) / (max(x) over () - min(x) over () + 1e-12) as x, (y - min(y) over ()) / (max(y) over () - min(y) over () + 1e-12) as y from v),
q as (select point_id, greatest(0, least(floor(x / 0.1), 9))::int as i, greatest(0, least(floor(y / 0.1), 9))::int as j from s0), d as (select i, j, count(*) as n from q group by 1, 2 having count(*) >= 8), {components_sql("d", "l", code="i * 10 + j")}
select point_id, coalesce(label, -1) as label from q left join l using (i, j)"""


@query("b4_clique_labels", CLIQUE)
def clique_labels(spark, sf_dir):
    return baselines.clique_labels(vector_points(spark, sf_dir), 10, 8).select("point_id", "label")


@query("b5_compare_methods")
def compare_methods(spark, sf_dir):
    methods = {"kmeans": lambda p: baselines.kmeans_labels(p, 4), "dbscan": lambda p: baselines.dbscan_labels(p, 0.25, 5), "clique": lambda p: baselines.clique_labels(p, 10, 8)}
    return rounded(baselines.compare_methods(cut(vector_points(spark, sf_dir, True)), methods))


REGIONS = f"with recursive {LABELLED} select label, count(*) as n_points, round(avg(x), 4) as x, round(avg(y), 4) as y from y group by label"


@query("dense_regions", REGIONS)
def dense_regions(spark, sf_dir):
    """Where the dense regions are and what is in them: binning, threshold, components, labels back to points."""
    d = labelled_events(spark, sf_dir)
    return rounded(d.groupBy("label").agg(F.count("*").alias("n_points"), F.avg("x").alias("x"), F.avg("y").alias("y")), 4)
