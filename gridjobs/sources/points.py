"""Reading point and snapshot tables, and writing candidates and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names of truth columns, in the order in which they are looked for (fixed values).
TRUTH_COLUMNS = ("label", "Label", "labels", "Labels", "class", "Class", "target", "y_true", "gt")
#: Columns of a snapshot's box (fixed values).
BOX = ("xlo", "xhi", "ylo", "yhi", "zlo", "zhi")


def finite(*cols: str):
    """Condition that all columns hold finite numbers."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols))


def _load(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.options(header=True, inferSchema=True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def _coordinates(df: DataFrame, cols: Sequence[str], strict: bool) -> DataFrame:
    """``cols`` as doubles; rows in which one isn't a finite number are left out, or with ``strict`` raise an error."""
    exact = [c for c in cols if c not in df.columns]
    if exact:
        raise ValueError(f"missing columns: {', '.join(exact)}")
    kinds = dict(df.dtypes)
    d = df.withColumns({c: (F.col(c).try_cast("double") if kinds[c] == "string" else F.col(c).cast("double")) for c in cols})
    if strict:
        bad = F.raise_error(F.lit("a coordinate is null or not finite")).cast("boolean")
        return d.where(F.when(finite(*cols), F.lit(True)).otherwise(bad))
    return d.where(finite(*cols))


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in the order in which they are read, as rows of a file are by their place in it.

    Each partition is numbered by itself and begins where the ones before it end; only one count a partition is put together.
    The rows must come in the same order when a partition is read again, as those of files do.
    """
    at = F.monotonically_increasing_id()
    d = df.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    n = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("_part", before.alias("_before"))
    return d.join(F.broadcast(n), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def points_from(df: DataFrame, x: str = "x", y: str = "y", id_col: str = "point_id", strict: bool = False) -> DataFrame:
    """A table's rows as 2D points: point_id, x, y as doubles, and all other columns as they are. A table without the id column is
    numbered by position, rows with bad coordinates included."""
    d = _coordinates(df if id_col in df.columns else with_positions(df, id_col), [x, y], strict)
    for old, new in ((id_col, "point_id"), (x, "x"), (y, "y")):
        d = d.withColumnRenamed(old, new)
    return d


def read_points(spark: SparkSession, path: str, fmt: str = "csv", x: str = "x", y: str = "y", id_col: str = "point_id", strict: bool = False) -> DataFrame:
    """Points of a CSV or Parquet file with the columns x and y; without an id column point_id is the place in the file. A missing
    coordinate column raises ValueError."""
    return points_from(_load(spark, path, fmt), x, y, id_col, strict)


def snapshots_from(df: DataFrame, label: str = "c_label", strict: bool = False) -> DataFrame:
    """3D snapshots: atom_id (the row's position if the table has none), step (0 if it has none), x, y, z, c_label and the six box
    bounds."""
    d = df if "atom_id" in df.columns else with_positions(df, "atom_id")
    d = _coordinates(d, ["x", "y", "z", label, *BOX], strict).withColumnRenamed(label, "c_label")
    return d if "step" in d.columns else d.withColumn("step", F.lit(0).cast("long"))


def read_snapshots(spark: SparkSession, path: str, fmt: str = "csv", label: str = "c_label", strict: bool = False) -> DataFrame:
    """Snapshots of a CSV or Parquet file, as ``snapshots_from`` takes them."""
    return snapshots_from(_load(spark, path, fmt), label, strict)


def snapshot_boxes(atoms: DataFrame) -> DataFrame:
    """One row per step with its box; a step whose rows disagree about it raises an error."""
    b = atoms.groupBy("step").agg(*(F.min(c).alias(c) for c in BOX), *(F.max(c).alias(f"_{c}") for c in BOX))
    same = reduce(lambda a, c: a & c, (F.col(c) == F.col(f"_{c}") for c in BOX))
    bad = F.raise_error(F.concat(F.lit("box differs within step "), F.col("step").cast("string"))).cast("boolean")
    return b.where(F.when(same, F.lit(True)).otherwise(bad)).select("step", *BOX)


def find_truth_column(df: DataFrame, name: str | None = None) -> str | None:
    """The first truth column that a table has, or the one of that name in any case."""
    if name is not None:
        return next((c for c in df.columns if c.lower() == name.lower()), None)
    return next((c for c in TRUTH_COLUMNS if c in df.columns), None)


def decode_labels(df: DataFrame, column: str) -> DataFrame:
    """Labels written like b'3' as 3; as integers only if every label of the table is one, and else all stay strings.

    The result has the column as a string with ``<column>_int`` beside it, which is null throughout in the second case.
    """
    bare = F.regexp_replace(F.trim(F.col(column).cast("string")), r"^b'(.*)'$", "$1")
    d = df.withColumn(column, bare)
    odd = d.agg((F.count_if(F.col(column).isNotNull() & F.col(column).try_cast("int").isNull()) == 0).alias("_all"))
    return d.crossJoin(F.broadcast(odd)).withColumn(f"{column}_int", F.when(F.col("_all"), F.col(column).try_cast("int"))).drop("_all")


def write_candidates(candidates: DataFrame, path: str, fmt: str = "csv") -> None:
    """Candidate rows by falling score."""
    w = candidates.orderBy(F.desc("score")).write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row table with nested columns as JSON."""
    summary.write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A summary written here, or a single indented JSON object."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=True)
