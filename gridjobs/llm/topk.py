"""Exact top-k inner product search by columnar branch and bound (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.llm.tables import table

#: Vectors and queries of one tile, queries searched together, dimensions of one block.
TILE, QUERY_TILE, TOGETHER, DIMS = 8_192, 16_384, 64, 4
#: Share of live pairs from which a block is multiplied as a whole.
DENSE = 0.75
#: Share of the mass after which floors are raised, by scoring the candidates of so many times k best sums in full.
RAISED, RAISE = 0.5, 4
K = 20


class Tile:
    """Vectors laid out by dimension: centred, turned to their main axes, those of most mass first.

    Turning changes no inner product and puts most of it into the first dimensions, so that what is still to come is bounded
    early. Turned values are floating point; what survives the bounds is scored anew with the whole numbers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.centre = np.rint(vectors.mean(0)) if len(ids) else np.zeros(vectors.shape[1])
        x = vectors - self.centre
        self.turn = np.linalg.eigh(x.T @ (x / max(1.0, np.abs(x).max(initial=0.0)) ** 2))[1][:, ::-1]
        self.cuts = [*range(0, x.shape[1], DIMS), x.shape[1]]
        x = (x @ self.turn).T
        self.rest = [np.sqrt((x[b:] ** 2).sum(0)).astype(np.float32) for b in self.cuts]
        left = np.array([float((r.astype(float) ** 2).sum()) for r in self.rest])
        self.raised = int(np.argmax(left <= (1 - RAISED) * left[0]))
        self.x = np.ascontiguousarray(x, np.float32)


def top_k(q_ids: np.ndarray, q: np.ndarray, tile: Tile, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query position, candidate id, score) of each query's k best candidates, ties to smaller ids, own ids left out, and the number
    of multiplications done. ``floors``: scores below which a query wants none.

    Dimensions are added block by block. What is still to come of a pair is at most the product of the remaining norms, so each
    query drops candidates whose bound is below its floor, the k-th best of what it has seen in full: once half of
    the mass is summed, the candidates of the best sums are scored in full to raise it. While most pairs live a block is a matrix
    product; then pairs are listed and compacted after each block.
    """
    done, out = 0, []
    for at in range(0, len(q), TOGETHER):
        got = _search(q_ids[at : at + TOGETHER], q[at : at + TOGETHER], tile, k, None if floors is None else floors[at : at + TOGETHER])
        done += got[3]
        out.append((got[0] + at, *got[1:3]))
    return *(np.concatenate([x[n] for x in out]) if out else np.empty(0, np.int64) for n in range(3)), done


def _search(own: np.ndarray, q: np.ndarray, t: Tile, k: int, floors: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n, size, dims = len(q), len(t.ids), q.shape[1]
    base = q @ t.centre
    y64 = q @ t.turn
    rest_y = [np.sqrt((y64[:, b:] ** 2).sum(1)).astype(np.float32) for b in t.cuts]
    y = y64.astype(np.float32)
    # single precision, and the rounding of whole numbers beyond 2^53
    slack = (1e-5 * np.outer(rest_y[0], t.rest[0]) + 1e-5 * np.abs(base)[:, None] + 1.0).astype(np.float32)
    floor = np.full(n, -np.inf) if floors is None else floors.astype(float)
    score = np.repeat(base[:, None].astype(np.float32), size, 1)
    score[own[:, None] == t.ids[None]] = -np.inf
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    done = 0
    for b, (lo, hi) in enumerate(zip(t.cuts, t.cuts[1:], strict=False)):
        if pairs is None:
            score += y[:, lo:hi] @ t.x[lo:hi]
            done += n * size * (hi - lo)
            if size > RAISE * k and t.raised == b + 1:
                few = np.argpartition(score, -RAISE * k, 1)[:, -RAISE * k :]
                row = np.repeat(np.arange(n), RAISE * k)
                full = _exact(q, t, row, few.ravel()).astype(float)
                full[~np.isfinite(score[row, few.ravel()])] = -np.inf
                floor = np.maximum(floor, np.partition(full.reshape(n, -1), -k, 1)[:, -k])
                done += len(row) * dims
            live = score + (rest_y[b + 1][:, None] * t.rest[b + 1][None]) + slack >= floor[:, None].astype(np.float32)
            live &= np.isfinite(score)
            if live.mean() < DENSE:
                pairs = np.nonzero(live)
                score, slack = score[pairs], slack[pairs]
        else:
            row, col = pairs
            for d in range(lo, hi):
                score += y[row, d] * t.x[d][col]
            done += len(row) * (hi - lo)
            keep = score + rest_y[b + 1][row] * t.rest[b + 1][col] + slack >= floor[row].astype(np.float32)
            pairs, score, slack = (row[keep], col[keep]), score[keep], slack[keep]
    row, col = np.nonzero(live) if pairs is None and dims else pairs or (np.empty(0, np.int64),) * 2
    exact = _exact(q, t, row, col)
    done += len(row) * dims
    ids = t.ids[col]
    order = np.lexsort((ids, -exact, row))
    row, ids, exact = row[order], ids[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (rank < k) & (exact >= floor[row] - np.abs(floor[row]) * 1e-12 if len(row) else rank < k)
    return row[keep], ids[keep], exact[keep], done


def _exact(q: np.ndarray, t: Tile, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Whole scores of pairs, some thousand at a time."""
    return np.concatenate([np.einsum("ij,ij->i", q[row[a : a + 65_536]], t.vectors[col[a : a + 65_536]]) for a in range(0, len(row), 65_536)] or [np.empty(0, np.int64)])


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _tile(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            at, ids, score = (np.empty(0, np.int64),) * 3
        else:
            q_ids, floors = left.column("id").to_numpy(), left.column("floor").to_numpy(zero_copy_only=False).astype(float)
            floors = np.where(np.isnan(floors), -np.inf, floors)
            at, ids, score, _ = top_k(q_ids, _matrix(left), Tile(right.column("id").to_numpy(), _matrix(right)), k, floors)
            at = q_ids[at]
        return pa.table({"query_id": pa.array(at, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


FOUND = "query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best vectors by inner product of floor(scale * x), its own id left out.

    Vectors that are null, empty or hold a null or a non-finite component, and null ids, take no part; vectors are compared
    with queries of their own length only. Repeated queries count once; repeated vectors are candidates each. Ties go to
    the smaller id, then stand in any order. Scores must fit a long. Queries without candidates give no row.

    Vectors and queries are dealt into tiles of bounded size and each pair of tiles is one task. First each tile of queries meets
    one tile of vectors; the k-th score found there is the floor with which it goes to all others, which then send on only
    what reaches it, k rows a query at most. Equal rows are dealt by their partition too, so a common vector fills no tile. The
    counts that set the number of tiles are the only rows that reach the driver.
    """
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def taken(df: DataFrame) -> DataFrame:
        whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
        return df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))

    c, q = taken(vectors), taken(queries).dropDuplicates(["id", "v"])
    n, m = max(1, -(-c.count() // TILE)), max(1, -(-q.count() // QUERY_TILE))
    keys = ["d", "a", "b"]
    q = q.withColumns({"d": F.size("v"), "a": F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")})
    c = c.withColumns({"d": F.size("v"), "b": F.pmod(F.xxhash64("id", "v") + F.spark_partition_id(), F.lit(n)).cast("int")})
    every = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    own = F.pmod(F.col("a"), F.lit(n))  # the tile that a tile of queries meets first

    def met(queries_: DataFrame, tiles, sides) -> DataFrame:
        left = queries_.select("id", "v", "floor", "d", "a", F.explode(tiles).alias("b"))
        right = c.select("id", "v", "d", "b", F.explode(sides).alias("a"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), FOUND)

    found = met(q.withColumn("floor", F.lit(None).cast("long")), F.array(own), F.filter(every(m), lambda a: F.pmod(a, F.lit(n)) == F.col("b")))
    if n > 1:
        found = cut(found)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floors = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        more = met(q.join(floors, "id", "left"), F.filter(every(n), lambda b: b != own), F.filter(every(m), lambda a: F.pmod(a, F.lit(n)) != F.col("b")))
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return exact_top_k(e, e.where("vec_id % 20 = 0"))


ORACLE = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
