"""Clustering by centroids, with heaps of bounds that say which vectors must be looked at again (operator 13)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut, shared_dir
from gridjobs.llm.tables import slices, table

#: Vectors of one tile, a row of the state.
TILE = 8_192
#: Components below this have squared distances that doubles hold exactly; those from LARGEST on may have none that a long holds.
EXACT, LARGEST = 1 << 22, 1 << 27
#: Share of the magnitudes that rounding of bounds stays far below.
SLACK = 1e-9
DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64.0

STATE = "ids array<long>, bits int, vectors binary, cluster binary, sizes array<int>, gaps binary, rows binary, moved array<struct<cluster:int,n:long,sums:array<long>>>, scanned long"


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Whole squared distances of vectors (rows) to centroids (columns)."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


class Tile:
    """Vectors, their clusters, and a heap for each cluster.

    A heap holds (gap, row): how much further the second nearest centroid was than the nearest when the row was last scanned, plus
    what the cluster's drift had added up to by then. A centroid's move by d brings its vectors' bounds together by at most d and
    the largest move of another centroid; so a row keeps its cluster surely while its gap is above the drift added up so far, and
    no entry but those popped ever changes.
    """

    def __init__(self, x: np.ndarray, cluster: np.ndarray | None = None, heaps: list[list[tuple[float, int]]] | None = None):
        self.x = x
        self.cluster = np.full(len(x), -1, np.int32) if cluster is None else cluster
        self.heaps = heaps

    def expired(self, drift: np.ndarray, slack: float) -> np.ndarray:
        """Rows whose gap is used up, taken from their heaps."""
        if self.heaps is None:
            self.heaps = [[] for _ in drift]
            return np.arange(len(self.x))
        out = []
        for heap, d in zip(self.heaps, (drift + slack).tolist(), strict=True):
            while heap and heap[0][0] <= d:
                out.append(heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def assign(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scan the expired rows against all centroids and put them back; (rows that change cluster, their clusters before)."""
        size = max(np.abs(self.x).max(initial=0), np.abs(centroids).max(initial=0))
        rows = self.expired(drift, SLACK * (1 + 16.0 * size + drift.max(initial=0.0)))
        self.scanned = len(rows)
        d = squared(self.x[rows], centroids)
        near = d.argmin(1) if len(rows) else rows
        gap = np.full(len(rows), np.inf)
        if d.shape[1] > 1:
            two = np.sqrt(np.partition(d, 1, 1)[:, :2].astype(float))
            gap = two[:, 1] - two[:, 0]
        gap += drift[near]
        for c, heap in enumerate(self.heaps):
            new = np.nonzero(near == c)[0]
            entries = zip(gap[new].tolist(), rows[new].tolist(), strict=True)
            if heap:
                for e in entries:
                    heappush(heap, e)
            else:
                heap.extend(entries)
                heapify(heap)
        before = self.cluster[rows]
        self.cluster[rows] = near
        changed = before != near
        return rows[changed], before[changed]

    def moved(self, rows: np.ndarray, before: np.ndarray) -> list[dict]:
        """What the changes take from and give to each cluster: rows, and sums of their components."""
        out = []
        x = self.x[rows].astype(np.int64)
        for c in np.union1d(before, self.cluster[rows]).tolist():
            sign = (self.cluster[rows] == c).astype(np.int64) - (before == c)
            if c >= 0:
                out.append({"cluster": c, "n": int(sign.sum()), "sums": (sign @ x).tolist()})
        return out


def _tiles(scale: float, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TILE):
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            x = np.floor(scale * v)
            top = np.abs(x).max(initial=0)
            if not top < LARGEST:
                raise ValueError(f"components must stay below {LARGEST} in size when scaled, or squared distances may not fit a long")
            bits = 16 if top < 1 << 15 else 32
            one = {"ids": [batch.column("id").to_pylist()], "bits": [bits], "vectors": [x.astype(f"<i{bits // 8}").tobytes()]}
            yield pa.RecordBatch.from_arrays([pa.array(one["ids"], pa.list_(pa.int64())), pa.array(one["bits"], pa.int32()), pa.array(one["vectors"], pa.binary())], names=["ids", "bits", "vectors"])

    return run


def _load(row: dict, dims: int, first: bool) -> Tile:
    x = np.frombuffer(row["vectors"], f"<i{row['bits'] // 8}").reshape(-1, dims).astype(np.int64)
    if first:
        return Tile(x)
    gaps, rows, at, heaps = np.frombuffer(row["gaps"], "<f8").tolist(), np.frombuffer(row["rows"], "<i4").tolist(), 0, []
    for n in row["sizes"]:
        heaps.append(list(zip(gaps[at : at + n], rows[at : at + n], strict=True)))
        at += n
    return Tile(x, np.frombuffer(row["cluster"], "<i4").copy(), heaps)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(batches, 1):
        yield from batch.to_pylist()


def _round(centroids: np.ndarray, drift: np.ndarray, first: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            t = _load(row, centroids.shape[1], first)
            changed = t.assign(centroids, drift)
            entries = [e for heap in t.heaps for e in heap]
            out = {
                "ids": row["ids"], "bits": row["bits"], "vectors": row["vectors"], "cluster": t.cluster.astype("<i4").tobytes(), "sizes": [len(h) for h in t.heaps],
                "gaps": np.array([g for g, _ in entries], "<f8").tobytes(), "rows": np.array([r for _, r in entries], "<i4").tobytes(), "moved": t.moved(*changed), "scanned": t.scanned,
            }
            yield pa.RecordBatch.from_pylist([out], _schema())

    return run


def _schema() -> pa.Schema:
    part = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    kinds = [pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(part), pa.int64()]
    return pa.schema(list(zip(["ids", "bits", "vectors", "cluster", "sizes", "gaps", "rows", "moved", "scanned"], kinds, strict=True)))


def _last(centroids: np.ndarray, drift: np.ndarray, first: bool) -> Callable:
    """Assigns once more and tells each vector's cluster and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            t = _load(row, centroids.shape[1], first)
            t.assign(centroids, drift)
            d = ((t.x - centroids[t.cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(t.cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, k: int, scale: float) -> np.ndarray:
    """The ``k`` vectors whose id has the smallest hash; (number, dimensions)."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("h", h).orderBy("h", "v").limit(k).collect()
    return np.array([np.floor(scale * np.array(r["v"], float)) for r in rows]).astype(np.int64)


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, id_col: str = "vec_id", vector: str = "embedding", trace: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): each vector's cluster after ``rounds`` rounds.

    Components are floor(scale * x); all sums and distances are whole numbers. A round gives each vector to its nearest centroid
    (the smaller number among equals) and moves each centroid that has vectors to the floor of their mean; then vectors are
    assigned once more. Vectors that are null, have another length or hold a null or non-finite component take no part; repeated
    rows count each; a null id counts as empty text where centroids are chosen and stays null. Fewer vectors than ``k``
    make as many centroids; no vectors make no rows. Scaled components of 2**27 or more in size raise an error, since a long
    could not hold their distances. Other columns are not read.

    Vectors lie in tiles of up to 8,192, a row of a table that each round writes anew to the shared folder with the tile's heaps,
    so nothing is shuffled by cluster and a lost task needs only its tile's row of the round before. The driver sees ``k`` centroids
    and, for each round, the sums that moved, summed up by Spark. ``trace``, if given, gets the number of vectors scanned in each round.
    """
    spark = vectors.sparkSession
    ok = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    centroids = first_centroids(kept, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    folder = f"{shared_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    kept.mapInArrow(_tiles(scale, dims), "ids array<long>, bits int, vectors binary").write.parquet(f"{folder}/tiles")
    state = spark.read.parquet(f"{folder}/tiles")
    n, sums, drift = [0] * len(centroids), np.zeros(centroids.shape, object), np.zeros(len(centroids))
    for r in range(rounds):
        state.mapInArrow(_round(centroids, drift, r == 0), STATE).write.parquet(f"{folder}/round-{r}")
        state = spark.read.parquet(f"{folder}/round-{r}")
        if trace is not None:
            trace.append(state.agg(F.sum("scanned")).first()[0])
        part = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums"))
        whole = F.sum(F.col("col").cast("decimal(38,0)"))
        for c, pos, count, total in part.groupBy("cluster", "pos").agg(F.sum("n"), whole).collect():
            n[c] += count if pos == 0 else 0
            sums[c, pos] += int(total)
        new = np.array([[s // n[c] for s in sums[c]] if n[c] else centroids[c] for c in range(len(centroids))], np.int64)
        moves = np.sqrt(((new - centroids) ** 2).sum(1).astype(float))
        others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(len(moves))])
        centroids, drift = new, drift + moves + others
    found = cut(state.mapInArrow(_last(centroids, drift, not rounds), "vec_id long, cluster int, distance long"))
    parts = {c: d for c, d in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    told = spark.createDataFrame([(c, parts.get(c, 0), sum(parts.values()), ",".join(map(str, x.tolist()))) for c, x in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, c string")
    told = told.withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out one after the other."""
    steps = ["""
kept AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS (SELECT r, unnest(range(64)) AS d, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept),
starts AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c FROM kept),
c0 AS (SELECT c, d, x AS y FROM starts JOIN x USING (r) WHERE c < 16)"""]  # fmt: skip
    for n in range(ROUNDS + 1):
        steps.append(f"""
f{n} AS (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS dist FROM x JOIN c{n} USING (d) GROUP BY r, c),
a{n} AS (SELECT r, c, dist FROM f{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)""")
        if n < ROUNDS:
            steps.append(f"""
s{n} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY c, d),
c{n + 1} AS (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{n} LEFT JOIN s{n} USING (c, d))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN h USING (c)"""


ORACLE = _oracle()
