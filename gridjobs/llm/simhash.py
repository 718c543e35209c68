"""Near duplicates by SimHash fingerprints and a binary trie self-join (operator 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.kernels import smallest_reachable
from gridjobs.functions.session import cut
from gridjobs.llm.tables import slices, table
from gridjobs.operators.components import components

SEED = 42
WIDTH = 3
#: Bits that may differ.
ERRORS = 2
#: Fingerprints below one node of the trie where it is cut for tasks, on average; nodes of more than SLICE are dealt out in slices.
NODE, SLICE = 8_192, 20_000
#: Pairs of values from which on a pair of nodes is split rather than compared.
LEAF = 1_024
#: Most bits of a prefix at which the trie is cut, and of one whose table of nodes is told by broadcast (some 16 MB).
DEEPEST, TOLD_BITS = 32, 20
#: Classes of equal fingerprints that are told their components by broadcast (some 70 MB): all where there are no more, or else those
#: of more rows than 1 / TOLD of all, of which there are fewer.
TOLD = 1_000_000
#: Parts in which the rows of a class are counted first.
SALTS = 32
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it set."""
    data = text.encode().translate(_LOWER)
    words = WORD.findall(data)
    if not words:
        return 0
    if len(words) <= WIDTH:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -WIDTH].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[WIDTH - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, ">u8")
    for at in range(0, len(h), 65_536):
        counts += np.unpackbits(h[at : at + 65_536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes())


def _fingerprints(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t or "") for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(prints, pa.int64())], names=[*columns, "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint's bits as a signed long; null and empty texts have fingerprint zero."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_fingerprints(list(keep)), f"{kinds}, fp long")


def trie_pairs(left: np.ndarray, right: np.ndarray | None = None, errors: int = ERRORS, bits: int = 64, spent: int = 0, split: list | None = None) -> np.ndarray:
    """Pairs of values with at most ``errors`` differing bits, one of each side (or two of the same, each pair once).

    Both sides are sorted, so a trie node is a range of an array. Pairs of nodes go down together, bit by bit: equal
    branches keep their budget, unequal ones lose one of it, and a pair whose budget is spent is followed no further. A
    pair of nodes with few values is compared directly. Below a pair of nodes of a larger trie only the lowest ``bits`` are left,
    and ``spent`` is what the way to them has taken of the budget. ``split``, if given, gets the bit of each pair that is split.
    """
    a = np.sort(left)
    same = right is None
    b = a if same else np.sort(right)
    found: list[np.ndarray] = []
    todo = [(0, len(a), 0, len(b), bits - 1, errors - spent)]
    while todo:
        a0, a1, b0, b1, bit, left_over = todo.pop()
        if a0 == a1 or b0 == b1 or same and a0 > b0:
            continue
        if (a1 - a0) * (b1 - b0) <= LEAF or bit < 0:
            x, y = a[a0:a1, None], b[None, b0:b1]
            i, j = np.nonzero(np.bitwise_count(x ^ y) <= errors)
            if same and a0 == b0:
                i, j = i[i < j], j[i < j]
            if len(i):
                found.append(np.stack([a[a0 + i], b[b0 + j]], 1))
            continue
        if split is not None:
            split.append(bit)
        half = lambda v, lo, hi: lo + int(np.searchsorted((v[lo:hi] >> np.uint64(bit)) & np.uint64(1), 1))  # noqa: B023, E731
        am, bm = half(a, a0, a1), half(b, b0, b1)
        todo += [(a0, am, b0, bm, bit - 1, left_over), (am, a1, bm, b1, bit - 1, left_over)]
        if left_over:
            todo.append((a0, am, bm, b1, bit - 1, left_over - 1))
            if not (same and a0 == b0):
                todo.append((am, a1, b0, bm, bit - 1, left_over - 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (value, smallest value that it reaches) that connect what ``pairs`` connect, at most one a value."""
    values, at = np.unique(pairs, return_inverse=True)
    root = values[smallest_reachable(len(values), *at.reshape(-1, 2).T)] if len(values) else values
    return np.stack([values, root], 1)[values != root]


def _linked(bits: int, errors: int):
    """A forest of the links between two nodes of the trie at one depth (or their slices), or within one."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        spent = key[1].as_py().bit_count()
        sides = [np.concatenate([np.array(v, np.int64) for s, v in zip(group.column("side").to_pylist(), group.column("values").to_pylist(), strict=True) if s == k] or [np.empty(0, np.int64)]).view(np.uint64) for k in (0, 1)]
        same = spent == 0 and key[2] == key[3]
        pairs = forest(trie_pairs(sides[0], None if same else sides[1], errors, bits, spent))
        return pa.table({"src": pa.array(pairs[:, 0].view(np.int64)), "dst": pa.array(pairs[:, 1].view(np.int64))})

    return run


def links(prints: DataFrame, errors: int = ERRORS, node: int = NODE, slice_: int = SLICE) -> DataFrame:
    """Pairs (src, dst) of distinct fingerprints that connect all that links of at most ``errors`` differing bits connect: each
    task gives a forest of its links, so that a dense ball of fingerprints costs a pair for each and not for each two.

    ``prints`` has one row per distinct ``fp``. All of them are one trie, joined with itself from its root. It is cut at the depth at
    which a node holds some ``node`` values: each pair of nodes there whose prefixes differ in no more bits than the budget allows is
    a task, which goes on below with what is left of the budget. So values travel as arrays, once for each prefix within reach: with
    p bits 1 + p + p * (p - 1) / 2 times for two errors. Nodes of more than ``slice_`` values are dealt out in slices by hash, and each
    pair of slices is a task, so none is lost and no task grows with a node. Only the number of values reaches the driver.
    """
    n = prints.count()
    depth = min(DEEPEST, max(0, (max(1, -(-n // node)) - 1).bit_length()))
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    p = prints.select("fp", prefix.alias("at"))
    sizes = p.groupBy("at").agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices"))
    told = (lambda df: F.broadcast(df)) if depth <= TOLD_BITS else (lambda df: df)
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    nodes = p.join(told(sizes), "at").withColumn("slice", own).groupBy("at", "slice").agg(F.collect_list("fp").alias("values"))
    # the errors' places within the prefix; each pair of nodes is named by its lower one and the bits that differ
    masks = sorted({sum(1 << k for k in some) for m in range(errors + 1) for some in combinations(range(depth), m)})
    met = nodes.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).withColumn("to", F.col("at").bitwiseXOR(F.col("mask")))
    partner = sizes.select(F.col("at").alias("to"), F.col("slices").alias("others"))
    met = met.join(told(partner), "to").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first = (F.col("at") < F.col("to")) | (F.col("at") == F.col("to")) & (F.col("slice") <= F.col("other"))
    key = [F.least("at", "to").alias("lower"), "mask", F.when(first, F.col("slice")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("slice")).alias("b")]
    met = met.select(*key, F.when(first, 0).otherwise(1).alias("side"), "values")
    return met.groupBy("lower", "mask", "a", "b").applyInArrow(_linked(64 - depth, errors), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links, its own included.

    Rows with equal fingerprints are one vertex, so copies of any number cost nothing in the join. Components go back to the rows
    by a broadcast of at most ``TOLD`` classes; where there are more classes, the rest, none of which holds more than 1 / ``TOLD``
    of the rows, are joined by fingerprint. Null, empty and
    word-free texts share fingerprint zero and are linked like any other. A null id takes part but is never the smallest.
    Repeated rows give repeated results; an empty table gives an empty one; other columns are not read.
    """
    prints = cut(fingerprints(docs, text, (id_col,)))
    # in two steps, so that of a class that all tasks have a few sums meet and not one a task
    some = prints.groupBy("fp", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    classes = cut(some.groupBy("fp").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    reach = components(cut(links(classes.select("fp"), node=NODE, slice_=SLICE)))
    top = classes.join(reach.withColumnRenamed("vertex", "fp"), "fp")
    best = top.groupBy("root").agg(F.min("first").alias("best"))
    named = top.join(best, "root").select("fp", "best")
    told = cut(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("best", "first").alias("component_id")))
    n = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n[0] <= TOLD:
        return prints.join(F.broadcast(told.drop("n")), "fp").select(id_col, "fp", "component_id")
    often = n[1] // TOLD
    hot = F.broadcast(told.where(F.col("n") > often).select("fp", "component_id"))
    rest = prints.join(hot, "fp", "left_anti").join(told.where(F.col("n") <= often).drop("n"), "fp")
    return rest.unionByName(prints.join(hot, "fp")).select(id_col, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
