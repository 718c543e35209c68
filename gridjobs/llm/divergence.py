"""How the words of a language's sources differ, from frequent-pattern trees of term rows (operator 12)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridjobs.functions.session import cut
from gridjobs.llm.tables import slices, table

#: Letters in UTF-8: A-Z, a-z (lower-cased before) and all beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of the language from which a term is kept, and terms told of each group.
LEAST, TOP = 30, 50
#: Share of all words is counted in parts of this; added to each count.
WHOLE, ADDED = 1_000_000_000, 5
#: Terms counted by a task before it passes them on, and words of a text handled at a time.
HELD, AT_A_TIME = 400_000, 1_000_000
#: Groups up to which their sums are broadcast (some 30 MB); more are joined by a shuffle, whose hot groups the planner splits.
GROUPS = 200_000
#: Sources from which on a task passes on the corrections of all their pairs (32 MB, or what the sources of one term take).
SOURCES = 1_000


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) counted so far, and a row without a term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> pa.RecordBatch:
        keys = [k for k, (n, _) in groups.items() for _ in range(len(n) + 1)]
        terms = [t for n, _ in groups.values() for t in (*n, None)]
        counts = [c for n, _ in groups.values() for c in (*n.values(), 0)]
        docs = [d for n, df in groups.values() for d in (*map(df.__getitem__, n), 0)]
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

    for batch in slices(batches):
        rows = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
        for lang, source, text in rows:
            n, df = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            if len(text) <= AT_A_TIME:
                own = Counter(TERM.findall(text.lower()))
            else:
                own, found = Counter(), (m.group() for m in TERM.finditer(text.lower()))
                while some := list(islice(found, AT_A_TIME)):
                    own.update(some)
            n.update(own)
            df.update(own.keys())
            held += len(n) - before
            if held > HELD:
                yield out()
                groups, held = {}, 0
    if groups:
        yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that hold it there; a row with a null
    term stands for the group itself. Null text, lang and source count as empty."""
    d = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    part = d.mapInArrow(_terms, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * kept)), in whole numbers of up to 38 digits."""
    top = F.lit(WHOLE).cast("decimal(38,0)") * (n + ADDED).cast("decimal(20,0)")
    return (1 + F.call_function("div", top.cast("decimal(38,0)"), (total + ADDED * kept).cast("decimal(20,0)"))).cast("long")


class Tree:
    """A frequent-pattern tree of term rows, read as they come in order: what is held is the path to the last row.

    A node is a source with the share that its count makes at a term; rows that begin alike share their first nodes. When nodes are
    left, all terms below them are known, and each is set against each of its ancestors once, with that number: by how much |p - q| of
    the two sources differs from what their nodes give where the other source lacks the term, and gave where both lack it.
    """

    def __init__(self):
        self.source = self.p = self.p0 = np.empty(0, np.int64)
        self.terms = np.empty(0, np.int64)
        #: for each source (by its number) the corrections with the sources before it
        self.sums = np.zeros((0, 0), np.int64)
        self.combinations = 0

    def insert(self, source: np.ndarray, p: np.ndarray, p0: np.ndarray, terms: int) -> None:
        """A row's sources (numbers) in order, their shares, their shares where a term is lacking, and how many terms have it."""
        n = min(len(source), len(self.source))
        alike = (source[:n] == self.source[:n]) & (p[:n] == self.p[:n])
        same = n if alike.all() else int(alike.argmin())
        self.leave(same)
        self.source, self.p, self.p0 = source, p, p0
        self.terms = np.append(self.terms, np.zeros(len(source) - same, np.int64))
        self.terms[-1] += terms

    def leave(self, depth: int) -> None:
        """Leave the nodes below ``depth``."""
        n = len(self.source)
        if n <= depth:
            return
        below = np.cumsum(self.terms[depth:][::-1])[::-1]
        p, p0 = self.p, self.p0
        own, none = p[depth:, None], p0[depth:, None]
        more = below[:, None] * (np.abs(own - p) - np.abs(own - p0) - np.abs(none - p) + np.abs(none - p0))
        more *= np.arange(n) < np.arange(depth, n)[:, None]
        top = int(self.source.max()) + 1
        if top > len(self.sums):
            grown = np.zeros((2 * top, 2 * top), np.int64)
            grown[: len(self.sums), : len(self.sums)] = self.sums
            self.sums = grown
        self.sums[self.source[depth:, None], self.source] += more
        self.combinations += (depth + n - 1) * (n - depth) // 2
        if depth:
            self.terms[depth - 1] += below[0]
        self.source, self.p, self.p0, self.terms = self.source[:depth], p[:depth], p0[:depth], self.terms[:depth]

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, earlier source, correction) so far; what is told is forgotten."""
        a, b = np.nonzero(self.sums)
        value, self.sums = self.sums[a, b], np.zeros((0, 0), np.int64)
        return a, b, value


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): corrections of pairs of sources from a task's rows, which come in order."""
    names: dict[str, int] = {}

    def out(lang: str, tree: Tree) -> pa.RecordBatch:
        a, b, value = tree.told()
        known = pa.array(names, pa.string())
        cols = [pa.array([lang] * len(a), pa.string()), known.take(pa.array(a)), known.take(pa.array(b)), pa.array(value, pa.int64())]
        names.clear()
        return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "item", "value"])

    last, tree = None, Tree()
    for batch in slices(batches):
        row = batch.column("row")
        ends = row.offsets.to_numpy() - row.offsets[0].as_py()
        source, p, p0 = row.flatten().flatten()
        texts = source.to_pylist()
        p, p0 = p.to_numpy(), p0.to_numpy()
        for k, (lang, terms) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("terms").to_pylist(), strict=True)):
            if last is not None and (lang != last or len(names) > SOURCES):
                tree.leave(0)
                yield out(last, tree)
            last, (a, b) = lang, ends[k : k + 2]
            number = np.array([names.setdefault(t, len(names)) for t in texts[a:b]], np.int64)
            tree.insert(number, p[a:b], p0[a:b], terms)
    if last is not None:
        tree.leave(0)
        yield out(last, tree)


def _alone() -> Callable:
    """For one group and each other source of its language: by how much the group's own terms change the sum of |p - q|, if the
    other source had none of them.

    The sum of terms * |p - q| over the group's different shares follows for every q from running sums over the sorted shares."""

    def run(key: tuple, shares: pa.Table, others: pa.Table) -> pa.Table:
        lang, source = key[0].as_py(), key[1].as_py()
        p, m = shares.column("p").to_numpy(), shares.column("terms").to_numpy()
        order = np.argsort(p, kind="stable")
        p, m = p[order], m[order]
        below, mass = np.append(0, np.cumsum(m)), np.append(0, np.cumsum(m * p))
        others = others.filter(pc.not_equal(others.column("item"), source))
        q, own = (others.column(c).to_numpy() for c in ("q0", "p0"))
        at = np.searchsorted(p, q)
        value = 2 * (q * below[at] - mass[at]) + mass[-1] - q * below[-1] - below[-1] * np.abs(own - q)
        n = len(q)
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array([source] * n, pa.string()), "item": others.column("item"), "value": pa.array(value, pa.int64())})

    return run


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart, and by which terms.

    Each language keeps the terms that at least ``least`` of its documents hold. A group is a source within a language; its share
    p of a term is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), with N its occurrences of kept terms and V their number. Part ``pair``:
    each other source of the language, with the sum of |p - q| over all kept terms. Part ``term``: the ``top`` kept terms of the
    group whose share lies furthest above the language's own. Ranks run from 1 by falling value, then by item. All is whole numbers.

    Null text, lang and source count as empty; each row is a document, however often it is repeated; groups without terms are
    compared too, and a language without kept terms has pairs of value 0. An empty table gives an empty result. A text of any length
    is counted in one task, which holds its different words.

    Words are summed in each task before they are shuffled. Of two sources, |p - q| summed over all terms is V times what it is
    where both lack a term, plus what each source's own terms add to that, plus a correction for terms that both have. The second
    follows from the different counts of a group (k of them add up to k * (k + 1) / 2 occurrences at least, so 10**13 words
    have below 4.5 million). For the third, equal rows of terms become one with their number, and are dealt by ranges of (language,
    row), so that rows that begin alike lie together and each task grows a tree of its own; sums over trees make the whole.
    """
    counts = cut(term_counts(docs))
    groups = counts.select("lang", "source").distinct()
    by_term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumn("_docs", F.sum("docs").over(by_term)).where(F.col("_docs") >= least)
    kept = cut(kept.select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("n_lang")))
    # sums of groups and languages: a row each
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "total_lang"])
    zero = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(0)
    known = cut(known.withColumn("p0", zero))
    few = known.count() <= GROUPS
    shares = kept.join(F.broadcast(known) if few else known, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("kept")), "q": _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))})
    shares = cut(shares.select("lang", "source", "term", "p", "q", "p0"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # what is so for all terms, for each two sources of a language: as many rows as the result has
    other = known.toDF(*(f"_{c}" for c in known.columns)).select(F.col("_lang").alias("lang"), F.col("_source").alias("item"), F.col("_p0").alias("q0"))
    own = known.toDF(*(f"_{c}" for c in known.columns)).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_p0").alias("p0"), F.col("_kept").alias("kept"))
    two = own.join(F.broadcast(other) if few else other, "lang")
    base = two.where("source <> item").select("lang", "source", "item", (F.col("kept") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))
    different = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = different.groupBy("lang", "source").cogroup(two.groupBy("lang", "source")).applyInArrow(_alone(), "lang string, source string, item string, value long")
    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("row"))
    rows = rows.groupBy("lang", "row").agg(F.count("*").alias("terms")).where(F.size("row") > 1)
    # in any order in which rows that begin alike lie together; short keys, as samples of them are what the driver finds the ranges with
    rows = rows.withColumn("path", F.transform("row", lambda i: F.hash(i["source"], i["p"])))
    joint = rows.repartitionByRange("lang", F.slice("path", 1, 6)).sortWithinPartitions("lang", "path").drop("path").mapInArrow(_grown, "lang string, source string, item string, value long")
    one_way = alone.unionByName(joint)
    turned = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(one_way).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(terms, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total, 0) + 5 * v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (n_lang + 5)) // (total_lang + 5 * v)::HUGEINT AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
two AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source WHERE a.source <> b.source),
e AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
o AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM two
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM e)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
