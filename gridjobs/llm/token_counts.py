"""Token counts as delta-maintained rollups (operator 10)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut, shared_dir
from gridjobs.llm import bpe
from gridjobs.llm.tables import table

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens", "n_chars")
#: Vocabulary files of the registered query's tokenizer versions.
VOCABULARIES = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")


def tokenizers() -> dict[str, str]:
    """Tokenizer version -> path of its vocabulary."""
    import public_tokenizers

    return {name.split(".")[0]: public_tokenizers.path(name) for name in VOCABULARIES}


def counted(docs: DataFrame, versions: dict[str, str], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document and tokenizer version: ``keep`` columns, source, lang, tokenizer, n_tokens, n_chars.

    Whole texts are encoded as operator 7 does, very long ones in segments; null texts count as empty, null sources and languages stay
    null, repeated rows count each, an empty table gives an empty one. Columns that are neither kept nor named here, whatever
    their names, are not read."""
    own = tuple(dict.fromkeys((*keep, "source", "lang")))
    d = docs.select(*own, F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), F.col(text).alias("_t"))
    each = (bpe.encode_texts(d, path, "_t", (*own, "n_chars"), count_only=True).withColumn("tokenizer", F.lit(v)) for v, path in versions.items())
    return reduce(DataFrame.unionByName, each)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Deltas of counted documents: +1 inserts, -1 deletes; a revision is a delete of the old count and an insert of the new."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in TOTALS))


class Rollup:
    """Additive totals by source, language and tokenizer version, kept as one small table for each committed batch.

    A batch is pre-aggregated map-side and then written to a folder named by its id; the writer's success marker, which
    appears at the end, is the commit. Committing an id again is a no-op, a batch that died half way has no marker and is
    written anew, so any batch counts once however often it is sent. ``compact`` folds all committed batches into a new table
    that lists their ids beside the totals: what it reads stays until ``clear`` removes it, so a fold that dies half way changes
    nothing. Ids are looked up in the fold, not collected; only names of batches since the last fold and clear reach the driver.
    Groups whose documents are all gone disappear from ``totals``. Null sources and languages are groups of their own, null texts
    count no tokens, an empty batch commits nothing but its id. One writer at a time commits a batch id.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _done(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(p)

    def _names(self, kind: str) -> list[str]:
        """Folders of a kind whose writing came to its end."""
        fs, p = self._fs(self.path)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(kind) and self._done(n)) if fs.exists(p) else []

    def _fold(self) -> tuple[str | None, DataFrame | None]:
        """The last fold, and the ids that it holds."""
        last = max(self._names("fold-"), default=None)
        return last, None if last is None else self.spark.read.parquet(f"{self.path}/{last}").where("batch is not null").select("batch")

    def _open(self) -> list[str]:
        """Batches that the last fold doesn't hold."""
        names = [n.removeprefix("batch-") for n in self._names("batch-")]
        _, held = self._fold()
        inside = {r[0] for r in held.where(F.col("batch").isin(names)).collect()} if names and held is not None else set()
        return [n for n in names if n not in inside]

    def committed(self, batch: str) -> bool:
        if self._done(f"batch-{batch}"):
            return True
        _, held = self._fold()
        return held is not None and not held.where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add signed deltas (source, lang, tokenizer, n_docs, n_tokens, n_chars) under a batch id; False if it was there."""
        if self.committed(batch):
            return False
        summed(deltas).withColumn("batch", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def compact(self) -> None:
        """Fold the last fold and the batches since then into a new one; nothing new, nothing done."""
        new, (last, held) = self._open(), self._fold()
        if new:
            ids = self.spark.createDataFrame([(i,) for i in new], "batch string")
            ids = ids if held is None else held.unionByName(ids)
            rows = self.totals().withColumn("batch", F.lit(None).cast("string")).unionByName(ids, allowMissingColumns=True)
            rows.write.mode("overwrite").parquet(f"{self.path}/fold-{int(last.removeprefix('fold-')) + 1 if last else 1:012d}")

    def clear(self) -> None:
        """Remove what the last fold replaces. Not while others read older totals."""
        open_, (last, _) = set(self._open()), self._fold()
        for n in self._names("batch-") + self._names("fold-"):
            if n != last and n.removeprefix("batch-") not in open_:
                fs, p = self._fs(f"{self.path}/{n}")
                fs.delete(p, True)

    def totals(self) -> DataFrame:
        last, _ = self._fold()
        names = [*([last] if last else []), *(f"batch-{n}" for n in self._open())]
        if not names:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        rows = self.spark.read.parquet(*(f"{self.path}/{n}" for n in names)).where("batch is null and tokenizer is not null")
        return summed(rows).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a history of batches over all documents: all are inserted under the first tokenizer version, in two batches
    of which one is sent twice; then of equal texts in the same source and language all but one are deleted; then what is left
    is counted by the second version too, and German texts are revised: only the second version's counts stay.

    Equal texts are summed before they meet, so a text that many rows repeat costs one row a task.
    """
    old, new = tokenizers()
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    counts = cut(counted(docs, tokenizers(), ("doc_id", "h")))
    first = counts.where(F.col("tokenizer") == old)
    even = F.coalesce(F.col("doc_id") % 2, F.lit(0)) == 0
    equal = cut(counts.groupBy(*KEYS, "h").agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens"), F.max("n_chars").alias("n_chars")))
    kept = lambda version: equal.where(F.col("tokenizer") == version)
    copies = kept(old).where("n > 1").select(*KEYS, (1 - F.col("n")).alias("n_docs"), *(((1 - F.col("n")) * F.col(c)).alias(c) for c in ("n_tokens", "n_chars")))
    roll = Rollup(spark)
    roll.commit("insert-0", signed(first.where(even), 1))
    roll.commit("insert-1", signed(first.where(~even), 1))
    roll.commit("insert-0", signed(first.where(even), 1))
    roll.commit("delete-copies", copies)
    roll.compact()
    roll.commit("insert-1", signed(first.where(~even), 1))
    roll.commit("version-2", signed(kept(new).where(~F.coalesce(F.col("lang") == "de", F.lit(False))), 1))
    german = lambda version: kept(version).where("lang = 'de'")
    roll.commit("revise-german", signed(german(old), -1).unionByName(signed(german(new), 1)))
    roll.compact()
    return roll.totals()
