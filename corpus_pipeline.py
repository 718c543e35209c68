"""A training corpus from raw documents, in stages that are each written to Parquet and read again.

All stages take whole rows as they come: null, empty and very long texts and null ids pass through like others unless a stage says
otherwise, rows that are repeated are decided alike, an empty table gives an empty one, and columns beyond ``COLUMNS``, whatever their
names, are not read and not passed on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridjobs.functions.session import cut, shared_dir
from gridjobs.llm import bpe, decontaminate, secrets, simhash, toxicity
from gridjobs.llm.tables import table

#: Ids up to which those to be dropped are broadcast (40 MB).
BROADCAST_IDS = 5_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer doesn't reject.

    The scorer is learned from the tables' labelled rows, not from ``docs``. A null text is scored as an empty one and kept as null; texts of
    any length are scored whole; a score of just the threshold is rejected.
    """
    scored = toxicity.toxicity(docs, toxicity.fit_on_tables(spark, sf_dir), keep=COLUMNS)
    return scored.where(F.col("score") < toxicity.PREDICT).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows that repeat an id one stays, and rows without
    an id, which no group can name, all stay.

    The ids that go are broadcast where they number at most ``BROADCAST_IDS``, and joined by id beyond that.
    """
    found = simhash.near_duplicates(docs)
    ids = found.groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count("*").alias("n")).where("doc_id is not null")
    odd = cut(ids.where("doc_id <> component_id or n > 1"))
    n = odd.count()
    sized = lambda df: F.broadcast(df) if n <= BROADCAST_IDS else df
    plain = docs.join(sized(odd.select("doc_id")), "doc_id", "left_anti").select(*COLUMNS)
    again = odd.where("doc_id = component_id").select("doc_id")
    if again.isEmpty():
        return plain
    return plain.unionByName(docs.join(sized(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; of very long texts every passage is compared; an empty benchmark drops nothing.
    """
    counted = decontaminate.with_item_counts(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return counted.where("n_items = 0").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars becomes the length of the masked text.

    A null text stays null, with a null length. Texts of any length are searched whole, and rows with the same text are masked alike.
    """
    found = secrets.secret_spans(docs, keep=tuple(c for c in COLUMNS if c not in ("text", "n_chars")), masked=True)
    return found.withColumnRenamed("masked", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed as little-endian unsigned 32-bit integers, with doc_id, lang, source and n_tokens.

    Null and empty texts have no ids. Very long texts are cut into segments for separate tasks and joined again; the ids of one document
    stand in one row, which bounds a text to some 500 million tokens.
    """
    coded = bpe.encode_texts(docs, keep=("doc_id", "lang", "source"), keep_ids=True)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]
#: SQL has no way to express the stages' models, tries and encoders; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder before the next one reads it, so a lost executor repeats
    tasks of one stage only; each run has a folder of its own. What a stage gives for odd rows is said there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
