"""The pipeline's stages on a small table with nulls, repeated rows and copies."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from gridjobs.llm import decontaminate


def small(spark, tmp_path):
    words = "river stone walks green table window paper letter summer garden".split()
    text = lambda n: " ".join(words[(n * 7 + k * (n % 9 + 1)) % 10] + str((n * k) % 13) for k in range(60))
    item = "What is the colour of the old bridge over the river\nIt was painted green in the year of the flood"
    rows = [(n, text(n) + (" idiot moron idiot" if n % 5 == 0 else "")) for n in range(100)]
    rows += [(200, text(1)), (201, text(2) + "\n" + item), (202, text(3) + " token = abcdef012345"), (203, None), (204, ""), (None, text(4) + " other end of it"), (7, text(7)), (205, "river " * 60_000 + "password = hunter2hunter2"), (206, "x" * 150_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1, int(n % 5 == 0)) for n in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), rows


def test_stages_drop_what_they_should_and_nothing_else(spark, tmp_path):
    docs, sf, rows = small(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))
    calm = ids(stages["toxicity"](spark, docs, sf))
    assert calm == sorted((i for i, t in rows if not re.search("idiot", t or "")), key=lambda x: (x is None, x))
    kept = ids(stages["near_duplicates"](spark, docs, sf))
    assert 200 not in kept and 1 in kept and kept.count(7) == 1 and None in kept and {203, 204} & set(kept) == {203}
    assert set(ids(stages["decontamination"](spark, docs, sf))) == {i for i, _ in rows} - {201}
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids(found) == [201]
    masked = {r["doc_id"]: r["text"] for r in stages["secrets"](spark, docs, sf).collect()}
    assert masked[205] == "river " * 60_000 + "[assign]" and masked[206] == "x" * 150_000
    assert masked[202].endswith(" [assign]") and masked[203] is None and masked[1] == rows[1][1]
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs.limit(0), sf).count() == 0
        assert tuple(stages[name](spark, docs.withColumn("extra", F.lit(1)), sf).columns) == corpus_pipeline.COLUMNS
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids"} and out.count() < len(rows)
    assert out.where("doc_id in (205, 206)").count() == 2
