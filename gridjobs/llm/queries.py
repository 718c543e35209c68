"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridjobs.llm import centroids, divergence, pii, token_counts, topk
from gridjobs.llm.bpe import op7_bpe
from gridjobs.llm.decontaminate import op2_decontaminate
from gridjobs.llm.html import op3_html
from gridjobs.llm.licenses import op9_licenses
from gridjobs.llm.piece_bpe import op11_pieces
from gridjobs.llm.secrets import op4_secrets
from gridjobs.llm.simhash import op8_simhash
from gridjobs.llm.toxicity import op6_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_decontaminate": op2_decontaminate,
        "op3_html": op3_html,
        "op4_secrets": op4_secrets,
        "op5_pii": pii.op5_pii,
        "op6_toxicity": op6_toxicity,
        "op7_bpe": op7_bpe,
        "op8_simhash": op8_simhash,
        "op9_licenses": op9_licenses,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_pieces": op11_pieces,
        "op12_divergence": divergence.op12_divergence,
        "op13_clusters": centroids.op13_clusters,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.ORACLE, "op12_divergence": divergence.ORACLE, "op13_clusters": centroids.ORACLE}
