"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, embedding_dedup, jaccard_join, line_dedup, packing, sharding, token_counts, topk_search, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_topk_search": topk_search.op2_topk_search,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_sharding": sharding.op4_sharding,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_warc": warc.op8_warc,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_packing": packing.op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": topk_search.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_warc": warc.ORACLE}
