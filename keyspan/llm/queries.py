"""The subpackage's queries and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyspan.llm.embeddings import OP2_SQL, op2_embedding_dedup
from keyspan.llm.html import op9_html_text
from keyspan.llm.language import op3_language_id
from keyspan.llm.lm import op7_lm_scoring
from keyspan.llm.minhash import OP6_SQL, op6_minhash_dedup
from keyspan.llm.mixing import op10_mix_sources
from keyspan.llm.packing import op4_best_fit_packing
from keyspan.llm.quality import op5_quality_classifier
from keyspan.llm.token_store import op8_token_store
from keyspan.llm.topk import OP1_SQL, op1_topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_embedding_dedup, op3_language_id, op4_best_fit_packing, op5_quality_classifier, op6_minhash_dedup, op7_lm_scoring, op8_token_store, op9_html_text, op10_mix_sources)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op6_minhash_dedup": OP6_SQL}
