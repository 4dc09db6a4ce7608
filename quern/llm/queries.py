"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.bpe import op1_byte_bpe
from quern.llm.caps import op3_cap_filters
from quern.llm.jaccard import op2_ngram_jaccard
from quern.llm.matroska import op5_media_matroska
from quern.llm.mixing import OP6_SQL, op6_mix_sources
from quern.llm.quality import op10_quality_qda
from quern.llm.rans import op7_tokens_rans
from quern.llm.suffixes import op9_suffix_dedup
from quern.llm.toxicity import op4_toxicity
from quern.llm.urls import op8_url_language_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_cap_filters": op3_cap_filters,
    "op4_toxicity": op4_toxicity,
    "op5_media_matroska": op5_media_matroska,
    "op6_mix_sources": op6_mix_sources,
    "op7_tokens_rans": op7_tokens_rans,
    "op8_url_language_model": op8_url_language_model,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_qda": op10_quality_qda,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mix_sources": OP6_SQL,
}
