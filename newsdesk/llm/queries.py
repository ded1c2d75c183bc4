"""The registered queries of this subpackage, and SQL restatements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsdesk.llm import cover_search, lexical_search
from newsdesk.llm.fingerprints import op8_fingerprints
from newsdesk.llm.ngram_jaccard import op3_ngram_jaccard
from newsdesk.llm.packing import op6_best_fit_packing
from newsdesk.llm.periodic_runs import op11_periodic_runs
from newsdesk.llm.pieces import op1_sentencepiece
from newsdesk.llm.quality import op10_quality
from newsdesk.llm.substring_dedup import op5_substring_dedup
from newsdesk.llm.suffix_dedup import op4_suffix_dedup
from newsdesk.llm.token_counts import op2_token_counts
from newsdesk.llm.token_planes import op12_token_planes
from newsdesk.llm.toxicity import op7_toxicity

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_cover_search": cover_search.op9_cover_search,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_planes": op12_token_planes,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

LLM_ORACLE: dict[str, str] = {"op9_cover_search": cover_search.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
