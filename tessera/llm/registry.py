"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.html import op4_html
from tessera.llm.language import op2_language
from tessera.llm.near import op9_near_duplicates
from tessera.llm.packing import op5_pack
from tessera.llm.quality import op7_quality
from tessera.llm.repeats import op6_repeats
from tessera.llm.secrets import op10_secrets
from tessera.llm.sql import NEAR_SQL, REPEATS_SQL, SECRETS_SQL
from tessera.llm.topk import TOP_K_SQL, op3_top_k
from tessera.llm.unigram import op1_sentencepiece, op8_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_top_k": op3_top_k,
    "op4_html": op4_html,
    "op5_pack": op5_pack,
    "op6_repeats": op6_repeats,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_secrets": op10_secrets,
}

SQL = {"op3_top_k": TOP_K_SQL, "op6_repeats": REPEATS_SQL, "op9_near_duplicates": NEAR_SQL, "op10_secrets": SECRETS_SQL}
