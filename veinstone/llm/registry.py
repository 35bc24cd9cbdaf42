"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from veinstone.llm import embedding_dedup, near_dedup
from veinstone.llm.chat import op4_chat
from veinstone.llm.decontamination import op2_decontamination
from veinstone.llm.embedding_dedup import op10_embedding_dedup
from veinstone.llm.near_dedup import op9_near_dedup
from veinstone.llm.packing import op3_packing
from veinstone.llm.pii import op6_pii
from veinstone.llm.quality import op7_quality
from veinstone.llm.token_counts import op8_token_counts
from veinstone.llm.toxicity import op5_toxicity
from veinstone.llm.url_filters import op1_url_filters
from veinstone.llm.url_filters import oracle as url_filter_sql

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_near_dedup": op9_near_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
}

#: The others need models or tokenizers, beyond SQL's reach; their tests compare with brute force.
ORACLES: dict[str, str] = {
    "op1_url_filters": url_filter_sql(),
    "op9_near_dedup": near_dedup.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
}
