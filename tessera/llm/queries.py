"""The operators' queries by name, and SQL where it can express one."""

from __future__ import annotations

from tessera.llm.bpe import op8_bpe_round_trip
from tessera.llm.embeddings import op10_embedding_groups
from tessera.llm.packing import op2_packing
from tessera.llm.secrets import op3_secrets
from tessera.llm.simhash import op7_simhash
from tessera.llm.token_counts import op5_token_counts
from tessera.llm.token_store import op4_token_store
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.url_filter import ORACLE as URL_ORACLE
from tessera.llm.url_filter import op6_url_filter
from tessera.llm.winnowing import op9_winnowing

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_token_store": op4_token_store,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_winnowing": op9_winnowing,
    "op10_embedding_groups": op10_embedding_groups,
}

ORACLES: dict[str, str] = {"op6_url_filter": URL_ORACLE}
