"""The queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

import importlib

# query name -> module of its function ``op<N>`` (and ``SQL``, where there is one)
_MODULES = {
    "op1_fingerprints": "fingerprints",
    "op2_toxicity": "toxicity",
    "op3_jaccard_join": "jaccard",
    "op4_url_filter": "urlfilter",
    "op5_decontamination": "decontaminate",
    "op6_bpe": "bpe",
    "op7_secret_scan": "secrets",
    "op8_quality": "quality",
    "op9_chat_format": "chat",
    "op10_lm_scoring": "lm",
    "op11_vector_codes": "vectors",
    "op12_fill_in_middle": "fim",
    "op13_token_files": "shards",
}


def load():
    """(queries, SQL by query name)."""
    queries, oracles = {}, {}
    for name, module in _MODULES.items():
        found = importlib.import_module(f"measurelens.llm.{module}")
        queries[name] = getattr(found, name.split("_")[0])
        if sql := getattr(found, "SQL", None):
            oracles[name] = sql
    return queries, oracles
