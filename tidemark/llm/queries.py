"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tidemark.llm import q_align, q_bpe, q_centroids, q_decon, q_embed, q_mix, q_simhash, q_suffix, q_text

MODULES = [q_align, q_bpe, q_centroids, q_decon, q_embed, q_mix, q_simhash, q_suffix, q_text]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
