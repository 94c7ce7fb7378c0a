"""All queries of the llm subpackage and their SQL."""

from __future__ import annotations

from loomdex.llm import p1_language, p2_seen, p3_copies, p4_lookalike, p5_frequency, p6_distinctive, p7_containers, p8_mixture, p9_sentences

_MODULES = [p1_language, p2_seen, p3_copies, p4_lookalike, p5_frequency, p6_distinctive, p7_containers, p8_mixture, p9_sentences]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: f for m in _MODULES for k, f in m.SQL.items()}
