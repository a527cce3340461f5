"""The registered queries of the corpus operators."""

from __future__ import annotations

from wavefield.llm import chat_format, language_id, line_dedup, maxscore, mixing, ngram_join, packing, periodic_runs, quality_crf, quality_rules, source_divergence, token_files, toxicity

_MODULES = (quality_rules, token_files, packing, chat_format, maxscore, language_id, quality_crf, mixing, ngram_join, line_dedup, periodic_runs, toxicity, source_divergence)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
