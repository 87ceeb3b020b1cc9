"""Queries of this subpackage and their SQL."""

from cellsift.llm import bpe, decontaminate, density, langid, ngram_join, polytope, quality, shards, toxicity, warc

MODULES = [ngram_join, toxicity, warc, langid, shards, decontaminate, polytope, density, quality, bpe]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
