"""Every query of this subpackage, and the SQL that gives the same rows where there is one."""

from lumenpair.llm import benchmark, bpe, exact_dedup, line_dedup, near_dedup, phrase_dedup, quality, token_counts, toxicity, url_filter

MODULES = (benchmark, quality, exact_dedup, toxicity, near_dedup, line_dedup, bpe, token_counts, phrase_dedup, url_filter)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
