"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from weftline.llm import centroids, decontamination, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, spelling, suffix_arrays, suffix_trees, token_counts, warc

MODULES = (line_dedup, token_counts, near_dedup, quality_rules, suffix_trees, quality_classifier, decontamination, suffix_arrays, packing, warc, sharding, centroids, spelling)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
