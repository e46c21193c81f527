"""All queries of the subpackage."""

from panelwright.llm import (  # noqa: F401
    chat, decontaminate, jaccard, licenses, merkle, packing, quality, repeats, search, shards, tokens, toxicity, warc,
)
from panelwright.llm import twins
from panelwright.llm.registry import QUERIES, SQL

SQL |= {"op4_jaccard_join": twins.JACCARD, "op6_quality_rules": twins.QUALITY, "op8_licenses": twins.LICENSES,
        "op11_merkle": twins.MERKLE, "op12_search": twins.SEARCH, "op13_warc": twins.WARC}

__all__ = ["QUERIES", "SQL"]
