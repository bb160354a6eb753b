"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pagetide.llm.epsgrid import op3_epsilon_grid
from pagetide.llm.filter_audit import OP13_SQL, op13_filter_audit
from pagetide.llm.htmltext import op12_html_text
from pagetide.llm.licenses import op2_license_scan
from pagetide.llm.minhash import op1_minhash_dedup
from pagetide.llm.mixing import OP4_SQL, op4_mixing
from pagetide.llm.packing import op10_packing
from pagetide.llm.pii import op5_pii
from pagetide.llm.quality import op7_quality_rules
from pagetide.llm.runindex import op6_run_index
from pagetide.llm.substrings import op9_substring_dedup
from pagetide.llm.tokens import op8_token_counts
from pagetide.llm.trie import OP11_SQL, op11_prefix_trie

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_epsilon_grid": op3_epsilon_grid,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_run_index": op6_run_index,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_html_text": op12_html_text,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
