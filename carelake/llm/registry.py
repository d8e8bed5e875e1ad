"""Queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from carelake.llm.chat import OP9_SQL, op9_chat_format
from carelake.llm.chosen_path import op4_ngram_jaccard_join
from carelake.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from carelake.llm.html_extract import op2_html_extraction
from carelake.llm.licenses import op10_license_scan
from carelake.llm.mixing import OP6_SQL, op6_mixing
from carelake.llm.packing import op3_best_fit_packing
from carelake.llm.prefix_trie import op11_prefix_trie
from carelake.llm.quality_rules import op5_quality_rules
from carelake.llm.runs import op12_periodic_runs
from carelake.llm.secrets import op7_secret_scan
from carelake.llm.token_files import op8_token_files
from carelake.llm.toxicity import op13_toxicity

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_html_extraction, op3_best_fit_packing, op4_ngram_jaccard_join, op5_quality_rules,
    op6_mixing, op7_secret_scan, op8_token_files, op9_chat_format, op10_license_scan,
    op11_prefix_trie, op12_periodic_runs, op13_toxicity)}

# Where SQL can't say it, tests/llm/ hold the query against brute force.
ORACLE = {
    "op1_exact_dedup": OP1_SQL,
    "op6_mixing": OP6_SQL,
    "op9_chat_format": OP9_SQL,
}
