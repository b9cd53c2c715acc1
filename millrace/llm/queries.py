"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm.html_text import op7_html_extraction
from millrace.llm.langid import op10_language_id
from millrace.llm.lattice import op4_lattice_near_dups
from millrace.llm.mixing import op9_mixing
from millrace.llm.packing import op5_best_fit_packing
from millrace.llm.simhash import op2_simhash
from millrace.llm.sstable import op1_token_output
from millrace.llm.token_counts import op8_token_counts
from millrace.llm.topk import OP3_SQL, op3_exact_topk
from millrace.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_simhash": op2_simhash,
    "op3_exact_topk": op3_exact_topk,
    "op4_lattice_near_dups": op4_lattice_near_dups,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

ORACLE: dict[str, str] = {"op3_exact_topk": OP3_SQL}
