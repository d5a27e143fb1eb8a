"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from recordloom.llm import cover_tree
from recordloom.llm.bin_slack import op8_bin_slack
from recordloom.llm.context_mixing import op5_context_mixing
from recordloom.llm.cover_tree import op10_cover_tree
from recordloom.llm.language_id import op6_language_id
from recordloom.llm.piece_bpe import op4_piece_bpe
from recordloom.llm.quality_rules import op1_quality_rules
from recordloom.llm.secret_scan import op2_secret_scan
from recordloom.llm.simhash_dedup import op3_simhash_dedup
from recordloom.llm.token_counts import op9_token_counts
from recordloom.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_simhash_dedup, op4_piece_bpe, op5_context_mixing, op6_language_id, op7_toxicity, op8_bin_slack, op9_token_counts, op10_cover_tree)}

ORACLE_SQL = {"op10_cover_tree": cover_tree.ORACLE_SQL}
