"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op8_ann
from .byte_dedup import op9_suffix_dedup
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .ngram_lm import op10_ngram_lm
from .packing import op5_packing
from .pieces import op7_sentencepiece
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import OP6_SQL, op6_quality_rules
from .simhash import op4_simhash_bktree
from .token_counts import op3_token_counts
from .toxicity import op1_toxicity_crf
from .word_dedup import op2_word_window_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity_crf, op2_word_window_dedup, op3_token_counts, op4_simhash_bktree, op5_packing, op6_quality_rules, op7_sentencepiece, op8_ann, op9_suffix_dedup, op10_ngram_lm, op11_prefix_trie, op12_exact_dedup, op13_filter_audit)
}

SQL = {"op6_quality_rules": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_filter_audit": OP13_SQL}
