"""Queries of the subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from .bpe_tree import op7_bpe_tree
from .embedding_dedup import op3_pca_tiles
from .lm_scoring import op9_trie_scores
from .minhash import op5_minmax_hash
from .packing import op10_packing_nnls
from .perplexity_rules import op1_kneser_ney_bands
from .quality_sampling import op4_importance_resampling
from .secrets import op6_linked_secrets
from .toxicity import op2_toxicity_nbsvm
from .wordpiece import op8_longest_match

QUERIES = {
    "op1_kneser_ney_bands": op1_kneser_ney_bands,
    "op2_toxicity_nbsvm": op2_toxicity_nbsvm,
    "op3_pca_tiles": op3_pca_tiles,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_minmax_hash": op5_minmax_hash,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_bpe_tree": op7_bpe_tree,
    "op8_longest_match": op8_longest_match,
    "op9_trie_scores": op9_trie_scores,
    "op10_packing_nnls": op10_packing_nnls,
}

ORACLES: dict[str, str] = {}
