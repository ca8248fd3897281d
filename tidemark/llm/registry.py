"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op6_byte_bpe
from .centroid_clustering import OP12_SQL, op12_centroid_clustering
from .crf_quality import op1_crf_quality
from .hashing_search import op4_multi_index_hashing
from .jaccard_join import op10_jaccard_join
from .packing import op9_best_fit_packing
from .segment_search import OP2_SQL, op2_exact_top_k
from .sharding import op13_sharding
from .suffix_array_dedup import op3_suffix_array_dedup
from .suffix_tree_dedup import op7_suffix_tree_dedup
from .toxicity import op5_toxicity
from .warc import op8_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_crf_quality": op1_crf_quality,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_tree_dedup": op7_suffix_tree_dedup,
    "op8_warc": op8_warc,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL = {"op2_exact_top_k": OP2_SQL, "op12_centroid_clustering": OP12_SQL}
