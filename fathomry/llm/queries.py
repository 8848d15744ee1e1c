"""The registered queries of this subpackage and their SQL where there is some."""

from __future__ import annotations

from .archives import OP5_SQL, op5_arc_to_warc
from .class_model import op9_class_bigrams
from .fingerprints import op8_multiset_fingerprints
from .licences import op1_licence_scan
from .main_text import op10_best_region_text
from .near import op6_minmax_near_duplicates
from .packing import op7_pattern_packing
from .quality import op2_importance_resampling
from .tiling import op3_greedy_tiling
from .token_files import op4_token_files

QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_greedy_tiling": op3_greedy_tiling,
    "op4_token_files": op4_token_files,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_minmax_near_duplicates": op6_minmax_near_duplicates,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_multiset_fingerprints": op8_multiset_fingerprints,
    "op9_class_bigrams": op9_class_bigrams,
    "op10_best_region_text": op10_best_region_text,
}

ORACLE_SQL: dict[str, str] = {
    "op5_arc_to_warc": OP5_SQL,
}
