"""The queries of this folder's operators, and the SQL of those that have one."""

from __future__ import annotations

from .binary import op9_token_files
from .decontaminate import op10_decontaminate
from .langid import op7_language_id
from .lattice import op2_lattice_near_vectors
from .mixing import op6_mix_sources
from .ngram_join import op3_ngram_jaccard_join
from .oracles import ORACLE_SQL
from .prefix_trie import op11_prefix_trie
from .quality import op5_quality_resample
from .rules import op12_quality_rules
from .search import op13_ranked_search
from .substring import op8_substring_dedup
from .tokens import op1_token_counts
from .urlfilter import op4_url_filter

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lattice_near_vectors, op3_ngram_jaccard_join, op4_url_filter, op5_quality_resample, op6_mix_sources, op7_language_id, op8_substring_dedup, op9_token_files, op10_decontaminate, op11_prefix_trie, op12_quality_rules, op13_ranked_search)}

__all__ = ["ORACLE_SQL", "QUERIES"]
