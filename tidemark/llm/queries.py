"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from .cost_packing import query_cost_packing
from .html_text import query_html
from .maxent_lm import query_language_model
from .mixing import query_mixing
from .neardup import query_near_duplicates
from .packing import query_packing
from .pii import query_pii
from .quality import query_quality
from .secrets import query_secrets
from .topk import SQL_TOP_K, query_top_k
from .spelling import SQL_SPELLING, query_spelling
from .toxicity import query_toxicity
from .tree_codes import SQL_TREE_CODES, query_tree_codes

QUERIES = {
    "op1_temperature_mixing": query_mixing,
    "op2_bin_slack_packing": query_packing,
    "op3_shape_field_pii": query_pii,
    "op4_adaptive_quality": query_quality,
    "op5_bag_minhash": query_near_duplicates,
    "op6_owned_secrets": query_secrets,
    "op7_hashed_maxent_lm": query_language_model,
    "op8_fuzzy_lexicon_toxicity": query_toxicity,
    "op9_pivot_top_k": query_top_k,
    "op10_layout_html": query_html,
    "op11_dual_tree_lloyd": query_tree_codes,
    "op12_spelling_tiles": query_spelling,
    "op13_cost_packing": query_cost_packing,
}

ORACLE_SQL = {"op9_pivot_top_k": SQL_TOP_K, "op11_dual_tree_lloyd": SQL_TREE_CODES, "op12_spelling_tiles": SQL_SPELLING}
