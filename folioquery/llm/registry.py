"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from . import bottomk_dedup, disclosure, line_dedup, packing, pivot_search, poisson_mix, sphere_dedup, suffix_dedup, token_rollup, toxic_grammar

QUERIES = {
    "op1_token_rollup": token_rollup.query,
    "op2_pivot_topk": pivot_search.query,
    "op3_sphere_dedup": sphere_dedup.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_poisson_mix": poisson_mix.query,
    "op6_best_fit_packing": packing.query,
    "op7_disclosure_pii": disclosure.query,
    "op8_line_dedup": line_dedup.query,
    "op9_bottomk_dedup": bottomk_dedup.query,
    "op10_toxic_grammar": toxic_grammar.query,
}
SQL = {"op5_poisson_mix": poisson_mix.SQL, "op8_line_dedup": line_dedup.SQL}
