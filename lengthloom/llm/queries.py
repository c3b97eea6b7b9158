"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

from . import hmm, jaccard, language, mixing, neardup, packing, privacy, quality, repair, repeats, search, sharding, whitening


def queries() -> dict:
    return {
        "op1_histogram_packing": packing.query,
        "op2_sampled_splitters": sharding.query,
        "op3_pareto_mix": mixing.query,
        "op4_hidden_markov": hmm.query,
        "op5_previous_factors": repeats.query,
        "op6_feistel_pseudonyms": privacy.query,
        "op7_kneser_ney": language.query,
        "op8_kd_tree_search": search.query,
        "op9_repetition_rules": quality.query,
        "op10_bayesian_jaccard": jaccard.query,
        "op11_small_world_graphs": neardup.query,
        "op12_duckdb_repair": repair.query,
        "op13_two_pass_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_kd_tree_search": search.ORACLE, "op12_duckdb_repair": repair.ORACLE}
