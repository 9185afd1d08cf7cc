"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, licenses, neardup, packing, prefixes, repair, repeats, search, secrets, sharding, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_randomness_battery": secrets.op1_randomness_battery,
    "op2_minimum_bin_slack": packing.op2_minimum_bin_slack,
    "op3_minhash_components": neardup.op3_minhash_components,
    "op4_classifier_chain": toxicity.op4_classifier_chain,
    "op5_diagonal_voting": licenses.op5_diagonal_voting,
    "op6_virtual_slots": sharding.op6_virtual_slots,
    "op7_voronoi_join": topk.op7_voronoi_join,
    "op8_interval_tree": repeats.op8_interval_tree,
    "op9_distinct_words": bpe.op9_distinct_words,
    "op10_consistent_parsing": fingerprints.op10_consistent_parsing,
    "op11_automaton_scan": search.op11_automaton_scan,
    "op12_prefix_table": prefixes.op12_prefix_table,
    "op13_edit_lattice": repair.op13_edit_lattice,
}

#: Spans, maps, sketches and digests of byte ranges have no SQL form; tests hold these queries against brute force.
ORACLE_SQL: dict[str, str] = {"op7_voronoi_join": topk.ORACLE_SQL, "op11_automaton_scan": search.ORACLE_SQL}
