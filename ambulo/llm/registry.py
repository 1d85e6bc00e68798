"""The subpackage's queries and, where SQL can express them, their DuckDB SQL."""

from . import clusters, fingerprints, linededup, media, mixing, neardup, pii, prefixes, quality, sentencepieces, sharding, tokenfiles, toxicity

QUERIES = {
    "op1_histogram_sort": sharding.op1_histogram_sort,
    "op2_minhash_bbit": neardup.op2_minhash_bbit,
    "op3_tar_shards": media.op3_tar_shards,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_semi_markov": pii.op5_semi_markov,
    "op6_invertible_sketch": fingerprints.op6_invertible_sketch,
    "op7_dac": tokenfiles.op7_dac,
    "op8_line_windows": linededup.op8_line_windows,
    "op9_nbest": sentencepieces.op9_nbest,
    "op10_nb_ngrams": toxicity.op10_nb_ngrams,
    "op11_histogram_trees": quality.op11_histogram_trees,
    "op12_delta_lloyd": clusters.op12_delta_lloyd,
    "op13_prefix_trie": prefixes.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_histogram_sort": sharding.OP1_SQL,
    "op2_minhash_bbit": neardup.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op8_line_windows": linededup.OP8_SQL,
    "op12_delta_lloyd": clusters.OP12_SQL,
    "op13_prefix_trie": prefixes.OP13_SQL,
}
