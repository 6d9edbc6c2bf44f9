"""The registered queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from tunedata.llm import collocations, embedding_dedup, license_scan, mixing, neighbour_graph, packing, quality_crf, rule_ledger, simhash, suffix_dedup, toxicity, warc, whitening

QUERIES = {
    "op3_pivot_index": embedding_dedup.op3_pivot_index,
    "op7_license_scan": license_scan.op7_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op2_quality_crf": quality_crf.op2_quality_crf,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op8_warc_index": warc.op8_warc_index,
    "op1_packing": packing.op1_packing,
    "op6_simhash": simhash.op6_simhash,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op10_rule_ledger": rule_ledger.op10_rule_ledger,
    "op11_nn_descent": neighbour_graph.op11_nn_descent,
    "op12_collocations": collocations.op12_collocations,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op8_warc_index": warc.ORACLE_SQL,
    "op5_curriculum_mix": mixing.ORACLE_SQL,
    "op10_rule_ledger": rule_ledger.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
}
