"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding_dedup, fill_middle, fingerprints, langid, line_dedup, mixing, packing, periodic_runs, quality, simhash, token_shards, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": langid.op4_language_id,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_token_shards": token_shards.op7_token_shards,
    "op8_simhash": simhash.op8_simhash,
    "op9_top_k": topk.op9_top_k,
    "op10_quality": quality.op10_quality,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op9_top_k": topk.OP9_SQL,
    "op11_fingerprints": fingerprints.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
}
