"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import bpe, imatch, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, topk_ip, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_repeated_spans": substring_dedup.op5_repeated_spans,
    "op6_line_spread": line_dedup.op6_line_spread,
    "op7_imatch": imatch.op7_imatch,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_top_inner_products": topk_ip.op9_top_inner_products,
    "op10_shards": sharding.op10_shards,
}

ORACLE_SQL = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op4_source_mix": mixing.OP4_SQL,
    "op5_repeated_spans": substring_dedup.OP5_SQL,
    "op6_line_spread": line_dedup.OP6_SQL,
    "op9_top_inner_products": topk_ip.OP9_SQL,
    "op10_shards": sharding.OP10_SQL,
}
