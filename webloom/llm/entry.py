"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import brown, decontamination, jaccard, mining, mixing, nbsvm, pieces, quality_rules, repair, repeats, secrets, sharding, topk

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_secrets": secrets.op2_secrets,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_sharding": sharding.op4_sharding,
    "op5_lm_scoring": brown.op5_lm_scoring,
    "op6_topk": topk.op6_topk,
    "op7_pieces": pieces.op7_pieces,
    "op8_quality_classifier": nbsvm.op8_quality_classifier,
    "op9_mixing": mixing.op9_mixing,
    "op10_repeats": repeats.op10_repeats,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_hard_negatives": mining.op13_hard_negatives,
}
ORACLES = {"op4_sharding": sharding.OP4_SQL, "op6_topk": topk.OP6_SQL, "op9_mixing": mixing.OP9_SQL, "op11_decontamination": decontamination.OP11_SQL, "op12_conversation_repair": repair.OP12_SQL, "op13_hard_negatives": mining.OP13_SQL}
