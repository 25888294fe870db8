"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from lapwing.llm import compaction, decontamination, embedding_dedup, filter_audit, line_dedup, mixing, pseudo_likelihood, quality, resampling, simhash, suffix_dedup, tokens, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_compaction": compaction.op2_compaction,
    "op3_token_output": tokens.op3_token_output,
    "op4_curriculum_mix": mixing.op4_curriculum_mix,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pseudo_likelihood": pseudo_likelihood.op9_pseudo_likelihood,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_resampling": resampling.op12_resampling,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}
ORACLE = {
    "op2_compaction": compaction.OP2_SQL,
    "op4_curriculum_mix": mixing.OP4_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_embedding_dedup": embedding_dedup.OP13_SQL,
}
