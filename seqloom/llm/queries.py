"""The registered queries of this subpackage and their SQL; the pipeline registers itself."""

from __future__ import annotations

from seqloom.llm import alignment, bpe, language_id, metric_tree, mixing, mpeg_audio, pii, quality_model, quality_rules, simhash, token_files, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_pii": pii.op2_pii,
    "op3_language_id": language_id.op3_language_id,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_files": token_files.op5_token_files,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_mpeg_audio": mpeg_audio.op8_mpeg_audio,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_top_k": metric_tree.op11_top_k,
    "op12_alignment": alignment.op12_alignment,
    "ledger_ablations": quality_rules.ledger_ablations,
}

ORACLES = {
    "op1_url_filters": url_filter.OP1_SQL,
    "op2_pii": pii.OP2_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_top_k": metric_tree.OP11_SQL,
    "ledger_ablations": quality_rules.ABLATIONS_SQL,
}
