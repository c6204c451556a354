"""Queries and SQL of the training-data operators."""
from . import chat, decontaminate, divergence, html_text, jaccard_join, language_id, licenses, mixing, ogg, quality_rules, rolling_median, token_store, toxicity


def queries() -> dict:
    return {
        "op1_token_output": token_store.op1, "op2_chat_format": chat.op2, "op3_mixing": mixing.op3, "op4_decontamination": decontaminate.op4, "op5_toxicity": toxicity.op5,
        "op6_html_text": html_text.op6, "op7_ogg_media": ogg.op7, "op8_license_scan": licenses.op8, "op9_jaccard_join": jaccard_join.op9, "op10_language_id": language_id.op10, "op11_quality_rules": quality_rules.op11, "op12_rolling_median": rolling_median.op12, "op13_divergence": divergence.op13,
    }


def oracle_sql() -> dict:
    return {"op2_chat_format": chat.ORACLE, "op4_decontamination": decontaminate.ORACLE, "op12_rolling_median": rolling_median.ORACLE, "op13_divergence": divergence.ORACLE}
