"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from undula.llm import chat, decontaminate, html_text, language, mixing, pii, quality, secrets, simhash, spelling, topk, toxicity, vector_codes


def queries() -> dict:
    found = {f.__name__: f for f in (simhash.op1_simhash, html_text.op2_html, pii.op3_pii, decontaminate.op4_decontaminate, mixing.op5_mixing, secrets.op6_secrets, quality.op7_quality, chat.op8_chat, topk.op9_topk, toxicity.op10_toxicity, spelling.op11_spelling, vector_codes.op12_vector_codes, language.op13_language)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE_SQL, "op8_chat": chat.ORACLE, "op9_topk": topk.ORACLE, "op11_spelling": spelling.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
