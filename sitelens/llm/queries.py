"""Registered queries of this folder and their check SQL."""

from __future__ import annotations

from sitelens.llm import chat, decontaminate, html_text, jaccard, lm, merkle, packing, pii, secrets, spelling, token_files, topk, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_html_text": html_text.op3_html_text,
    "op4_packing": packing.op4_packing,
    "op5_topk": topk.op5_topk,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_lm": lm.op7_lm,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_files": token_files.op9_token_files,
    "op10_secrets": secrets.op10_secrets,
    "op11_merkle": merkle.op11_merkle,
    "op12_spelling": spelling.op12_spelling,
    "op13_chat": chat.op13_chat,
}
ORACLE = {
    "op6_jaccard": jaccard.OP6_SQL,
    "op5_topk": topk.OP5_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_chat": chat.OP13_SQL,
}
