"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from reportlake.llm import chat, decontaminate, exact_dedup, html_text, language_id, line_dedup, near_join, passage_dedup, phrases, pieces, quality, repair, token_counts, warc

QUERIES = {
    "op3_near_join": near_join.op3_near_join,
    "op5_chain_field": html_text.op5_chain_field,
    "op1_neighbour_voting": quality.op1_neighbour_voting,
    "op2_perspectives": chat.op2_perspectives,
    "op4_bloom_dedup": exact_dedup.op4_bloom_dedup,
    "op6_pieces": pieces.op6_pieces,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_partial_matching": language_id.op8_partial_matching,
    "op9_winnowing": decontaminate.op9_winnowing,
    "op10_line_winnowing": line_dedup.op10_line_winnowing,
    "op10_passages": passage_dedup.op10_passages,
    "op11_phrases": phrases.op11_phrases,
    "op12_revisits": warc.op12_revisits,
    "op13_repair": repair.op13_repair,
}
ORACLES = {
    "op3_near_join": near_join.ORACLE,
    "op2_perspectives": chat.ORACLE,
    "op4_bloom_dedup": exact_dedup.ORACLE,
    "op9_winnowing": decontaminate.ORACLE,
    "op10_line_winnowing": line_dedup.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_revisits": warc.ORACLE,
    "op13_repair": repair.ORACLE,
}
