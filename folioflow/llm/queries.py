"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from folioflow.llm import alignment, chat, embed_dedup, exact_dedup, language, lexical, line_dedup, mixing, ngram_join, pieces, pii, quality, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_embed_dedup": embed_dedup.op7_embed_dedup,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_alignment": alignment.op11_alignment,
    "op12_language": language.op12_language,
    "op13_lexical_search": lexical.op13_lexical_search,
}

SQL = {
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op7_embed_dedup": embed_dedup.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
