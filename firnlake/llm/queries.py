"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from firnlake.llm import collocations, conversation_repair, dart_minhash, html_text, imatch, mixing, ngram_join, packing, quality, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_dart_minhash": dart_minhash.op3_dart_minhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_imatch": imatch.op7_imatch,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_html_text": html_text.op10_html_text,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op12_ngram_join": ngram_join.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
