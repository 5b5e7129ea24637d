"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, divergence, fingerprint, near_dedup, pii, quality, substrings, toxicity, trie, url_filter, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_pii": pii.op3_pii,
    "op4_substrings": substrings.op4_substrings,
    "op5_warc": warc.op5_warc,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_quality": quality.op10_quality,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {"op2_chat_formatting": chat.ORACLE, "op3_pii": pii.ORACLE, "op4_substrings": substrings.ORACLE, "op8_near_dedup": near_dedup.ORACLE, "op5_warc": warc.ORACLE, "op11_url_filter": url_filter.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_source_divergence": divergence.ORACLE}
