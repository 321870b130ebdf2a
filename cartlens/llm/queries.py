"""The registered queries of the corpus operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from cartlens.llm import (
    bpe, chat_tools, decontaminate, html_text, languages, licenses, merkle, packing, pii, quality_rules, simhash,
    token_counts, trie,
)

QUERIES = {
    "op1_tool_calls": chat_tools.linked_tool_calls,
    "op2_quality_ledger": quality_rules.quality_ledger,
    "op3_leaked_items": decontaminate.leaked_items,
    "op4_article_texts": html_text.article_texts,
    "op5_bpe_round_trip": bpe.round_trips,
    "op6_license_labels": licenses.license_labels,
    "op7_surrogates": pii.private_texts,
    "op8_token_counts": token_counts.token_counts,
    "op9_languages": languages.predicted_languages,
    "op10_near_duplicates": simhash.near_duplicates,
    "op11_conversation_trie": trie.conversation_trie,
    "op12_dataset_manifest": merkle.document_manifest,
    "op13_packed_documents": packing.packed_documents,
}

SQL = {
    "op1_tool_calls": chat_tools.SQL,
    "op2_quality_ledger": quality_rules.SQL,
    "op11_conversation_trie": trie.SQL,
    "op12_dataset_manifest": merkle.SQL,
}
