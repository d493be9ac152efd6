"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from glossmeter.llm import (conversations, decontamination, packing, paragraphs, pieces, repetition, sharding, signature_tree, spelling,
                            suffix_tree, token_counts, toxicity, url_lists)

QUERIES = {
    "op1_suffix_tree_scores": suffix_tree.score_documents,
    "op2_ordinal_toxicity": toxicity.score_documents,
    "op3_offset_token_counts": token_counts.count_documents,
    "op4_temporal_url_lists": url_lists.filter_pages,
    "op5_nnls_packing": packing.pack_documents,
    "op6_paragraph_minhash": paragraphs.dedup_documents,
    "op7_simhash_decontamination": decontamination.decontaminate_documents,
    "op8_quality_repetition": repetition.quality_documents,
    "op9_histogram_sort": sharding.shard_documents,
    "op10_signature_tree_join": signature_tree.join_documents,
    "op11_grammar_repair": conversations.repair_documents,
    "op12_backtracking_pieces": pieces.encode_documents,
    "op13_reduced_alphabet_spelling": spelling.group_documents,
}

ORACLE = {
    "op4_temporal_url_lists": url_lists.ORACLE,
    "op10_signature_tree_join": signature_tree.ORACLE,
}
