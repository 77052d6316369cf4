"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard_join, language_id, merkle, mixing, pii, prefix_trie, quality, sentencepiece_bpe, sharding, suffix_dedup, url_filter, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_language_id": language_id.op3_language_id,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_warc_archive": warc.op6_warc_archive,
        "op7_find_pii": pii.op7_find_pii,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_sharding": sharding.op10_sharding,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_sentencepiece": sentencepiece_bpe.op12_sentencepiece,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op2_mix_sources": mixing.SQL,
        "op4_url_filter": url_filter.SQL,
        "op5_decontaminate": decontaminate.SQL,
        "op6_warc_archive": warc.SQL,
        "op8_suffix_dedup": suffix_dedup.SQL,
        "op9_jaccard_join": jaccard_join.SQL,
        "op11_merkle_manifest": merkle.SQL,
        "op13_prefix_trie": prefix_trie.SQL,
    }
