"""The queries of this subpackage and their SQL."""

from quartzite.llm import chat, decontaminate, jaccard, packing, quality, rollups, sharding, suffixes, urls, vectors

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_embedding_near_dedup": vectors.op4_embedding_near_dedup,
    "op5_token_counts": rollups.op5_token_counts,
    "op6_suffix_array_dedup": suffixes.op6_suffix_array_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {}
for module in (chat, decontaminate, jaccard, packing, quality, rollups, sharding, suffixes, urls, vectors):
    ORACLE_SQL |= getattr(module, "ORACLE_SQL", {})
