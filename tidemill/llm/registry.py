"""Queries of the ten operators and, where SQL can express them, their SQL."""

from tidemill.llm import chat, classifier, decontaminate, extract, jaccard, licences, packing, quality, sharding, substrings

QUERIES = {
    "op1_extraction": extract.op1_extraction,
    "op2_chat": chat.op2_chat,
    "op3_suffix_dedup": substrings.op3_suffix_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_classifier": classifier.op7_classifier,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_packing": packing.op9_packing,
    "op10_licences": licences.op10_licences,
}
ORACLES = {
    "op2_chat": chat.SQL,
    "op3_suffix_dedup": substrings.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op5_quality": quality.SQL,
    "op6_sharding": sharding.SQL,
    "op8_jaccard_join": jaccard.SQL,
    "op10_licences": licences.SQL,
}
