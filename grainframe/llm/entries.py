"""The registered queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from grainframe.llm import bpe, external_shuffle, flac, license_scan, near_dedup, periodic_runs, pii, quality_classifier, quality_rules, source_mixing, suffix_dedup, token_alignment, token_counts


def queries():
    return {
        "op1_quality_classifier": quality_classifier.op1,
        "op2_external_shuffle": external_shuffle.op2,
        "op3_minhash_near_dedup": near_dedup.op3,
        "op4_quality_rules": quality_rules.op4,
        "op5_flac_media": flac.op5,
        "op6_pii_pseudonyms": pii.op6,
        "op7_suffix_array_dedup": suffix_dedup.op7,
        "op8_license_scan": license_scan.op8,
        "op9_source_mixing": source_mixing.op9,
        "op10_byte_pair_encoding": bpe.op10,
        "op11_periodic_runs": periodic_runs.op11,
        "op12_tokenizer_alignment": token_alignment.op12,
        "op13_token_counts": token_counts.op13,
    }


def oracle_sql():
    return {"op3_minhash_near_dedup": near_dedup.SQL, "op9_source_mixing": source_mixing.SQL}
