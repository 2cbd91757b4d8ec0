"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import bpe, hmm, line_dedup, merkle_manifest, packing, periodic_runs, quality_classifier, quality_rules, simhash, substring_dedup, suffix_array_dedup, transport_stream, warc


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_warc": warc.query,
        "op3_suffix_array_dedup": suffix_array_dedup.query,
        "op4_quality_classifier": quality_classifier.query,
        "op5_transport_stream": transport_stream.query,
        "op6_hmm_scores": hmm.query,
        "op7_best_fit_packing": packing.query,
        "op8_quality_rules": quality_rules.query,
        "op9_bpe_round": bpe.query,
        "op10_simhash_components": simhash.query,
        "op11_periodic_runs": periodic_runs.query,
        "op12_line_dedup": line_dedup.query,
        "op13_merkle_manifest": merkle_manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op2_warc": warc.SQL,
        "op3_suffix_array_dedup": suffix_array_dedup.SQL,
        "op11_periodic_runs": periodic_runs.SQL,
        "op12_line_dedup": line_dedup.SQL,
        "op13_merkle_manifest": merkle_manifest.SQL,
    }
