"""Queries and SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from docflow.llm import decontamination, html, language, licenses, negatives, packing, pieces, quality, resampling, secrets, sharding, simhash, tokens


def queries():
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_language_id": language.op3_language_id,
        "op4_token_ids": tokens.op4_token_ids,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_html_text": html.op7_html_text,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_simhash": simhash.op9_simhash,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_packing": packing.op13_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_secret_scan": secrets.ORACLE,
        "op7_html_text": html.ORACLE,
        "op8_quality_rules": quality.ORACLE,
        "op10_license_scan": licenses.ORACLE,
        "op11_importance_resampling": resampling.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
    }
