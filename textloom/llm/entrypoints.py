"""Queries and SQL of the corpus operators, for __spark_entry__."""

from __future__ import annotations

from . import bpe, imatch, licenses, packing, pii, quality, secrets, simhash, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_imatch": imatch.op1_imatch,
        "op2_secrets": secrets.op2_secrets,
        "op3_packing": packing.op3_packing,
        "op4_licenses": licenses.op4_licenses,
        "op5_bpe": bpe.op5_bpe,
        "op6_quality": quality.op6_quality,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_suffixes": suffixes.op8_suffixes,
        "op9_simhash": simhash.op9_simhash,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {}
