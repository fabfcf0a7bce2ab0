"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, licenses, mixing, near_dedup, negatives, pii, quality, runs, secrets, simhash, tokens, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_fingerprints,
        "op2_quality": quality.op2_quality,
        "op3_secrets": secrets.op3_secrets,
        "op4_warc": warc.op4_warc,
        "op5_token_orc": tokens.op5_token_orc,
        "op6_mix": mixing.op6_mix,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_licenses": licenses.op8_licenses,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_pii": pii.op11_pii,
        "op12_runs": runs.op12_runs,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op13_hard_negatives": negatives.ORACLE}
