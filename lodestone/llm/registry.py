"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    decontamination,
    licenses,
    packing,
    quality_rules,
    sharding,
    simhash,
    site_quality,
    substring_dedup,
    toxicity,
    warc,
)


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_warc": warc.op1_warc,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_simhash": simhash.op4_simhash,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_licenses": licenses.op6_licenses,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_sharding": sharding.op8_sharding,
        "op9_packing": packing.op9_packing,
        "op10_site_quality": site_quality.op10_site_quality,
    }


def oracle_sql() -> dict:
    return {"op1_warc": warc.OP1_SQL, "op3_decontamination": decontamination.OP3_SQL, "op5_quality_rules": quality_rules.OP5_SQL}
