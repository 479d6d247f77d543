"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, dedup_join, html_text, language, quality, secrets, substring, toxicity, warc


def queries() -> dict:
    return {
        "op1_html_extraction": html_text.query,
        "op2_warc": warc.query,
        "op3_suffix_dedup": substring.query,
        "op4_quality_rules": quality.query,
        "op5_secret_scans": secrets.query,
        "op6_ngram_jaccard_join": dedup_join.query,
        "op7_decontamination": decontaminate.query,
        "op8_language_id": language.query,
        "op9_toxicity": toxicity.query,
        "op10_bpe": bpe.query,
        # what SQL can express of operators whose verdicts it cannot
        "base4_quality_rules": quality.base_query,
        "base5_secret_scans": secrets.base_query,
    }


def oracle_sql() -> dict:
    return {"op2_warc": warc.SQL, "op3_suffix_dedup": substring.SQL, "base4_quality_rules": quality.BASE_SQL, "base5_secret_scans": secrets.BASE_SQL, "op6_ngram_jaccard_join": dedup_join.SQL, "op7_decontamination": decontaminate.SQL}
