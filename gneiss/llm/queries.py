"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, cotraining, fingerprint, jaccard, licenses, mixing, packing, pii, quality_rules, simhash, substring, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_licenses": licenses.op2_licenses,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_quality": cotraining.op4_quality,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_warc": warc.op10_warc,
    "op11_whitening": whitening.op11_whitening,
    "op12_simhash": simhash.op12_simhash,
    "op13_collocations": collocations.op13_collocations,
}

SQL: dict[str, str] = {
    "op5_substring_dedup": substring.OP5_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
