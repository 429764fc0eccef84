"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, licenses, line_dedup, near_dedup, pieces, pii, quality, sharding, substring, throttle, toxicity, vector_codes, warc
from .oracles import ORACLES as _SQL

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_licenses": licenses.op6_licenses,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_throttle": throttle.op11_throttle,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_substring": substring.op13_substring,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {k: v for k, v in _SQL.items() if k in QUERIES}
