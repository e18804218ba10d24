"""Queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from shelfrank.llm import bpe, exact_dedup, filter_audit, langid, media, neighbours, packing, pieces, quality, simhash, token_store, urls, vector_codes


def queries() -> dict:
    return {
        "op1_langid": langid.query,
        "op2_bpe": bpe.query,
        "op3_quality": quality.query,
        "op4_simhash": simhash.query,
        "op5_suffix_dedup": exact_dedup.query,
        "op6_token_store": token_store.query,
        "op7_packing": packing.query,
        "op8_url_filter": urls.query,
        "op9_flac_media": media.query,
        "op10_nn_descent": neighbours.query,
        "op11_filter_audit": filter_audit.query,
        "op12_pieces": pieces.query,
        "op13_vector_codes": vector_codes.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": filter_audit.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
