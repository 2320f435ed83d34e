"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import centroids, exact, huffman, packing, periodic, pii, quality, sentencepieces, simhash, suffixes, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_url_filter": urls.op1,
        "op2_token_files": huffman.op2,
        "op3_toxicity": toxicity.op3,
        "op4_simhash": simhash.op4,
        "op5_sentencepiece": sentencepieces.op5,
        "op6_pii_surrogates": pii.op6,
        "op7_suffix_passages": suffixes.op7,
        "op8_line_quality": quality.op8,
        "op9_packing": packing.op9,
        "op10_exact_dedup": exact.op10,
        "op11_periodic_runs": periodic.op11,
        "op12_vantage_clusters": centroids.op12,
        "op13_warc": warc.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": urls.OP1_SQL,
        "op8_line_quality": quality.OP8_SQL,
        "op10_exact_dedup": exact.OP10_SQL,
        "op11_periodic_runs": periodic.OP11_SQL,
        "op12_vantage_clusters": centroids.OP12_SQL,
        "op13_warc": warc.OP13_SQL,
    }
