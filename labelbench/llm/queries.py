"""The registered queries of this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import corpus_pipeline

from . import bytebpe, compression, gnat, langid, licenses, mixing, packing, pivots, rans, ranked, simhash, substrings, toxicity
from .tables import read


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(_docs(spark, sf_dir), shingle=3, distance=3)


def op2_language(spark, sf_dir):
    return langid.identify(_docs(spark, sf_dir))


def op3_mix(spark, sf_dir):
    return mixing.place(_docs(spark, sf_dir).select("doc_id", "source"))


def op4_pivots(spark, sf_dir):
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


def op5_toxicity(spark, sf_dir):
    return toxicity.classify(_docs(spark, sf_dir), read(spark, sf_dir, "labels"), threshold=0.3)


def op6_token_files(spark, sf_dir):
    return rans.round_trip(_docs(spark, sf_dir), end_id=0)


def op7_substrings(spark, sf_dir):
    return substrings.report(_docs(spark, sf_dir), size=20)


def op8_quality(spark, sf_dir):
    return compression.quality(_docs(spark, sf_dir))


def op9_pack(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir))


def op10_licenses(spark, sf_dir):
    return licenses.scan(_docs(spark, sf_dir))


def op11_search(spark, sf_dir):
    return ranked.search(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"), k=10)


def op12_bytes(spark, sf_dir):
    return bytebpe.report(_docs(spark, sf_dir))


def op13_codes(spark, sf_dir):
    return gnat.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_simhash_near_dedup": (op1_simhash, None),
    "op2_language_id": (op2_language, None),
    "op3_pfair_mix": (op3_mix, None),
    "op4_pivot_embedding_dedup": (op4_pivots, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_rans_token_files": (op6_token_files, None),
    "op7_substring_dedup": (op7_substrings, None),
    "op8_compression_quality": (op8_quality, None),
    "op9_best_fit_packing": (op9_pack, None),
    "op10_license_scan": (op10_licenses, None),
    "op11_ranked_search": (op11_search, ranked.search_sql()),
    "op12_byte_bpe": (op12_bytes, None),
    "op13_gnat_codes": (op13_codes, gnat.compress_sql()),
}


def queries() -> dict:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}
