"""The corpus pipeline: documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of documents.

1. language_id: texts without a letter, or whose language is uncertain, go.
2. simhash_near_dedup: one document of each group stays, the one with the smallest doc_id.
3. substring_dedup: repeated windows of 20 words go; a document that loses every word goes.
4. mix_sources: documents in the order of the Pfair schedule; small sources are read again.
5. best_fit_packing: pieces of at most 1024 tokens, with their sequence and place.

Whole texts go to the Python workers in all stages, so each stage sets the session's Arrow batches to ``BATCH_BYTES``: by rows
alone a batch is as large as 10,000 texts, and lies in the JVM's direct memory, in the worker and as Python strings at a time.
The setting stays for the session.  No result depends on it, but for the last digits of a language's score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelbench.llm import langid, mixing, packing, simhash, substrings
from labelbench.llm.tables import cut_lineage, read

#: Bytes of an Arrow batch, plus one row.
BATCH_BYTES = 4 << 20


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return simhash.keep_one(docs, shingle=3, distance=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return substrings.remove(docs, size=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The stages hash, compress statistics and tokenize; SQL has no form for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
