"""A training-corpus pipeline of five operators, each working on all that its predecessor kept.

Quality drops the documents that the classifier rejects; near-duplicates keep the document with the smallest
id of each group (five-word shingles, similarity 0.8 or more); decontamination drops the documents whose
benchmark passages make up a twentieth of their words or more; personal data is replaced by its kind's name;
packing cuts the rest into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import decontaminate, neardup, packing, pii, quality
from roadspark.llm.common import stored
from roadspark.llm.queries import PREDICTED, read, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learnt(docs, read(spark, sf_dir, "labels"))
    return quality.score_texts(docs.select(*COLUMNS), model).where(F.col("score") >= PREDICTED).select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.scan(docs.select(*COLUMNS))
    return found.withColumns({"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, "doc_id", "text", tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("near_duplicates", neardup_stage), ("decontamination", decontamination_stage), ("personal_data", pii_stage), ("packing", packing_stage)]
#: Neither discriminants nor random fields nor tokenisers can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
