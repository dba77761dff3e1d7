"""A corpus build in stages; each stage's rows are written and read again before the next.

quality classifier -> line dedup -> near duplicates -> mixing -> packing. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_templates, mixing, ngram_join, packing, quality_model
from tessera.llm.common import WORD, shared_folder
from tessera.llm.queries import byte_bpe, table

#: Near duplicates are documents that share this part of their shingles of so many words.
SHINGLE_WORDS, SIMILARITY = 5, (8, 10)


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, made longer where the documents have columns of them."""
    columns = {c.lower() for c in docs.columns}
    return tuple(next("_" * k + n for k in range(len(columns) + 1) if "_" * k + n not in columns) for n in names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labels of the documents that came in."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    added = unused(docs, "score", "predicted")
    return quality_model.score(docs, model, added=added).where(F.col(added[1]) == 1).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines alike to any of an earlier document go; a document that loses lines and keeps none with a word, as a copy does, goes whole."""
    added = unused(docs, "n_lines", "n_dropped")
    rows = line_templates.drop_recurring_lines(docs, added=added, whole=True).where((F.col(added[1]) == 0) | F.col("text").rlike(WORD))
    size = F.length(F.coalesce(F.col("text"), F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; one without an id stays alone."""
    num, den = SIMILARITY
    classes = ngram_join.near_duplicate_classes(docs, width=SHINGLE_WORDS, num=num, den=den)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources come near their target weights; documents repeat, and the last one of a source is cut."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: the pieces of all documents of the mix and their places."""
    return packing.pack(docs, byte_bpe())


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("ngram_join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder as Parquet."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
