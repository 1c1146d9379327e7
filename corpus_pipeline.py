"""Corpus preparation as a chain of written tables: five operators, each on all that the one before kept.

Defined results of every stage: a null text is an empty one and stays as it is (it has no words, so it is neither toxic, a
near copy, a leak nor personal data; packed, it is one end token); rows are kept or dropped by id and text, so a null or
repeated id takes no other row with it; an empty table gives an empty one; texts are read whole, whatever their length;
columns beyond id and text, whatever their names, pass through all stages but the last, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm import decontaminate, jaccard, packing, pii, toxicity
from folio_spark.llm.common import materialize


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, scores under one half. Without labels of
    both kinds none is dropped; repeated rows go or stay together; of ties (scores of exactly one half) all go."""
    score = unused(docs, "_toxicity")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity of 0.8 or more. The smallest id's stays,
    of ties the text with the lowest hash, of equal rows one; texts without words all stay."""
    return jaccard.keep_one_each(docs, k=5, percent=80).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; with an empty benchmark all. Repeated rows go or stay together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows where the text changed. Rows stay one by one, and
    of spans that overlap the operator's choice holds."""
    spans, new = unused(docs, "_spans"), unused(docs, "_new")
    found = pii.find_spans(docs, "text", spans).withColumn(new, pii.redacted(F.col("text"), F.col(spans)))
    n_chars = F.when(F.size(spans) > 0, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": n_chars, "text": F.col(new)}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; repeated rows are packed one by one."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("benchmark", drop_benchmark), ("personal data", redact), ("packing", pack)]
#: The classifier, the edit search and the packing are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
