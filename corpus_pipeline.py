"""The corpus pipeline over ``documents``: quality, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.pii import fit_pii, redact_pii
from tidemark.llm.quality import fit_quality, fold, quality_column
from tidemark.llm.shingle_dedup import near_copies, text_hash
from tidemark.llm.simhash import simhash_links
from tidemark.session import cut, drop_cut, ship

#: Quality scores below this go.
THRESHOLD = 0.3


def _documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` following the text."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; null and empty texts score the share of good labels, rows that repeat an id are judged each, and without labels of both classes all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.filter(fold() != 0))
    ship(spark)
    return docs.filter(quality_column(model) >= THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that an earlier line matches go; blank lines and every document stay."""
    return _documents(dedup_lines(docs, least=1), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose five-word shingles have Jaccard similarity 0.8 or more with those of a document of a smaller id: SimHash links, by the pivot distance tables of ``op5_simhash``,
    and pairs that share min-hash keys are verified on whole sets. Documents without an id stay; rows that repeat an id are judged each, equal ones alike."""
    gone = near_copies(docs, links=simhash_links(docs)).withColumnRenamed("text_hash", "__text_hash")
    return docs.withColumn("__text_hash", text_hash("text")).join(gone, ["doc_id", "__text_hash"], "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; every document stays, null and empty texts as they are."""
    return _documents(redact_pii(docs, model=fit_pii(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing operator gives them; a null or empty text is its end id alone, repeated rows and null ids are packed each."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", packing),
]

#: The stages' models, similarity joins and tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
