"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; run() writes what each returns as
Parquet in the shared folder and reads it again. All stages but the last return the columns of documents.

Null texts pass the stages as empty ones do: language identification rejects them. Very long texts are read whole by every stage. Rows
that share a doc_id stay or go together in the join; repeated rows stay or go together everywhere. A null doc_id is a document that comes
last in line_dedup and is in no link. Columns other than those of documents are left out. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import documents, stored
from tesserae.llm.decontamination import decontaminate
from tesserae.llm.language import identify, learned, taught_by
from tesserae.llm.line_templates import drop_recurring
from tesserae.llm.ngram_join import linked_components
from tesserae.llm.sentence_pieces import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language identification rejects; a model that could learn nothing drops none with a letter in it."""
    model = learned(docs.select("doc_id", "text", "lang"), taught_by(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return identify(docs.select(*COLUMNS), model).where("accepted").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines from all documents but the first that holds them, and documents of which less than a quarter is left.

    Such a document is a near copy of others by the measure of the join that follows, which can't tell by its remnant.
    """
    cut = drop_recurring(docs.select(*COLUMNS, F.length("text").alias("before_")))
    cut = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\s]") & (4 * F.length("text") >= F.col("before_")))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id, and all documents in no group."""
    found = linked_components(docs.select("doc_id", "text"))
    rest = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(rest, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document: its ids, and digests of the ids and of the text that they decode to."""
    coded = encode(docs.select("doc_id", "text"))
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("sentence_pieces", sentence_pieces),
]

#: SQL can't express a trained classifier; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
