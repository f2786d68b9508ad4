"""A corpus pipeline: each stage reads what the stage before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import decontam, jaccard, langid, linededup, packing
from tabulith.llm.common import materialize, table, tokenizer_path

#: A document whose language is less certain than this goes.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones hold; without letters or unsure ones go."""
    held = langid.held_out(F.col("doc_id"), 5)
    model = langid.fit(docs.where(~held), tokenizer_path("piece_bpe_32k.model"))
    return langid.keep_known(docs, model, LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; one that has no word left goes."""
    return linededup.dedup_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class."""
    return jaccard.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; one that has no word left goes."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_copies), ("decontamination", benchmark), ("packing", pack)]

#: No stage but the joins is a matter of SQL: languages, tokens and best fit are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
