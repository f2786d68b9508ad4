"""Extraction of documents as their token files arrive.

The engine itself is batch: a document's running heads and fallback statistics need all its pages.
Files hold whole documents, and each micro-batch is extracted and added to the stored schema.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabulith.config import CONFIG, Config
from tabulith.plans.extract import extract
from tabulith.sinks.store import schema

TOKENS = "doc_id string, page_no int, tok_order int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, bold boolean, italic boolean"


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, config: Config = CONFIG):
    """A query that extracts what arrives; a batch that is run again overwrites its own folder."""

    def batch(tokens, number: int) -> None:
        if tokens.isEmpty():
            return
        for name, df in schema(extract(tokens, config=config), config).items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return spark.readStream.schema(TOKENS).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
