"""Labelled tables from CSV and JSON files named ``<document>__p<page>__<slug>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"([^/]+)__p(\d+)__([^/.]+)\.[A-Za-z]+$"


def read_csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows (label_id, document, page_no, is_table, rejection_codes, row_idx, cells): blank rows and columns are trimmed.

    A file whose first cell is ``NOT_A_TABLE`` is a negative; codes may follow it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = lines.select("file", F.posexplode(F.split("value", "\r?\n")).alias("row_idx", "line"))
    cells = rows.select("file", "row_idx", F.transform(F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))).alias("cells"))
    named = cells.select(
        F.concat_ws("__", F.regexp_extract("file", NAME, 1), F.concat(F.lit("p"), F.regexp_extract("file", NAME, 2)), F.regexp_extract("file", NAME, 3)).alias("label_id"),
        F.regexp_extract("file", NAME, 1).alias("document"), F.regexp_extract("file", NAME, 2).try_cast("int").alias("page_no"), "row_idx", "cells",
    )
    first = named.where("row_idx = 0").select("label_id", (F.col("cells")[0] != "NOT_A_TABLE").alias("is_table"), F.when(F.col("cells")[0] == "NOT_A_TABLE", F.slice("cells", 2, F.size("cells"))).otherwise(F.array().cast("array<string>")).alias("rejection_codes"))
    full = named.where(F.exists("cells", lambda c: c != "")).join(first, "label_id")
    width = full.groupBy("label_id").agg(F.max(F.expr("array_max(transform(cells, (c, i) -> if(c != '', i + 1, 0)))")).alias("w"))
    return full.join(width, "label_id").where("is_table or row_idx = 0").select("label_id", "document", "page_no", "is_table", "rejection_codes", "row_idx", F.expr("slice(cells, 1, w)").alias("cells"))


def read_json_labels(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "label_id string, document string, page_no int, end_page_no int, is_table boolean, author string, label_type string, authored_from string, notes array<string>, protocol array<string>, "
        "header_row_count int, grid array<array<string>>, expected_rejection_codes array<string>, context struct<title:string,caption:string,section_path:string,unit_scale_note:string>"
    )
    return spark.read.schema(schema).option("multiLine", True).json(path)
