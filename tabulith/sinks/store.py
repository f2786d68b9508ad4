"""The relational schema of an extraction, one Parquet dataset for each table, rebuilt as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.config import CONFIG, Config
from tabulith.functions.text import collapse
from tabulith.plans.extract import Extraction


def key(*parts: Column) -> Column:
    """An id that follows from what it names: the first 24 digits of a digest of its parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 24)


def schema(found: Extraction, config: Config = CONFIG, stamp: str = "1970-01-01T00:00:00Z") -> dict[str, DataFrame]:
    """All tables by name. Cells of rejected tables are not stored as values; each cell stands once."""
    table_id = key(F.col("doc_id"), F.col("page_no"), F.col("table_idx"))
    t = found.tables.withColumn("table_id", table_id)
    cells = found.cells.withColumn("table_id", table_id)
    cell_id = key(F.col("table_id"), F.col("row_idx"), F.col("col_idx"))
    cells = cells.withColumn("cell_id", cell_id)
    confidence = cells.groupBy("table_id").agg(F.avg(F.col("confidence").cast("decimal(18,12)")).cast("double").alias("confidence"))
    columns = found.columns.withColumn("table_id", table_id)
    heads = cells.where("row_idx = 0").select("table_id", "col_idx", F.when(~F.col("value_type").isin("integer", "decimal", "currency", "percent"), collapse(F.col("raw_text"))).alias("first_text"))
    tokens = columns.join(heads, ["table_id", "col_idx"], "left").withColumn("path", F.when(F.size("header_path") > 0, F.col("header_path")).otherwise(F.array_compact(F.array(F.nullif("first_text", F.lit(""))))))
    rows = found.rows.withColumn("table_id", table_id)
    notes = found.footnotes.withColumn("footnote_id", key(F.col("doc_id"), F.col("page_no"), F.col("line_idx")))
    out = {
        "documents": found.stats.groupBy("doc_id").agg(F.count("*").alias("page_count")),
        "pages": found.stats,
        "extraction_runs": found.stats.sparkSession.createDataFrame([(config.digest(), stamp)], "config_digest string, started_at string"),
        "tables": t.join(confidence, "table_id", "left").withColumn("confidence", F.when(F.col("rejected_as").isNull(), F.col("confidence"))),
        "table_regions": t.select("table_id", "doc_id", "page_no", "x0", "y0", "x1", "y1"),
        "columns": columns.select("table_id", "col_idx", "x0", "x1", "alignment", "inferred_type", "unit", "agreement"),
        "column_header_tokens": tokens.select("table_id", "col_idx", F.posexplode("path").alias("depth", "token")),
        "cells": cells.select("cell_id", "table_id", "doc_id", "page_no", "row_idx", "col_idx", "row_span", "col_span", "raw_text", "is_header", "value_type", "value", F.col("parsed.normalized_text").alias("normalized_text"), F.col("parsed.unit").alias("unit"), F.col("parsed.scale").alias("scale"), F.col("parsed.rule").alias("rule"), "notes", "codes", "raw_score", "confidence", "x0", "y0", "x1", "y1"),
        "row_label_tokens": rows.select("table_id", "row_idx", "kind", F.posexplode("label_path").alias("depth", "token")),
        "footnotes": notes,
        "cell_footnotes": cells.where("marker is not null").select("cell_id", "marker", "note"),
        "issues": found.issues.withColumn("table_id", table_id),
    }
    if found.links is not None:
        out["table_assets"] = found.links.withColumn("table_id", table_id)
    return out


def write(found: Extraction, folder: str, config: Config = CONFIG, stamp: str = "1970-01-01T00:00:00Z") -> None:
    """Each table is written over what is there; no clock goes in, so equal inputs give equal rows."""
    for name, df in schema(found, config, stamp).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def cells_under(spark: SparkSession, folder: str, header: str | None = None, label: str | None = None) -> DataFrame:
    """Cells of accepted tables under a header token and beside a row-label token, with page and unit."""
    s = read(spark, folder, "cells", "tables", "column_header_tokens", "row_label_tokens")
    good = s["tables"].where("rejected_as is null").select("table_id", "title", "unit_scale_note")
    out = s["cells"].join(good, "table_id")
    if header is not None:
        out = out.join(s["column_header_tokens"].where(F.lower("token") == header.lower()).select("table_id", "col_idx").distinct(), ["table_id", "col_idx"], "left_semi")
    if label is not None:
        out = out.join(s["row_label_tokens"].where(F.lower("token") == label.lower()).select("table_id", "row_idx").distinct(), ["table_id", "row_idx"], "left_semi")
    return out


def rejections(tables: DataFrame) -> DataFrame:
    return tables.groupBy("doc_id", F.coalesce("rejected_as", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


