"""The five raw tables that any page reader has to give, and readers for them.

raw_pages, raw_glyphs, raw_drawings, raw_images and raw_links are Parquet tables. ``pdf_pages``
decodes PDF files with an optional library; where it is absent it says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.config import CONFIG, Config
from tabulith.operators.pages import classify_page, image_coverage, text_angle, words_from_glyphs

SCHEMAS = {
    "raw_pages": "doc_id string, page_no int, width double, height double, rotation int, char_count int",
    "raw_glyphs": "doc_id string, page_no int, block_no int, line_no int, span_no int, char_no int, ch string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, color int, dir_cos double, dir_sin double",
    "raw_drawings": "doc_id string, page_no int, drawing_no int, item_no int, kind string, x0 double, y0 double, x1 double, y1 double, stroke double",
    "raw_images": "doc_id string, page_no int, xref int, x0 double, y0 double, x1 double, y1 double",
    "raw_links": "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double",
}


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their content's digest, which is a document's identity."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def pdf_pages(documents: DataFrame) -> DataFrame:
    """(sha256, page_no, width, height, rotation, text) of each PDF page; encrypted files get an empty password."""
    schema = "sha256 string, page_no int, width double, height double, rotation int, text string, error string"

    def kernel(batches):
        import io

        import pandas as pd

        try:
            import pypdf
        except ImportError:
            pypdf = None
        for pdf in batches:
            out = []
            for sha, content in zip(pdf["sha256"], pdf["content"]):
                if pypdf is None:
                    out.append((sha, 0, 0.0, 0.0, 0, "", "PDF_READER_UNAVAILABLE"))
                    continue
                reader = pypdf.PdfReader(io.BytesIO(content))
                if reader.is_encrypted and not reader.decrypt(""):
                    out.append((sha, 0, 0.0, 0.0, 0, "", "ENCRYPTED"))
                    continue
                for n, page in enumerate(reader.pages, 1):
                    out.append((sha, n, float(page.mediabox.width), float(page.mediabox.height), int(page.rotation or 0), page.extract_text() or "", None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return documents.select("sha256", "content").mapInPandas(kernel, schema)


def pages(raw: dict[str, DataFrame], config: Config = CONFIG) -> DataFrame:
    """Pages with their image coverage and kind."""
    covered = image_coverage(raw["raw_images"], raw["raw_pages"], config)
    return raw["raw_pages"].join(covered, ["doc_id", "page_no"]).withColumn("page_type", classify_page(F.col("char_count"), F.col("image_coverage"), config))


def tokens(raw: dict[str, DataFrame]) -> DataFrame:
    """Words of the text layer with the direction that most of a page is set in."""
    glyphs = raw["raw_glyphs"]
    angle = text_angle(glyphs.groupBy("doc_id", "page_no", "dir_cos", "dir_sin").agg(F.count("*").alias("n_chars")))
    return words_from_glyphs(glyphs).join(angle, ["doc_id", "page_no"], "left")


def read_scanned(tokens_: DataFrame, pages_: DataFrame, reader=None, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """(tokens, page notes): pages without a text layer go to ``reader``, a function of pages to tokens.

    Without a reader such pages keep what they have and are noted OCR_UNAVAILABLE.
    """
    few = tokens_.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    need = pages_.where("page_type != 'digital'").join(few, ["doc_id", "page_no"], "left").where(F.coalesce("n", F.lit(0)) < config.get("ocr.min_text_tokens")).select("doc_id", "page_no")
    if reader is None:
        return tokens_, need.withColumn("note", F.lit("OCR_UNAVAILABLE"))
    read = reader(need)
    got = read.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    notes = need.join(got, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.when(F.col("n") > 0, "OCR_TOKENS").otherwise("OCR_EMPTY").alias("note"))
    kept = tokens_.join(got.where("n > 0"), ["doc_id", "page_no"], "left_anti")
    return kept.unionByName(read, allowMissingColumns=True), notes
