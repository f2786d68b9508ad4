"""A document set here, extracted, stored and reported."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tabulith.config import CONFIG, Config
from tabulith.operators import kernels
from tabulith.plans.extract import extract
from tabulith.sinks import report, store
from tabulith.sources.labels import read_csv_labels
from tabulith.sources.raw import read_scanned
from tabulith.sources.typeset import typeset

ROWS = [
    ["", "2024", "2023"], ["Cash", "100", "90"], ["Receivables", "250", "#REF!"], ["Inventory*", "150", "130"], ["Total assets", "500", "460"], ["Goods", "10", "20"], ["Stock", "5", "6"], ["Total other", "16", "26"],
]


@pytest.fixture(scope="module")
def found(spark):
    cells = [("d", 1, r, c, t) for r, row in enumerate(ROWS) for c, t in enumerate(row)]
    below = [("d", 1, len(ROWS) + 3, 0, "* Inventory as restated")]
    df = spark.createDataFrame(cells + below, "doc_id string, page_no int, row_idx int, col_idx int, text string")
    return extract(typeset(df, {0: 72.0, 1: 320.0, 2: 440.0}, right=(1, 2)))


def test_cells_and_signals(found):
    got = {(r.row_idx, r.col_idx): r for r in found.cells.collect()}
    assert got[1, 1].value == 100 and got[2, 2].value_type == "error" and "SOURCE_ERROR_VALUE" in got[2, 2].codes
    issues = {(r.code, r.row_idx, r.col_idx) for r in found.issues.collect()}
    assert ("SOURCE_ERROR_VALUE", 2, 2) in issues and ("CROSSFOOT_UNVERIFIABLE", 4, 2) in issues and ("CROSSFOOT_FAIL", 7, 1) in issues
    assert got[1, 1].crossfoot == 1.0 and got[5, 1].crossfoot == -1.0


def test_footnote_and_label(found):
    assert [(r.marker, r.text) for r in found.footnotes.collect()] == [("*", "Inventory as restated")]
    assert found.cells.where("row_idx = 3 and col_idx = 0").first().marker == "*"
    assert found.rows.where("row_idx = 3").first().label_path == ["Inventory"]


def test_store_and_reports(spark, found, tmp_path):
    store.write(found, str(tmp_path / "s"))
    hit = store.cells_under(spark, str(tmp_path / "s"), label="Cash").collect()
    assert {r.raw_text for r in hit} == {"Cash", "100", "90"}
    assert spark.read.parquet(str(tmp_path / "s" / "cells")).count() == found.cells.count()
    queue = report.queue_rows(found).collect()
    assert queue and queue[0].priority >= queue[-1].priority
    assert report.run_log(found).count() > 0 and report.summary(found).where("doc_id is null").first().tables == 1
    book = report.table_workbook(found, "d", 1, 0)
    assert book == report.table_workbook(found, "d", 1, 0) and len(zipfile.ZipFile(BytesIO(book)).namelist()) == 8
    assert "Receivables" in report.viewer(found, "d") and report.overlay(10, 10, [(0, 0, 1, 1, "x")]).startswith("<svg")


def test_settings():
    with pytest.raises(KeyError):
        CONFIG.get("rows.nothing")
    assert Config().digest() == CONFIG.digest() and CONFIG.f("values.min_type_agreement") == 0.7


def test_labels(spark, tmp_path):
    (tmp_path / "doc__p3__slug.csv").write_text('a,"b, c",\n,,\n1,2,\n')
    (tmp_path / "doc__p4__toc.csv").write_text("NOT_A_TABLE,TRAP_TOC\n")
    rows = {(r.label_id, r.row_idx): r for r in read_csv_labels(spark, str(tmp_path)).collect()}
    assert rows["doc__p3__slug", 0].cells == ["a", "b, c"] and rows["doc__p3__slug", 2].cells == ["1", "2"]
    assert not rows["doc__p4__toc", 0].is_table and rows["doc__p4__toc", 0].rejection_codes == ["TRAP_TOC"]


def test_pages_without_text(spark):
    tokens = spark.createDataFrame([("d", 1, "x")], "doc_id string, page_no int, text string")
    pages = spark.createDataFrame([("d", 1, "digital"), ("d", 2, "raster")], "doc_id string, page_no int, page_type string")
    assert [tuple(r) for r in read_scanned(tokens, pages)[1].collect()] == [("d", 2, "OCR_UNAVAILABLE")]
    read = lambda need: need.withColumn("text", F.lit("read"))
    got, notes = read_scanned(tokens, pages, read)
    assert got.count() == 2 and notes.first().note == "OCR_TOKENS"


def test_rejected_tables_keep_their_cells(spark):
    """A list of marks is no table, yet what stood in it is kept without confidence."""
    rows = [("1.", "an item of a list that goes on"), ("2.", "another item of that list here"), ("3.", "one more item of the list at last")] * 3
    cells = [("d", 1, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id string, page_no int, row_idx int, col_idx int, text string")
    got = extract(typeset(df, {0: 72.0, 1: 120.0}))
    tables = {tuple(r)[:3]: r.rejected_as for r in got.tables.select("doc_id", "page_no", "table_idx", "rejected_as").collect()}
    kept = got.cells.groupBy("doc_id", "page_no", "table_idx").agg(F.count("confidence").alias("n"), F.count("*").alias("all")).collect()
    assert {tuple(r)[:3] for r in kept} == set(tables) and all(r["all"] > 0 and (r.n == 0) == (tables[tuple(r)[:3]] is not None) for r in kept)


def test_tokens_without_keys_make_one_page(spark):
    tokens = spark.createDataFrame([(None, None, n, f"w{n}", 10.0 * n, 0.0, 10.0 * n + 8, 9.0, 9.0) for n in range(5)], "doc_id string, page_no int, tok_order int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [r.token_count for r in kernels.page_statistics(tokens).collect()] == [5]


def test_tables_over_page_ends_are_one(spark):
    """Repeated headers go once, rows are numbered on, and the total at the end adds up over all pages."""
    head, total = ["Item", "Qty", "Price"], ["Total", "210", "2,102.00"]
    body = [["Part A", "40", "400.50"], ["Part B", "10", "100.25"], ["Part C", "30", "300.00"], ["Part D", "20", "200.75"], ["Part E", "60", "600.10"], ["Part F", "50", "500.40"]]
    more = [["Part G", "90", "900.00"], ["Part H", "70", "700.00"], ["Part I", "80", "800.00"]]
    two = {1: [head, *body[:3]], 2: [head, *body[3:], total]}
    docs = {"d": two, "e": {1: two[1], 2: [*two[2][:-1], ["Total", "210", "2,103.00"]]}, "f": {1: [head, *body[:3]], 2: body[3:], 3: [*more, ["Total", "450", "4,502.00"]]}}
    cells = [(d, p, r, c, t) for d, pages in docs.items() for p, rows in pages.items() for r, row in enumerate(rows) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id string, page_no int, row_idx int, col_idx int, text string")
    got = extract(typeset(df, {0: 72.0, 1: 320.0, 2: 440.0}, right=(1, 2)).withColumn("page_width", F.lit(612.0)))
    tables = {(r.doc_id, r.page_no): r for r in got.tables.collect()}
    size = {"d": 8, "e": 8, "f": 11}
    for d, pages in docs.items():
        assert [tables[d, p].rejected_as for p in pages] == [None] + ["STITCHED_INTO_PRIOR"] * (len(pages) - 1)
        assert tables[d, 1].end_page == len(pages) and tables[d, 1].n_rows == size[d] and "STITCHED" in tables[d, 1].flags and tables[d, 2].is_continuation
    every = got.cells.collect()
    for d, pages in docs.items():
        mine = [r for r in every if r.doc_id == d and r.page_no == 1]
        text = {(r.row_idx, r.col_idx): r.raw_text for r in mine}
        assert [[text[r, c] for c in range(3)] for r in range(7)] == [head, *body] and text[size[d] - 1, 0] == "Total" and len(mine) == 3 * size[d]
        assert {r.source_page for r in mine} == set(pages)
        assert {r.crossfoot for r in mine if r.row_idx > 0 and r.col_idx == 1} == {1.0}
        assert {r.crossfoot for r in mine if r.row_idx > 0 and r.col_idx == 2} == {-1.0 if d == "e" else 1.0}
    # A repeated header stays with the table that was taken in.
    assert {(r.doc_id, r.page_no, r.row_idx, r.raw_text, r.confidence) for r in every if r.page_no > 1} == {(d, 2, 0, t, None) for d in "de" for t in head}
    rows = {(r.doc_id, r.page_no, r.row_idx): r for r in got.rows.collect()}
    assert {k for k, r in rows.items() if "STITCH_BOUNDARY" in r.flags} == {("d", 1, 4), ("e", 1, 4), ("f", 1, 4), ("f", 1, 7)}
    assert [rows["f", 1, n].kind for n in (0, 1, 5, 10)] == ["section", "data", "data", "total"]
    assert [(r.doc_id, r.row_idx, r.col_idx) for r in got.issues.where("code = 'CROSSFOOT_FAIL'").collect()] == [("e", 7, 2)]
