"""Review queue, run log, summary, workbook and viewer of an extraction."""

from __future__ import annotations

import html
import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.config import CONFIG, Config
from tabulith.operators.scoring import review_queue
from tabulith.plans.extract import TABLE, Extraction


def queue_rows(found: Extraction, config: Config = CONFIG) -> DataFrame:
    """The review queue as strings: four decimals, codes joined by ``|``."""
    q = review_queue(found.cells, config)
    four = lambda c: F.format_string("%.4f", F.col(c))
    return q.select(*TABLE, "row_idx", "col_idx", "raw_text", "value_type", four("confidence").alias("confidence"), four("priority").alias("priority"), F.concat_ws("|", "codes").alias("codes"))


def write_queue(found: Extraction, folder: str, config: Config = CONFIG) -> None:
    queue_rows(found, config).write.mode("overwrite").option("header", True).csv(folder)


def run_log(found: Extraction) -> DataFrame:
    """Events of a run as one column of JSON lines, without a clock."""
    pages = found.stats.select(F.lit("page").alias("event"), "doc_id", "page_no", F.to_json(F.struct("line_pitch", "word_gap", "notes")).alias("detail"))
    tables = found.tables.select(F.lit("table").alias("event"), "doc_id", "page_no", F.to_json(F.struct("table_idx", "rejected_as", "support", "flags")).alias("detail"))
    issues = found.issues.select(F.lit("issue").alias("event"), "doc_id", "page_no", F.to_json(F.struct("table_idx", "severity", "code", "row_idx", "col_idx")).alias("detail"))
    return pages.unionByName(tables).unionByName(issues).orderBy("doc_id", "page_no", "event", "detail").select(F.to_json(F.struct("event", "doc_id", "page_no", "detail")).alias("value"))


def summary(found: Extraction) -> DataFrame:
    """Tables, rejections, cells and doubtful cells of each document and of all."""
    t = found.tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.count("rejected_as").alias("rejected"))
    c = found.cells.groupBy("doc_id").agg(F.count("confidence").alias("cells"), F.sum((F.size("codes") > 0).cast("int")).alias("with_codes"))
    both = t.join(c, "doc_id", "left").na.fill(0)
    return both.rollup("doc_id").agg(*[F.sum(k).alias(k) for k in ("tables", "rejected", "cells", "with_codes")])


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_REL = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook with fixed dates, so that equal sheets give equal bytes."""

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape("" if v is None else str(v), quote=False)}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    names = list(sheets)
    parts = {
        "[Content_Types].xml": _TYPES.format("".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(names) + 1))),
        "_rels/.rels": _REL.format('<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'),
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook {_NS}><sheets>' + "".join(f'<sheet name="{html.escape(s[:31])}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _REL.format("".join(f'<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(names) + 1))),
    }
    for n, s in enumerate(names, 1):
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_NS}><sheetData>' + "".join(f"<row>{''.join(map(cell, row))}</row>" for row in sheets[s]) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def table_workbook(found: Extraction, doc_id, page_no: int, table_idx: int, config: Config = CONFIG) -> bytes:
    """Data, Context, Provenance and Issues of one table; a page's table is small, so the driver holds it.

    Values are native where the confidence allows it; percentages are divided by 100.
    """
    one = (F.col("doc_id") == doc_id) & (F.col("page_no") == page_no) & (F.col("table_idx") == table_idx)
    least = config.f("workbook.native_type_min_confidence")
    cells = found.cells.where(one).orderBy("row_idx", "col_idx").collect()
    grid: list[list] = [[""] * (1 + max((c.col_idx for c in cells), default=0)) for _ in range(1 + max((c.row_idx for c in cells), default=0))]
    for c in cells:
        native = c.value is not None and c.confidence is not None and c.confidence >= least
        grid[c.row_idx][c.col_idx] = (c.value / 100 if c.value_type == "percent" else c.value) if native else c.raw_text
    t = found.tables.where(one).first()
    context = [["title", t.title], ["caption", t.caption], ["section", t.section_path], ["unit", t.unit_scale_note], ["unit source", t.unit_scale_source]] if t else []
    where = [["row", "column", "page", "x0", "y0", "x1", "y1", "confidence", "codes"]] + [[c.row_idx, c.col_idx, c.source_page, c.x0, c.y0, c.x1, c.y1, c.confidence, "|".join(c.codes or [])] for c in cells]
    issues = [["severity", "code", "row", "column"]] + [[i.severity, i.code, i.row_idx, i.col_idx] for i in found.issues.where(one).orderBy("code", "row_idx", "col_idx").collect()]
    issues += [["warning", "LOW_CONFIDENCE", c.row_idx, c.col_idx] for c in cells if c.confidence is not None and c.confidence < least]
    return workbook({"Data": grid, "Context": context, "Provenance": where, "Issues": issues})


def viewer(found: Extraction, doc_id, limit: int = 200) -> str:
    """One document's first ``limit`` tables, whole, as a page; doubtful cells are marked."""
    first = found.tables.where((F.col("doc_id") == doc_id) & F.col("rejected_as").isNull()).select(*TABLE).orderBy(*TABLE).limit(limit)
    cells = found.cells.join(first, TABLE, "left_semi").orderBy(*TABLE, "row_idx", "col_idx").collect()
    parts, at = ["<!DOCTYPE html><meta charset=utf-8><style>td{border:1px solid #ccc;padding:2px 6px}.d{background:#fdd}</style>"], None
    for c in cells:
        here = (c.page_no, c.table_idx)
        if at is None or at[0] != here:
            parts.append(("</tr></table>" if at else "") + f"<h3>page {c.page_no}, table {c.table_idx}</h3><table><tr>")
        elif at[1] != c.row_idx:
            parts.append("</tr><tr>")
        mark = " class=d" if c.codes else ""
        parts.append(f'<td{mark} title="{c.confidence:.4f} {html.escape("|".join(c.codes))}">{html.escape(c.raw_text)}</td>')
        at = (here, c.row_idx)
    return "".join(parts) + ("</tr></table>" if at else "")


def overlay(width: float, height: float, boxes: list[tuple]) -> str:
    """A page's boxes (x0, y0, x1, y1, label) as SVG."""
    rects = "".join(f'<rect x="{x0:g}" y="{y0:g}" width="{x1 - x0:g}" height="{y1 - y0:g}" fill="none" stroke="#06c"><title>{html.escape(str(s))}</title></rect>' for x0, y0, x1, y1, s in boxes)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">{rects}</svg>'
