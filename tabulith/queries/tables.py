"""Stitching, context, reconciliation, confidence and evaluation over tables made of orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions.text import is_section, is_title, norm
from tabulith.functions.values import parse_values
from tabulith.operators import context, evaluation, scoring, stitch
from tabulith.queries.base import query
from tabulith.queries.pages import BY_ORDER, TYPESET

_TABLES = """
SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS page_no, 0 AS table_idx, cast(o_orderkey % 2 AS int) AS kind,
  cast(60 + o_orderkey % 40 AS double) AS y0, cast(200 + o_orderkey % 300 AS double) AS y1, cast(72 AS double) AS x0, cast(500 AS double) AS x1, cast(612 AS double) AS page_width, cast(14 AS double) AS pitch, cast(300 + o_orderkey % 3 * 8 AS double) AS edge FROM {orders}"""


@query(
    "stitch_pairs",
    tables=_TABLES,
    oracle="""
WITH top AS (SELECT doc_id, median(y0) AS t FROM tables GROUP BY 1),
 p AS (SELECT a.doc_id, a.page_no, abs(a.edge / 612 - b.edge / 612) <= 0.015 AS same_columns, b.y0 <= t + 21 AS continues FROM tables a JOIN tables b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1 JOIN top ON top.doc_id = a.doc_id)
SELECT doc_id, page_no, same_columns, continues, CASE WHEN same_columns AND continues THEN 'stitch' WHEN same_columns OR continues THEN 'ambiguous' ELSE 'apart' END AS verdict FROM p""",
)
def stitch_pairs(tables):
    t = tables.withColumn("edges", F.array("edge", F.lit(500.0)))
    return stitch.stitch_pairs(t, stitch.content_top(tables)).select("doc_id", "page_no", "same_columns", "continues", "verdict")


@query(
    "stitch_chains",
    tables=_TABLES,
    oracle="""
WITH top AS (SELECT doc_id, median(y0) AS t FROM tables GROUP BY 1),
 p AS (SELECT a.doc_id, a.page_no, abs(a.edge / 612 - b.edge / 612) <= 0.015 AND b.y0 <= t + 21 AS ok FROM tables a JOIN tables b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1 JOIN top ON top.doc_id = a.doc_id),
 r AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM p WHERE ok)
SELECT doc_id, cast(page_no + 1 AS int) AS page_no, cast(min(page_no) OVER (PARTITION BY doc_id, g) AS int) AS root_page FROM r""",
)
def stitch_chains(tables):
    t = tables.withColumn("edges", F.array("edge", F.lit(500.0)))
    return stitch.chains(stitch.stitch_pairs(t, stitch.content_top(tables))).select("doc_id", "page_no", "root_page")


#: A header and an order's lines as rows of its table; each third order has another header.
_ROWS = """
SELECT t.doc_id, t.page_no, 0 AS table_idx, 0 AS row_idx, 0 AS col_idx, true AS is_header, CASE WHEN t.o_orderkey % 3 = 0 THEN 'Part' ELSE 'Item' END AS raw_text
FROM (SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS page_no, o_orderkey FROM {orders}) AS t
UNION ALL SELECT t.doc_id, t.page_no, 0, cast(l.line_idx AS int), 0, false, cast(l.l_partkey AS varchar(20))
FROM (SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS page_no, o_orderkey FROM {orders}) AS t
JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_idx FROM {lineitem}) AS l ON l.l_orderkey = t.o_orderkey"""


@query(
    "stitch_absorb",
    deal=BY_ORDER,
    tables=_TABLES,
    cells=_ROWS,
    oracle="""
WITH top AS (SELECT doc_id, median(y0) AS t FROM tables GROUP BY 1),
 p AS (SELECT a.doc_id, a.page_no + 1 AS page_no FROM tables a JOIN tables b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1 JOIN top ON top.doc_id = a.doc_id WHERE abs(a.edge / 612 - b.edge / 612) <= 0.015 AND b.y0 <= t + 21),
 runs AS (SELECT t.doc_id, t.page_no, max(CASE WHEN p.page_no IS NULL THEN t.page_no END) OVER (PARTITION BY t.doc_id ORDER BY t.page_no) AS root FROM tables t LEFT JOIN p ON p.doc_id = t.doc_id AND p.page_no = t.page_no),
 head AS (SELECT doc_id, page_no, raw_text FROM cells WHERE row_idx = 0),
 parts AS (SELECT r.doc_id, r.page_no, r.root, CASE WHEN r.page_no > r.root AND h.raw_text = g.raw_text THEN 1 ELSE 0 END AS skip, (SELECT count(*) FROM cells c WHERE c.doc_id = r.doc_id AND c.page_no = r.page_no) AS n
   FROM runs r JOIN head h ON h.doc_id = r.doc_id AND h.page_no = r.page_no JOIN head g ON g.doc_id = r.doc_id AND g.page_no = r.root),
 moves AS (SELECT *, sum(n - skip) OVER (PARTITION BY doc_id, root ORDER BY page_no) - n AS shift FROM parts)
SELECT c.doc_id, cast(CASE WHEN c.row_idx >= skip THEN root ELSE c.page_no END AS int) AS page_no, cast(CASE WHEN c.row_idx >= skip THEN c.row_idx + shift ELSE c.row_idx END AS int) AS row_idx,
  c.page_no AS source_page, c.page_no > root AND c.row_idx = skip AS boundary, c.raw_text FROM cells c JOIN moves m ON m.doc_id = c.doc_id AND m.page_no = c.page_no""",
)
def stitch_absorb(tables, cells):
    """Rows of tables that go on over page ends, under the first table's page and numbered on."""
    chained = stitch.chains(stitch.stitch_pairs(tables.withColumn("edges", F.array("edge", F.lit(500.0))), stitch.content_top(tables)))
    shapes = cells.groupBy("doc_id", "page_no", "table_idx").agg((F.max("row_idx") + 1).alias("n_rows"))
    moved = stitch.absorb(cells, stitch.absorption(chained, cells, shapes))
    return moved.select("doc_id", "page_no", "row_idx", "source_page", "boundary", "raw_text")


@query("content_top", tables=_TABLES, oracle="SELECT doc_id, median(y0) AS content_top FROM tables GROUP BY 1")
def content_top(tables):
    return stitch.content_top(tables)


@query(
    "header_jaccard",
    upper_rows="SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS int) AS row_idx, o_orderstatus AS a, o_orderpriority AS b FROM {orders}",
    lower_rows="SELECT o_custkey AS doc_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS int) AS row_idx, upper(o_orderstatus) AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE lower(o_orderpriority) END AS b FROM {orders}",
    oracle="""
WITH j AS (SELECT l.doc_id, l.row_idx, r.b <> 'other' AS ok FROM upper_rows l JOIN lower_rows r USING (doc_id, row_idx))
SELECT doc_id, cast(coalesce(min(CASE WHEN NOT ok THEN row_idx END), count(*)) AS bigint) AS skip FROM j GROUP BY 1""",
)
def header_jaccard(upper_rows, lower_rows):
    cells = lambda d: d.select("doc_id", "row_idx", F.array("a", "b").alias("cells"))
    return stitch.header_skip(cells(upper_rows), cells(lower_rows), ["doc_id"])


#: Lines of documents as lines of a page, a table under every tenth.
_LINES = """
SELECT source AS doc_id, cast(doc_id AS bigint) AS page_no, text FROM {documents}"""
_LINES_ORACLE = """
WITH l AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_idx FROM docs),
 t AS (SELECT doc_id, page_no, line_idx + 1 AS table_idx, (line_idx + 1) * 14 - 2 AS ty0 FROM l WHERE line_idx % 10 = 9)"""


def _lines(docs):
    lines = docs.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    lines = lines.withColumns({
        "y0": F.col("line_idx") * 14.0, "y1": F.col("line_idx") * 14.0 + 9.0, "x0": F.lit(72.0), "x1": F.lit(72.0) + F.length("text") * 5.0, "size": F.lit(9.0), "modal_size": F.lit(9.0),
        "italic_share": F.lit(0.0), "is_furniture": F.lit(False),
    })
    lines = lines.withColumns({"is_title": is_title(F.col("text"), F.lit(0.0), F.col("size"), F.col("modal_size")), "is_section": is_section(F.col("text"), F.lit(0.0), F.col("size"), F.col("modal_size"))})
    tables = lines.where("line_idx % 10 = 9").select("doc_id", "page_no", (F.col("line_idx") + 1).alias("table_idx"), ((F.col("line_idx") + 1) * 14.0 - 2.0).alias("y0"), ((F.col("line_idx") + 2) * 14.0 - 4.0).alias("y1"), F.lit(72.0).alias("x0"), F.lit(500.0).alias("x1"), F.lit(14.0).alias("pitch"))
    return lines, tables


_CLEAN = "trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_TITLE = f"""(len(string_split({_CLEAN}, ' ')) <= 16 AND {_CLEAN} <> '' AND (regexp_matches({_CLEAN}, '(?i)^(table|exhibit|annexure|schedule|statement|consolidated)\\b')
  OR (len(string_split({_CLEAN}, ' ')) >= 2 AND regexp_replace(text, '[^\\p{{L}}]', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Lu}}]'))))"""


@query(
    "title_asof",
    docs=_LINES,
    oracle=_LINES_ORACLE + f"""
SELECT doc_id, page_no, cast(table_idx AS int) AS table_idx, title FROM (SELECT t.doc_id, t.page_no, table_idx, {_CLEAN} AS title, row_number() OVER (PARTITION BY t.doc_id, t.page_no, table_idx ORDER BY line_idx DESC) AS r
  FROM t JOIN l ON l.doc_id = t.doc_id AND l.page_no = t.page_no AND l.line_idx * 14 + 9 <= ty0 AND ty0 - (l.line_idx * 14 + 9) <= 56 WHERE {_TITLE}) WHERE r = 1""",
)
def title_asof(docs):
    lines, tables = _lines(docs)
    return context.bind_titles(tables, lines)


@query(
    "section_path_topk",
    docs=_LINES,
    oracle=_LINES_ORACLE + f""",
 s AS (SELECT t.doc_id, t.page_no, table_idx, {_CLEAN} AS text, max(line_idx) AS last_at FROM t JOIN l ON l.doc_id = t.doc_id AND l.page_no = t.page_no AND l.line_idx * 14 + 9 <= ty0
   WHERE {_TITLE} OR regexp_matches({_CLEAN}, '(?i)^(item|part)\\s+[\\dIVXivx]+') GROUP BY 1, 2, 3, 4),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, table_idx ORDER BY last_at DESC) AS r FROM s)
SELECT doc_id, page_no, cast(table_idx AS int) AS table_idx, string_agg(text, ' / ' ORDER BY last_at) AS section_path FROM k WHERE r <= 4 GROUP BY 1, 2, 3""",
)
def section_path_topk(docs):
    lines, tables = _lines(docs)
    return context.bind_sections(tables, lines)


@query(
    "caption_below",
    lines="""
SELECT l_orderkey AS doc_id, 1 AS page_no, l_linenumber AS line_idx, l_partkey, concat(CASE l_partkey % 4 WHEN 0 THEN 'Source: ' WHEN 1 THEN 'Notes on ' ELSE 'Plain ' END, cast(l_partkey AS varchar(20))) AS text, cast(l_linenumber * 14 AS double) AS y0 FROM {lineitem}""",
    oracle="""
SELECT doc_id, min_by(text, struct_pack(y := y0, l := line_idx, t := text)) AS caption FROM lines WHERE l_partkey % 4 < 2 AND y0 >= 14 AND y0 - 14 <= 56 GROUP BY 1""",
)
def caption_below(lines):
    one = lines.dropDuplicates(["doc_id", "line_idx", "text"]).withColumns({"y1": F.col("y0") + 9.0, "x0": F.lit(0.0), "x1": F.lit(590.0), "size": F.lit(9.0), "modal_size": F.lit(9.0), "italic_share": F.lit(0.0), "is_furniture": F.lit(False)})
    order = one.withColumn("line_idx", F.struct("line_idx", "text"))
    tables = lines.select("doc_id", "page_no").distinct().withColumns({"table_idx": F.lit(0), "y0": F.lit(0.0), "y1": F.lit(14.0), "x0": F.lit(0.0), "x1": F.lit(600.0), "pitch": F.lit(14.0)})
    return context.bind_captions(tables, order).select("doc_id", "caption")


@query(
    "unit_inherit",
    events="SELECT user_id AS doc_id, event_id AS page_no, CASE WHEN event_id % 7 = 0 THEN '(in millions)' WHEN event_id % 11 = 0 THEN 'Rs. crore' ELSE 'no unit' END AS text, event_id % 3 AS kind FROM {events}",
    oracle="""
WITH u AS (SELECT *, CASE WHEN text = '(in millions)' THEN 'in millions' WHEN text = 'Rs. crore' THEN 'Rs. crore' END AS unit FROM events),
 c AS (SELECT *, last_value(unit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM u)
SELECT doc_id, page_no, coalesce(CASE WHEN kind = 0 THEN unit END, carried) AS unit, CASE WHEN kind = 0 AND unit IS NOT NULL THEN 'local' WHEN carried IS NOT NULL THEN 'inherited' END AS source FROM c""",
)
def unit_inherit(events):
    """A declaration stands close above its page's table on every third page, else far above."""
    lines = events.select("doc_id", "page_no", F.lit(0).alias("line_idx"), "text", F.when(F.col("kind") == 0, 80.0).otherwise(10.0).alias("y0"), F.when(F.col("kind") == 0, 89.0).otherwise(19.0).alias("y1"), F.lit(False).alias("is_furniture"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"))
    tables = events.select("doc_id", "page_no").withColumns({"table_idx": F.lit(0), "y0": F.lit(100.0), "y1": F.lit(200.0), "x0": F.lit(0.0), "x1": F.lit(9.0), "pitch": F.lit(14.0)})
    head = tables.select("doc_id", "page_no", "table_idx", F.lit(0).alias("row_idx"), F.lit("").alias("text"))
    return context.bind_units(tables, lines, head).select("doc_id", "page_no", "unit", "source")


@query(
    "footnote_bind",
    cells="""
SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_partkey % 5 = 0 THEN concat('Revenue ', cast(l_partkey AS varchar(20)), ' (', cast(l_suppkey % 4 + 1 AS varchar(2)), ')') WHEN l_partkey % 5 = 1 THEN '(12)' ELSE 'Cash' END AS text, l_suppkey % 4 + 1 AS mark, l_partkey FROM {lineitem}""",
    notes="SELECT o_orderkey AS doc_id, o_orderkey % 6 AS page_no, concat('(', cast(o_custkey % 4 + 1 AS varchar(2)), ') as restated ', o_orderstatus) AS text, o_custkey % 4 + 1 AS mark FROM {orders}",
    oracle="""
SELECT c.doc_id, c.page_no, n.page_no AS note_page, count(*) AS n FROM (SELECT DISTINCT doc_id, page_no, text, mark, l_partkey FROM cells) c JOIN notes n ON n.doc_id = c.doc_id AND n.mark = c.mark AND n.page_no BETWEEN c.page_no AND c.page_no + 2 WHERE l_partkey % 5 = 0 GROUP BY 1, 2, 3""",
)
def footnote_bind(cells, notes):
    lines = notes.withColumn("line_idx", F.lit(0))
    c = cells.select("doc_id", "page_no", F.lit(0).alias("table_idx"), F.lit(0).alias("col_idx"), F.col("text").alias("row_idx"), "text").distinct()
    return context.bind_footnotes(c, context.footnotes(lines)).groupBy("doc_id", "page_no", "note_page").agg(F.count("*").alias("n"))


@query(
    "label_marker_strip",
    labels_="SELECT p_partkey, p_size % 6 AS form, p_name, concat(CASE WHEN p_size % 6 = 3 THEN '(1) ' ELSE '' END, p_name, CASE p_size % 6 WHEN 0 THEN '*' WHEN 1 THEN ' (1)' WHEN 2 THEN ' (9)' ELSE '' END) AS label FROM {part}",
    oracle="SELECT p_partkey, CASE WHEN form = 2 THEN label ELSE p_name END AS label FROM labels_",
)
def label_marker_strip(labels_):
    return labels_.select("p_partkey", context.strip_marks(F.col("label"), F.array(F.lit("*"), F.lit("1"))).alias("label"))


@query(
    "asset_furniture",
    images="""
SELECT l_suppkey AS doc_id, l_linenumber AS page_no, l_partkey % 7 AS xref, cast(CASE WHEN l_partkey % 7 < 3 THEN 10 ELSE 10 + l_linenumber * 60 END AS double) AS x0, cast(10 AS double) AS y0, cast(CASE WHEN l_partkey % 7 < 3 THEN 60 ELSE 60 + l_linenumber * 60 END AS double) AS x1, cast(40 AS double) AS y1 FROM {lineitem}""",
    oracle="""
WITH n AS (SELECT doc_id, count(DISTINCT page_no) AS p FROM images GROUP BY 1)
SELECT i.doc_id, xref FROM images i JOIN n ON n.doc_id = i.doc_id WHERE xref < 3 GROUP BY i.doc_id, xref, p HAVING count(DISTINCT page_no) >= greatest(0.4 * p, 3)""",
)
def asset_furniture(images):
    n = images.groupBy("doc_id").agg(F.countDistinct("page_no").alias("n_pages"))
    return context.furniture_images(images, n)


@query(
    "asset_links",
    tables=_TABLES,
    oracle="""
SELECT doc_id, page_no, cast(CASE WHEN y0 <= 600 AND 300 > y1 AND 300 - y1 > 28 THEN 0.4 ELSE 0.5 END AS double) AS score, 'co-located' AS relation FROM tables""",
)
def asset_links(tables):
    assets = tables.select("doc_id", "page_no", F.lit(0).alias("asset_idx"), F.lit(300.0).alias("y0"), F.lit(600.0).alias("y1"))
    linked = context.link_assets(tables, assets)
    return linked.select("doc_id", "page_no", F.round("score", 6).alias("score"), "relation")


# ---- reconciliation and confidence: an order is a table, its lines are rows, its total is made of them

_LEDGER = f"""
SELECT doc_id, cast(line_idx AS int) AS row_idx, l_partkey, cast(round(l_extendedprice * 100) AS bigint) AS cents FROM ({TYPESET}) AS t"""
_LEDGER_ORACLE = """
WITH g AS (SELECT doc_id, sum(cents) AS s, count(*) AS n, max(row_idx) AS last, max(CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END) AS err, min_by(cents, row_idx) AS first FROM ledger GROUP BY 1),
 r AS (SELECT doc_id, last + 1 AS total_row, n, err, CASE WHEN doc_id % 7 = 0 THEN s + 100 WHEN doc_id % 7 = 1 THEN first - (s - first) ELSE s END AS total, s, first FROM g WHERE n >= 2),
 d AS (SELECT *, CASE WHEN abs(total - s) <= abs(total - (first - (s - first))) THEN total - s ELSE total - (first - (s - first)) END AS delta FROM r)"""


def _ledger(ledger, n_parts):
    """(cells, groups): lines and a total each; some totals are off by one, some subtract, some lines are errors."""
    total = ledger.groupBy("doc_id").agg(F.sum("cents").alias("s"), F.min_by("cents", "row_idx").alias("first"), (F.max("row_idx") + 1).alias("row_idx"))
    off = F.when(F.col("doc_id") % 7 == 0, F.col("s") + 100).when(F.col("doc_id") % 7 == 1, 2 * F.col("first") - F.col("s")).otherwise(F.col("s"))
    rows = ledger.select("doc_id", "row_idx", "cents", (F.col("l_partkey") % 23 == 0).alias("err")).unionByName(total.select("doc_id", "row_idx", off.alias("cents"), F.lit(False).alias("err")))
    money = F.format_string("%.2f", (F.col("cents") / 100).cast("double"))
    text = F.when(F.col("err"), "#REF!").when(F.col("cents") < 0, F.concat(F.lit("("), F.replace(money, F.lit("-"), F.lit("")), F.lit(")"))).otherwise(money)
    cells = rows.select("doc_id", "row_idx", F.lit(1).alias("col_idx"), text.alias("text"))
    cells = parse_values(cells, "text", "p")
    cells = cells.select("doc_id", "row_idx", "col_idx", "text", "p.value_type", F.col("p.normalized_value").alias("value"), "p.notes", F.lit("decimal").alias("column_type"))
    groups = ledger.select("doc_id", "row_idx").join(total.select("doc_id", F.col("row_idx").alias("subtotal_row")), "doc_id")
    cells = cells.repartition(n_parts, "doc_id", "row_idx")
    return cells, groups.select("doc_id", F.lit(0).alias("section_idx"), F.lit(0).alias("group_idx"), F.col("row_idx").alias("member_row"), "subtotal_row")


@query(
    "crossfoot",
    deal=BY_ORDER,
    ledger=_LEDGER,
    oracle=_LEDGER_ORACLE + """
SELECT doc_id, CASE WHEN err = 1 THEN 'unverifiable' WHEN abs(delta) <= 2 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN err = 0 THEN cast(delta AS bigint) END AS delta_cents FROM d""",
)
def crossfoot(ledger, n_parts):
    found = scoring.crossfoot(*_ledger(ledger, n_parts), ["doc_id"])
    return found.select("doc_id", "status", (F.col("delta") * 100).cast("long").alias("delta_cents"))


def _scored(ledger, n_parts):
    cells, groups = _ledger(ledger, n_parts)
    found = scoring.crossfoot(cells, groups, ["doc_id"])
    signals = scoring.crossfoot_signals(found, groups, ["doc_id"])
    at = ["doc_id", "row_idx", "col_idx"]
    joined = cells.repartition(n_parts, *at).join(signals.repartition(n_parts, *at), at, "left").withColumns({"is_header": F.lit(False), "header_split": F.lit(False), "low_layout": F.lit(False), "row_flags": F.array().cast("array<string>")})
    score, codes = scoring.confidence()
    return joined.withColumn("raw_score", score).withColumns({"codes": codes, "confidence": scoring.calibrate(F.col("raw_score"))}), found


_SCORED_ORACLE = _LEDGER_ORACLE + """,
 c AS (SELECT doc_id, row_idx, l_partkey % 23 = 0 AS err FROM ledger UNION ALL SELECT doc_id, last + 1, false FROM g),
 s AS (SELECT c.doc_id, c.row_idx, c.err, CASE WHEN d.err = 0 THEN CASE WHEN abs(delta) <= 2 THEN 1 ELSE -1 END ELSE 0 END AS cf FROM c LEFT JOIN d ON c.doc_id = d.doc_id),
 x AS (SELECT *, greatest(0.05, least(1.0, 0.95 - CASE WHEN err THEN 1.05 ELSE 0 END + CASE cf WHEN 1 THEN 0.04 WHEN -1 THEN -0.4 ELSE 0 END)) AS raw,
   CASE WHEN err THEN 'SOURCE_ERROR_VALUE|TYPE_NONCONFORMITY' WHEN cf = -1 THEN 'CROSSFOOT_FAIL' ELSE '' END AS codes FROM s),
 y AS (SELECT *, 1 / (1 + exp(-(-4.6 + 9.2 * raw))) AS v FROM x),
 z AS (SELECT *, greatest(0.05, least(1.0, CASE WHEN v <= 0 THEN 0.05 WHEN v <= 0.3 THEN 0.05 + v / 0.3 * 0.1 WHEN v <= 0.5 THEN 0.15 + (v - 0.3) / 0.2 * 0.35 WHEN v <= 0.85 THEN 0.5 + (v - 0.5) / 0.35 * 0.35
   WHEN v <= 0.94 THEN 0.85 + (v - 0.85) / 0.09 * 0.08 ELSE 0.93 + (v - 0.94) / 0.06 * 0.03 END)) AS conf FROM y)"""


@query("confidence", deal=BY_ORDER, ledger=_LEDGER, oracle=_SCORED_ORACLE + " SELECT doc_id, row_idx, round(cast(raw AS double), 6) AS raw_score, codes FROM z")
def confidence(ledger, n_parts):
    return _scored(ledger, n_parts)[0].select("doc_id", "row_idx", F.round("raw_score", 6).alias("raw_score"), F.array_join("codes", "|").alias("codes"))


@query("calibrated", deal=BY_ORDER, ledger=_LEDGER, oracle=_SCORED_ORACLE + " SELECT doc_id, row_idx, round(cast(conf AS double), 6) AS confidence FROM z")
def calibrated(ledger, n_parts):
    return _scored(ledger, n_parts)[0].select("doc_id", "row_idx", F.round("confidence", 6).alias("confidence"))


@query("review_queue", deal=BY_ORDER, ledger=_LEDGER, oracle=_SCORED_ORACLE + " SELECT doc_id, row_idx, round(1 - cast(conf AS double), 6) AS priority, codes FROM z WHERE conf < 0.9 OR codes <> ''")
def review_queue(ledger, n_parts):
    cells = _scored(ledger, n_parts)[0].withColumns({"page_no": F.lit(1), "table_idx": F.lit(0)})
    return scoring.review_queue(cells).select("doc_id", "row_idx", F.round("priority", 6).alias("priority"), F.array_join("codes", "|").alias("codes"))


@query(
    "issue_counts",
    deal=BY_ORDER,
    ledger=_LEDGER,
    oracle=_LEDGER_ORACLE + """
SELECT CASE WHEN err = 1 THEN 'info' ELSE 'warning' END AS severity, CASE WHEN err = 1 THEN 'CROSSFOOT_UNVERIFIABLE' ELSE 'CROSSFOOT_FAIL' END AS code, count(*) AS n FROM d WHERE err = 1 OR abs(delta) > 2 GROUP BY 1, 2
UNION ALL SELECT 'error', 'SOURCE_ERROR_VALUE', count(*) FROM ledger WHERE l_partkey % 23 = 0""",
)
def issue_counts(ledger, n_parts):
    cells, found = _scored(ledger, n_parts)
    return scoring.issue_counts(found, cells)


@query(
    "split_header",
    cells="""
SELECT o_orderkey AS doc_id, r AS row_idx, c AS col_idx, CASE WHEN r = 0 THEN CASE WHEN (o_orderkey + c) % 3 = 0 THEN 'plain' ELSE 'September 28,' END WHEN r = 1 THEN CASE WHEN c = 3 AND o_orderkey % 2 = 0 THEN 'n/a' ELSE cast(2020 + c AS varchar(9)) END ELSE '1,234' END AS text
FROM {orders} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) AS rr CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS cc""",
    oracle="""
WITH h AS (SELECT doc_id, col_idx FROM cells WHERE row_idx = 0 AND col_idx >= 1 AND (doc_id + col_idx) % 3 <> 0 AND NOT (col_idx = 3 AND doc_id % 2 = 0)), k AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(*) >= 2)
SELECT h.doc_id, r AS row_idx, col_idx FROM h JOIN k USING (doc_id), (SELECT 0 AS r UNION ALL SELECT 1)""",
)
def split_header(cells):
    return scoring.split_headers(cells, ["doc_id"])


# ---- questions that the stored schema has to make easy


@query(
    "litmus_header",
    cells="SELECT l_orderkey AS doc_id, l_linenumber AS row_idx, l_shipdate, l_extendedprice AS value, concat('Year ', cast(cast(extract(year FROM l_shipdate) AS int) AS varchar(9))) AS header FROM {lineitem}",
    oracle="SELECT doc_id, count(*) AS n, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS cents FROM cells WHERE header = 'Year 1995' GROUP BY 1",
)
def litmus_header(cells):
    """Cells under a header token, as a join with the tokens of header paths."""
    tokens = cells.select("doc_id", "row_idx", "value", F.posexplode(F.array(F.lit("Amounts"), F.col("header"))).alias("depth", "token"))
    wanted = tokens.sparkSession.createDataFrame([("year 1995",)], "t string")
    hit = tokens.join(F.broadcast(wanted), norm(F.col("token")) == F.col("t"), "left_semi")
    return hit.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(
    "litmus_row_label",
    cells="SELECT l_orderkey AS doc_id, p_brand AS parent, p_type AS label, l_extendedprice AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    oracle="SELECT label, count(*) AS n, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS cents FROM cells WHERE parent = 'Brand#11' GROUP BY 1",
)
def litmus_row_label(cells):
    tokens = cells.withColumn("path", F.array("parent", "label")).select("label", "value", F.posexplode("path").alias("depth", "token"))
    return tokens.where("token = 'Brand#11'").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(
    "audit_summary",
    tables="SELECT o_orderpriority AS doc_id, o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 'TRAP_TOC' WHEN 'P' THEN 'TRAP_KEYVALUE' END AS rejected_as, o_orderkey % 5 AS n_cells FROM {orders}",
    oracle="""
SELECT doc_id, rejected_as, cast(grouping(doc_id) + grouping(rejected_as) AS bigint) AS depth, count(*) AS n_tables, cast(sum(n_cells) AS bigint) AS n_cells FROM (SELECT doc_id, coalesce(rejected_as, 'accepted') AS rejected_as, n_cells FROM tables) GROUP BY ROLLUP (doc_id, rejected_as)""",
)
def audit_summary(tables):
    t = tables.withColumn("rejected_as", F.coalesce("rejected_as", F.lit("accepted")))
    out = t.rollup("doc_id", "rejected_as").agg((F.grouping("doc_id") + F.grouping("rejected_as")).cast("long").alias("depth"), F.count("*").alias("n_tables"), F.sum("n_cells").alias("n_cells"))
    return out.select("doc_id", "rejected_as", "depth", "n_tables", "n_cells")


# ---- evaluation


@query(
    "content_overlap",
    deal=BY_ORDER,
    found="SELECT l_orderkey AS doc_id, concat(' ', upper(l_returnflag), '  ', l_linestatus) AS text FROM {lineitem}",
    wanted="SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 3 = 0 THEN 'x y' ELSE concat(lower(l_returnflag), ' ', l_linestatus) END AS text FROM {lineitem}",
    oracle="""
WITH a AS (SELECT doc_id, lower(trim(regexp_replace(text, ' +', ' ', 'g'))) AS t, count(*) AS n FROM found GROUP BY 1, 2), b AS (SELECT doc_id, lower(text) AS t, count(*) AS n FROM wanted GROUP BY 1, 2)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / cast(sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))) AS double), 6) AS overlap FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.t = b.t GROUP BY 1""",
)
def content_overlap(found, wanted, n_parts):
    return evaluation.content_overlap(found, wanted, ["doc_id"], n_parts).withColumn("overlap", F.round("overlap", 6))


@query(
    "numeric_overlap",
    deal=BY_ORDER,
    found="SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 4 = 0 THEN l_quantity + 1000 ELSE l_quantity END AS value FROM {lineitem}",
    wanted="SELECT l_orderkey AS doc_id, concat('(', cast(cast(l_quantity AS int) AS varchar(9)), '.00)') AS text, l_quantity, l_partkey % 3 AS form FROM {lineitem}",
    oracle="""
WITH w AS (SELECT DISTINCT doc_id, CASE WHEN form = 0 THEN -l_quantity ELSE l_quantity END AS w FROM wanted), f AS (SELECT DISTINCT doc_id, value FROM found)
SELECT w.doc_id, round(count(f.value) / cast(count(*) AS double), 6) AS overlap FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND abs(f.value - w.w) < 0.005 GROUP BY 1""",
)
def numeric_overlap(found, wanted, n_parts):
    w = wanted.withColumn("text", F.when(F.col("form") == 0, F.col("text")).otherwise(F.regexp_replace("text", "[()]", "")))
    return evaluation.numeric_overlap(found, w, ["doc_id"], n_parts=n_parts).withColumn("overlap", F.round("overlap", 6))


_JUDGED = "SELECT l_orderkey, (l_partkey % 100) / 100.0 AS confidence, l_suppkey % 5 <> 0 AS correct FROM {lineitem}"


@query(
    "flag_pr",
    cells=_JUDGED,
    oracle="""
SELECT n, n_correct, n_flagged, n_wrong, n_caught, n_silent, round(n_caught / cast(n_flagged AS double), 6) AS precision, round(n_caught / cast(n_wrong AS double), 6) AS recall FROM (SELECT count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (confidence < 0.9) AS n_flagged, count(*) FILTER (NOT correct) AS n_wrong,
  count(*) FILTER (confidence < 0.9 AND NOT correct) AS n_caught, count(*) FILTER (confidence >= 0.9 AND NOT correct) AS n_silent FROM cells)""",
)
def flag_pr(cells):
    return evaluation.flag_metrics(cells).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(
    "reliability_bins",
    cells=_JUDGED,
    oracle="""
SELECT cast(low AS double) AS low, count(*) AS n, round(cast(avg(confidence) AS double), 6) AS mean_confidence, round(avg(CASE WHEN correct THEN 1 ELSE 0 END), 6) AS accuracy FROM (SELECT *, CASE WHEN confidence >= 0.9 THEN 0.9 WHEN confidence >= 0.8 THEN 0.8 WHEN confidence >= 0.6 THEN 0.6 WHEN confidence >= 0.4 THEN 0.4 WHEN confidence >= 0.2 THEN 0.2 ELSE 0.0 END AS low FROM cells) GROUP BY 1""",
)
def reliability_bins(cells):
    return evaluation.reliability(cells).withColumns({"mean_confidence": F.round("mean_confidence", 6), "accuracy": F.round("accuracy", 6)})


@query(
    "triage_suspicion",
    deal=BY_ORDER,
    cells="""
SELECT l_orderkey AS doc_id, cast(line_idx AS int) AS row_idx, c AS col_idx, CASE WHEN c = 0 THEN concat('part ', cast(l_partkey % 5 AS varchar(9))) WHEN c = 1 THEN 'words of text' WHEN (line_idx + c) % 2 = 0 THEN '' ELSE '12' END AS text, CASE WHEN c < 2 THEN 'text' ELSE 'integer' END AS value_type
FROM (SELECT doc_id AS l_orderkey, line_idx, l_partkey FROM (""" + TYPESET + """) AS t) AS r CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) AS three""",
    oracle="""
WITH f AS (SELECT * FROM cells WHERE text <> ''), nr AS (SELECT doc_id, max(row_idx) AS nr FROM cells GROUP BY 1),
 col AS (SELECT doc_id, sum(CASE WHEN n * 3 >= nr THEN 1 ELSE 0 END) AS dense FROM (SELECT doc_id, col_idx, count(*) AS n FROM f GROUP BY 1, 2) JOIN nr USING (doc_id) GROUP BY 1),
 pat AS (SELECT doc_id, row_idx, max(col_idx) AS p FROM f GROUP BY 1, 2), rag AS (SELECT doc_id, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS lone, sum(n) AS rows FROM (SELECT doc_id, p, count(*) AS n FROM pat GROUP BY 1, 2) GROUP BY 1),
 b AS (SELECT doc_id, avg(len(string_split(text, ' '))) AS words, avg(CASE WHEN value_type = 'integer' THEN 1 ELSE 0 END) AS num, count(*) FILTER (col_idx = 0) AS labels, count(DISTINCT CASE WHEN col_idx = 0 THEN text END) AS d FROM f GROUP BY 1)
SELECT doc_id, round((1 - dense / 3.0 + least(1, words / 8) + 1 - num + 0 + (labels - d) / cast(labels AS double) + lone / cast(rows AS double)) / 6, 6) AS suspicion FROM b JOIN col USING (doc_id) JOIN rag USING (doc_id)""",
)
def triage_suspicion(cells):
    tables = cells.groupBy("doc_id").agg(F.max("row_idx").alias("n_rows"), F.lit(3).alias("n_cols"), F.lit(0).alias("n_mixed"))
    return evaluation.suspicion(cells, tables, ["doc_id"]).select("doc_id", F.round("suspicion", 6).alias("suspicion"))


@query(
    "label_audit",
    cells="SELECT item_id, text, item_id % 3 AS form FROM {benchmark}",
    oracle="""
SELECT CASE form WHEN 0 THEN 'exact' WHEN 1 THEN 'hyphen' ELSE 'missing' END AS found, count(*) AS n FROM cells GROUP BY 1""",
)
def label_audit(cells):
    """A label's words against a page that holds them, holds them with hyphens, or holds others."""
    page = cells.select("item_id", F.concat(F.lit("Before. "), F.when(F.col("form") == 0, F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("form") == 1, F.concat(F.substring("text", 1, 5), F.lit("-"), F.expr("substring(text, 6)"))).otherwise("nothing of it")).alias("page_text"))
    return evaluation.label_audit(cells, page, ["item_id"]).groupBy("found").agg(F.count("*").alias("n"))
