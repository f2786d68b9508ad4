"""Page intake and layout over pages that are rendered from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions.geometry import iou, overlap_ratio
from tabulith.functions.text import is_closed, is_open
from tabulith.operators import columns, layout, pages
from tabulith.queries.base import query


@query(
    "page_typing",
    docs="SELECT doc_id, length(trim(text)) AS chars, (doc_id % 10) / 10.0 AS coverage FROM {documents}",
    oracle="""
SELECT page_type, count(*) AS n FROM (SELECT CASE WHEN chars < 20 THEN 'raster' WHEN coverage >= 0.75 AND chars < 200 THEN 'raster' WHEN coverage >= 0.3 THEN 'hybrid' ELSE 'digital' END AS page_type FROM docs) GROUP BY 1""",
)
def page_typing(docs):
    return docs.groupBy(pages.classify_page(F.col("chars"), F.col("coverage")).alias("page_type")).agg(F.count("*").alias("n"))


#: Groups of an order's lines are worked out where the lines are dealt.
BY_ORDER = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]}

_IMAGES = """
SELECT l_orderkey AS doc_id, l_suppkey % 20 AS page_no, cast(l_partkey % 500 AS double) AS x0, cast(l_quantity * 10 AS double) AS y0,
  cast(l_partkey % 500 + 20 + l_linenumber * 9 AS double) AS x1, cast(l_quantity * 10 + 15 + l_linenumber * 7 AS double) AS y1 FROM {lineitem}"""


@query(
    "image_coverage",
    deal={"images": pages.PAGE, "pages_": pages.PAGE},
    images=_IMAGES,
    pages_="SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 20 AS page_no, cast(612 AS double) AS width, cast(792 AS double) AS height FROM {lineitem} UNION ALL SELECT DISTINCT l_orderkey, 20, cast(612 AS double), cast(792 AS double) FROM {lineitem}",
    oracle="""
WITH cells AS (SELECT DISTINCT doc_id, page_no, gx, gy FROM (SELECT doc_id, page_no, unnest(range(a, greatest(b, a + 1))) AS gx, c, d FROM (
    SELECT doc_id, page_no, cast(floor(x0 / 612 * 128) AS bigint) AS a, cast(least(ceil(x1 / 612 * 128), 128) AS bigint) AS b, cast(floor(y0 / 792 * 128) AS bigint) AS c, cast(least(ceil(y1 / 792 * 128), 128) AS bigint) AS d FROM images)),
  LATERAL (SELECT unnest(range(c, greatest(d, c + 1))) AS gy)),
 n AS (SELECT doc_id, page_no, count(*) / 16384.0 AS v FROM cells GROUP BY 1, 2)
SELECT pages_.doc_id, pages_.page_no, cast(coalesce(v, 0) AS double) AS image_coverage FROM pages_ LEFT JOIN n USING (doc_id, page_no)""",
)
def image_coverage(images, pages_):
    return pages.image_coverage(images, pages_)


#: Names set in a fixed pitch: a page for each nation, a line for each customer.
_SET = """
SELECT c_nationkey AS doc_id, cast(c_custkey - c_custkey % 100 AS bigint) AS page_no, cast(c_custkey % 100 AS int) AS line_no, concat(c_name, '  ', lower(c_mktsegment), ' ', cast(cast(floor(c_acctbal) AS int) AS varchar(20))) AS s FROM {customer}"""


@query(
    "tokenise",
    set_lines=_SET,
    oracle="""
WITH w AS (SELECT doc_id, page_no, line_no, s, unnest(regexp_extract_all(s, '[^ ]+')) AS text, unnest(range(len(regexp_extract_all(s, '[^ ]+')))) AS k FROM set_lines)
SELECT doc_id, page_no, text, cast(length(text) * 5 AS double) AS width, count(*) AS n FROM w GROUP BY 1, 2, 3, 4""",
)
def tokenise(set_lines):
    """Glyphs of five points each, put together to words again."""
    chars = set_lines.select("doc_id", "page_no", "line_no", F.posexplode(F.split("s", "")).alias("char_no", "ch"))
    glyphs = chars.select(
        "doc_id", "page_no", F.lit(0).alias("block_no"), "line_no", F.lit(0).alias("span_no"), "char_no", "ch", (F.col("char_no") * 5.0).alias("x0"), (F.col("line_no") * 14.0).alias("y0"),
        (F.col("char_no") * 5.0 + 5.0).alias("x1"), (F.col("line_no") * 14.0 + 9.0).alias("y1"), F.lit("Mono-Bold").alias("font"), F.lit(9.0).alias("size"), F.lit(0).alias("flags"),
    )
    words = pages.words_from_glyphs(glyphs)
    return words.groupBy("doc_id", "page_no", "text", (F.col("x1") - F.col("x0")).alias("width")).agg(F.count("*").alias("n"))


_SPANS = """
SELECT l_suppkey AS doc_id, l_linenumber AS page_no, cast(8 + l_partkey % 5 AS double) AS size, l_returnflag AS text, cast(l_quantity AS bigint) AS n_chars,
  CASE WHEN l_partkey % 11 = 0 THEN 0.0 ELSE 1.0 END AS dir_cos, CASE WHEN l_partkey % 11 = 0 THEN 1.0 ELSE 0.0 END AS dir_sin FROM {lineitem}"""


@query(
    "modal_size",
    spans=_SPANS,
    oracle="""
SELECT doc_id, page_no, size AS modal_size FROM (SELECT doc_id, page_no, size, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY count(*) DESC, size) AS r FROM spans GROUP BY 1, 2, 3) WHERE r = 1""",
)
def modal_size(spans):
    return pages.modal_size(spans)


@query(
    "weighted_angle_mode",
    spans=_SPANS,
    oracle="""
SELECT doc_id, page_no, angle AS text_angle FROM (SELECT doc_id, page_no, angle, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY sum(n_chars) DESC, angle) AS r
  FROM (SELECT *, CASE WHEN dir_sin = 1 THEN cast(-90 AS double) ELSE cast(0 AS double) END AS angle FROM spans) GROUP BY 1, 2, 3) WHERE r = 1""",
)
def weighted_angle_mode(spans):
    return pages.text_angle(spans)


@query(
    "pitch_histogram_peak",
    gaps="SELECT l_suppkey AS doc_id, CASE WHEN l_partkey % 3 = 0 THEN l_quantity ELSE 14.0 + l_discount END AS v FROM {lineitem}",
    oracle="""
WITH top AS (SELECT doc_id, count(*) AS n, quantile_cont(v, 0.95) AS hi FROM gaps GROUP BY 1 HAVING count(*) >= 8),
 binned AS (SELECT g.doc_id, v, least(cast(floor(v / (hi / 64)) AS int), 63) AS bin FROM gaps g JOIN top t ON g.doc_id = t.doc_id WHERE hi > 0 AND v <= hi),
 counts AS (SELECT doc_id, bin, count(*) AS c FROM binned GROUP BY 1, 2),
 spine AS (SELECT DISTINCT doc_id, unnest(range(64)) AS bin FROM counts),
 dense AS (SELECT s.doc_id, s.bin, coalesce(c, 0) AS c FROM spine s LEFT JOIN counts k ON s.doc_id = k.doc_id AND s.bin = k.bin),
 smooth AS (SELECT doc_id, bin, avg(c) OVER w AS m, sum(c) OVER w AS s FROM dense WINDOW w AS (PARTITION BY doc_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 best AS (SELECT doc_id, bin, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, bin) AS r FROM smooth) WHERE r = 1),
 total AS (SELECT doc_id, sum(c) AS t FROM counts GROUP BY 1),
 peak AS (SELECT b.doc_id, median(v) AS peak FROM best b JOIN total t ON b.doc_id = t.doc_id JOIN binned x ON x.doc_id = b.doc_id AND x.bin BETWEEN b.bin - 1 AND b.bin + 1 WHERE s >= 0.06 * t GROUP BY 1)
SELECT DISTINCT g.doc_id, round(coalesce(peak, 0), 6) AS peak, peak IS NOT NULL AS stable FROM gaps g LEFT JOIN peak p ON g.doc_id = p.doc_id""",
)
def pitch_histogram_peak(gaps):
    return pages.histogram_peak(gaps, ["doc_id"]).withColumn("peak", F.round("peak", 6))


@query(
    "knn5",
    points="SELECT label AS doc_id, vec_id AS id, cast(vec_id * 37 % 101 AS double) AS x, cast(vec_id * 53 % 97 AS double) AS y FROM {embeddings}",
    oracle="""
SELECT doc_id, id, other, rank FROM (SELECT a.doc_id, a.id, b.id AS other, cast(row_number() OVER (PARTITION BY a.doc_id, a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS int) AS rank FROM points a JOIN points b ON a.doc_id = b.doc_id AND a.id <> b.id) WHERE rank <= 5""",
)
def knn5(points):
    return pages.nearest(points, ["doc_id"]).drop("d2")


@query(
    "doc_fallback_median",
    stats="""
SELECT o_custkey AS doc_id, o_orderkey AS page_no, 10.0 + o_orderkey % 7 AS line_pitch, 2.0 + o_orderkey % 5 AS word_gap, 9.0 + o_orderkey % 3 AS modal_size, o_orderstatus <> 'P' AS pitch_stable, o_orderkey % 3 <> 0 AS word_gap_stable FROM {orders}""".replace("10.0 +", "cast(10 AS double) +").replace("2.0 +", "cast(2 AS double) +").replace("9.0 +", "cast(9 AS double) +"),
    oracle="""
WITH m AS (SELECT doc_id, median(CASE WHEN pitch_stable THEN line_pitch END) AS p, median(CASE WHEN word_gap_stable THEN word_gap END) AS g FROM stats GROUP BY 1)
SELECT s.doc_id, page_no, CASE WHEN NOT pitch_stable AND p > 0 THEN p ELSE line_pitch END AS line_pitch, CASE WHEN NOT word_gap_stable AND g > 0 THEN g ELSE word_gap END AS word_gap,
  concat_ws('|', CASE WHEN (NOT pitch_stable AND p > 0) OR (NOT word_gap_stable AND g > 0) THEN 'INHERITED_FROM_DOCUMENT' END, CASE WHEN NOT pitch_stable THEN 'LOW_CONFIDENCE_LAYOUT' END) AS notes
FROM stats s JOIN m ON s.doc_id = m.doc_id""",
)
def doc_fallback_median(stats):
    filled = pages.apply_fallback(stats.withColumn("notes", F.array().cast("array<string>")))
    return filled.select("doc_id", "page_no", "line_pitch", "word_gap", F.array_join("notes", "|").alias("notes"))


_RULES = """
SELECT l_suppkey AS doc_id, l_linenumber AS page_no, cast(l_quantity * 12 AS double) AS pos, cast(l_partkey % 400 AS double) AS lo, cast(l_partkey % 400 + 20 + l_discount * 400 AS double) AS hi, 0.5 + l_tax AS thickness FROM {lineitem}"""


@query(
    "rule_merge_islands",
    segments=_RULES,
    oracle="""
WITH m AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, page_no, pos ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segments),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1.68 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, pos ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, page_no, pos, min(lo) AS lo, round(max(hi), 6) AS hi, round(cast(max(thickness) AS double), 6) AS thickness FROM i GROUP BY doc_id, page_no, pos, island""",
)
def rule_merge_islands(segments):
    merged = layout.merge_collinear(segments, ["doc_id", "page_no"], F.lit(0.12 * 14))
    return merged.select("doc_id", "page_no", "pos", "lo", F.round("hi", 6).alias("hi"), F.round(F.col("thickness").cast("double"), 6).alias("thickness"))


@query(
    "link_underline_anti",
    drawings="""
SELECT l_orderkey AS doc_id, 1 AS page_no, 're' AS kind, cast(l_partkey % 300 AS double) AS x0, cast(l_linenumber * 14 AS double) AS y0, cast(l_partkey % 300 + 40 AS double) AS x1, cast(l_linenumber * 14 + 1 AS double) AS y1, cast(0 AS double) AS stroke, cast(14 AS double) AS pitch FROM {lineitem}""",
    links="SELECT o_orderkey AS doc_id, 1 AS page_no, cast(0 AS double) AS x0, cast(0 AS double) AS y0, cast(o_custkey % 400 AS double) AS x1, cast((o_custkey % 7 + 1) * 14 AS double) AS y1 FROM {orders}",
    oracle="""
SELECT doc_id, count(*) AS n, sum(x0) AS sum_x0 FROM drawings d WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.doc_id = d.doc_id AND k.page_no = d.page_no AND abs((d.y0 + d.y1) / 2 - k.y1) <= 0.35 * 14 AND d.x0 >= k.x0 - 4.9 AND d.x1 <= k.x1 + 4.9) GROUP BY 1""",
)
def link_underline_anti(drawings, links):
    kept = layout.drop_link_underlines(layout.classify_rules(drawings), links)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x0").alias("sum_x0"))


_DOC_LINES = """
SELECT source, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, doc_id AS page_id, text FROM {documents}"""


@query(
    "furniture_lines",
    page_texts=_DOC_LINES,
    oracle="""
WITH l AS (SELECT source AS doc_id, page_no, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_idx FROM page_texts),
 s AS (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS signature, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_idx) AS u, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_idx DESC) AS d FROM l),
 n AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM l GROUP BY 1 HAVING count(DISTINCT page_no) >= 3),
 e AS (SELECT doc_id, page_no, signature, 'head' AS role FROM s WHERE u <= 3 AND signature <> '' UNION ALL SELECT doc_id, page_no, signature, 'foot' FROM s WHERE d <= 3 AND signature <> ''),
 c AS (SELECT e.doc_id, signature, role FROM e JOIN n ON e.doc_id = n.doc_id GROUP BY 1, 2, 3, pages HAVING count(DISTINCT page_no) >= 0.05 * pages)
SELECT s.doc_id, s.signature, count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.signature = s.signature AND ((role = 'head' AND u <= 3) OR (role = 'foot' AND d <= 3))) GROUP BY 1, 2""",
)
def furniture_lines(page_texts):
    """Lines that recur at page edges of a source, with one page in twenty as the least share."""
    from tabulith.config import DEFAULTS, Config

    config = Config(DEFAULTS | {"furniture": DEFAULTS["furniture"] | {"min_page_share": 0.05}})
    lines = page_texts.select(F.col("source").alias("doc_id"), "page_no", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    found = layout.furniture(lines, config).where("is_furniture")
    return found.groupBy("doc_id", "signature").agg(F.count("*").alias("n"))


#: Order lines set in three columns on a page for each order: names at 72, quantities and prices right-aligned.
TYPESET = """
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_idx, l_partkey, l_quantity, l_extendedprice FROM {lineitem}"""
TOKENS = f"""
SELECT doc_id, line_idx, 0 AS col, cast(72 AS double) AS x0, cast(72 + 5 * (4 + l_partkey % 12) AS double) AS x1, cast(5 AS double) AS unit FROM ({TYPESET}) AS a
UNION ALL SELECT doc_id, line_idx, 1 AS col, cast(300 - 5 * length(cast(cast(l_quantity AS int) AS varchar(20))) AS double) AS x0, cast(300 AS double) AS x1, cast(5 AS double) AS unit FROM ({TYPESET}) AS b
UNION ALL SELECT doc_id, line_idx, 2 AS col, cast(420 - 5 * length(cast(cast(floor(l_extendedprice) AS int) AS varchar(20))) AS double) AS x0, cast(420 AS double) AS x1, cast(5 AS double) AS unit FROM ({TYPESET}) AS c"""


@query(
    "gutter_columns",
    deal=BY_ORDER | {"tokens": ["doc_id"]},
    tokens=TOKENS,
    oracle="""
WITH ends AS (SELECT doc_id, min(x0) AS l, max(x1) AS r, count(DISTINCT line_idx) AS n, cast(ceil((max(x1) - min(x0)) / 1.25) AS int) AS bins FROM tokens GROUP BY 1),
 cov AS (SELECT DISTINCT t.doc_id, line_idx, l, r, n, unnest(range(cast(greatest(floor((x0 - 3 - l) / 1.25), 0) AS bigint), cast(least(floor((x1 + 3 - l) / 1.25), bins - 1) AS bigint) + 1)) AS bin FROM tokens t JOIN ends e ON t.doc_id = e.doc_id),
 fl AS (SELECT doc_id, l, r, bin FROM cov GROUP BY doc_id, l, r, n, bin HAVING count(*) > cast(0.19999999999999996 AS double) * n),
 runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(bin) OVER w IS NULL OR (bin - lag(bin) OVER w - 1) * 1.25 >= 11 THEN 1 ELSE 0 END AS new FROM fl WINDOW w AS (PARTITION BY doc_id ORDER BY bin))),
 sp AS (SELECT doc_id, run, l, r, min(bin) AS b0, max(bin) + 1 AS b1 FROM runs GROUP BY 1, 2, 3, 4)
SELECT doc_id, cast(row_number() OVER w - 1 AS int) AS col_idx, round(coalesce(l + (lag(b1) OVER w + b0) / 2.0 * 1.25, l), 6) AS x0, round(coalesce(l + (b1 + lead(b0) OVER w) / 2.0 * 1.25, r), 6) AS x1 FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY run)""",
)
def gutter_columns(tokens):
    cols = columns.columns_from_gutters(tokens, ["doc_id"])
    return cols.select("doc_id", "col_idx", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(
    "alignment_mad",
    tokens=TOKENS,
    oracle="""
WITH m AS (SELECT doc_id, col, count(*) AS n, median(x0) AS m0, median(x1) AS m1 FROM tokens GROUP BY 1, 2),
 s AS (SELECT t.doc_id, t.col, any_value(n) AS n, median(abs(x0 - m0)) AS s0, median(abs(x1 - m1)) AS s1 FROM tokens t JOIN m ON t.doc_id = m.doc_id AND t.col = m.col GROUP BY 1, 2)
SELECT doc_id, col, CASE WHEN n < 3 OR (s0 <= 2.5 AND s1 <= 2.5) THEN 'left' WHEN s1 * 1.8 < s0 THEN 'right' WHEN s0 * 1.8 < s1 THEN 'left' WHEN abs(s0 - s1) <= 2.5 THEN 'centre' ELSE 'mixed' END AS alignment FROM s""",
)
def alignment_mad(tokens):
    return columns.alignments(tokens, ["doc_id", "col"])


@query(
    "symbol_absorb",
    cols="""
SELECT o_orderkey AS doc_id, c AS col_idx, c * 100.0 AS x0, c * 100.0 + 100 AS x1, CASE WHEN (o_orderkey + c) % 3 = 0 THEN 6.0 ELSE 60.0 END AS content_width, 400.0 AS total_width, 10 AS n_filled, CASE WHEN (o_orderkey + c) % 3 = 0 THEN 9 ELSE 1 END AS n_symbols
FROM {orders} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS four""".replace("c * 100.0 + 100", "cast(c * 100 + 100 AS double)").replace("c * 100.0", "cast(c * 100 AS double)").replace("400.0", "cast(400 AS double)"),
    oracle="""
WITH f AS (SELECT *, n_symbols >= 8 AND content_width <= 18 AND col_idx < 3 AS sym FROM cols),
 g AS (SELECT *, coalesce(sum(CASE WHEN sym THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM f)
SELECT doc_id, cast(g AS int) AS col_idx, min(x0) AS x0, max(x1) AS x1, coalesce(string_agg(CASE WHEN sym THEN cast(g.col_idx AS varchar) END, ',' ORDER BY g.col_idx), '') AS absorbed FROM g GROUP BY doc_id, g""",
)
def symbol_absorb(cols):
    return columns.absorb_symbols(cols, ["doc_id"]).withColumn("absorbed", F.array_join("absorbed", ","))


@query(
    "rule_columns",
    deal=BY_ORDER,
    rules="SELECT l_orderkey AS doc_id, cast(l_partkey % 40 * 10 AS double) AS x, cast(0 AS double) AS y0, cast(50 + l_quantity AS double) AS y1 FROM {lineitem}",
    blocks="SELECT o_orderkey AS doc_id, cast(0 AS double) AS y0, cast(100 AS double) AS y1, cast(12 AS double) AS unit FROM {orders}",
    oracle="""
WITH x AS (SELECT DISTINCT doc_id, x FROM rules WHERE y1 >= 70 AND doc_id IN (SELECT doc_id FROM blocks)), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS x1 FROM x)
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY x) - 1 AS int) AS col_idx, x AS x0, x1 FROM n WHERE n >= 3 AND x1 - x > 12""",
)
def rule_columns(rules, blocks):
    return columns.columns_from_rules(rules, blocks, ["doc_id"])


_TRAP_CELLS = """
SELECT l_orderkey AS doc_id, line_idx - 1 AS row_idx, c AS col_idx, CASE WHEN c = 0 THEN CASE WHEN l_orderkey % 5 = 4 THEN concat('Key', cast(line_idx AS varchar(9)), ':') ELSE concat('Chapter ', cast(line_idx AS varchar(9))) END
  WHEN l_orderkey % 5 = 0 THEN cast(line_idx * 3 AS varchar(9)) WHEN l_orderkey % 5 = 1 THEN concat(cast(line_idx AS varchar(9)), ', ', cast(line_idx + 7 AS varchar(9))) WHEN l_orderkey % 5 = 2 THEN 'a long line of words that runs on and on without any figure'
  WHEN l_orderkey % 5 = 3 THEN concat('1,', lpad(cast(line_idx AS varchar(9)), 3, '0')) ELSE 'value' END AS text
FROM (SELECT doc_id AS l_orderkey, cast(line_idx AS int) AS line_idx FROM (""" + TYPESET + """) AS t) AS r CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) AS two"""


@query(
    "trap_classify",
    deal=BY_ORDER,
    cells=_TRAP_CELLS,
    oracle="""
WITH t AS (SELECT doc_id, max(row_idx) + 1 AS n_rows FROM cells GROUP BY 1)
SELECT rejected_as, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'TRAP_TOC' WHEN 1 THEN 'TRAP_INDEX' WHEN 2 THEN CASE WHEN n_rows < 2 THEN 'TRAP_TOO_FEW_ROWS' END WHEN 3 THEN CASE WHEN n_rows < 2 THEN 'TRAP_TOO_FEW_ROWS' END ELSE CASE WHEN n_rows <= 3 THEN 'TRAP_KEYVALUE' END END AS rejected_as FROM t) GROUP BY 1""",
)
def trap_classify(cells):
    tables = cells.groupBy("doc_id").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))
    return columns.classify_traps(cells, tables, ["doc_id"]).groupBy("rejected_as").agg(F.count("*").alias("n"))


@query(
    "fragment_semi",
    tables="""
SELECT o_custkey AS doc_id, o_orderkey AS table_idx, cast(o_orderkey % 5 + 1 AS int) AS n_rows, cast(o_orderkey % 3 * 10 AS double) AS x0, cast(o_orderkey % 50 * 10 AS double) AS y0, cast(300 + o_orderkey % 4 * 9 AS double) AS x1,
  cast(o_orderkey % 50 * 10 + 8 AS double) AS y1, cast(5 AS double) AS unit, CASE WHEN o_orderkey % 4 = 1 THEN 'TRAP_TOC' WHEN o_orderkey % 4 = 2 THEN 'TRAP_EMPTY' END AS rejected_as FROM {orders}""",
    oracle="""
SELECT doc_id, table_idx FROM tables a WHERE rejected_as IS NULL AND n_rows <= 3 AND EXISTS (SELECT 1 FROM tables b WHERE b.rejected_as = 'TRAP_TOC' AND b.doc_id = a.doc_id AND greatest(a.y0 - b.y1, b.y0 - a.y1, 0) <= 25 AND abs(a.x0 - b.x0) <= 20 AND abs(a.x1 - b.x1) <= 20)""",
)
def fragment_semi(tables):
    return columns.fragments(tables, ["doc_id"])


@query(
    "box_overlaps",
    boxes="SELECT s_suppkey AS id, s_nationkey AS doc_id, cast(s_suppkey % 17 * 10 AS double) AS x0, cast(s_suppkey % 13 * 10 AS double) AS y0, cast(s_suppkey % 17 * 10 + 25 AS double) AS x1, cast(s_suppkey % 13 * 10 + 15 AS double) AS y1 FROM {supplier}",
    oracle="""
SELECT a.id, b.id AS other, round(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 15, 6) AS v_overlap, round(i / (750 - i), 6) AS iou
FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.id < b.id, LATERAL (SELECT greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i) WHERE i > 0""",
)
def box_overlaps(boxes):
    b = boxes.select("doc_id", F.col("id").alias("other"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    j = boxes.join(b, "doc_id").where("id < other")
    c = F.col
    both = iou(*[c(x) for x in ("x0", "y0", "x1", "y1")], *[c(f"b{x}") for x in ("x0", "y0", "x1", "y1")])
    return j.withColumn("iou", F.round(both, 6)).where("iou > 0").select("id", "other", F.round(overlap_ratio(c("y0"), c("y1"), c("by0"), c("by1")), 6).alias("v_overlap"), "iou")


@query(
    "wrap_closed_cells",
    cells="""
SELECT p_partkey, p_size % 8 AS form, CASE p_size % 8 WHEN 0 THEN '1,234.50' WHEN 1 THEN 'Aug 29,' WHEN 2 THEN 'Nil' WHEN 3 THEN '#REF!' WHEN 4 THEN '10.18*' WHEN 5 THEN '(12)' WHEN 6 THEN '' ELSE 'words of text' END AS text FROM {part}""",
    oracle="SELECT p_partkey, form IN (0, 2, 3, 4, 5) AS closed, form IN (1, 6, 7) AS open FROM cells",
)
def wrap_closed_cells(cells):
    return cells.select("p_partkey", is_closed(F.col("text")).alias("closed"), is_open(F.col("text")).alias("open"))
