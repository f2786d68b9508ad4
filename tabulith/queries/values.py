"""Values: strings are printed from known numbers and dates, and have to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions.values import column_types, parse_values
from tabulith.queries.base import query
from tabulith.queries.pages import BY_ORDER


def grouped(x: str) -> str:
    """SQL for a number with two decimals and commas between thousands, alike in both engines."""
    cents = f"cast(round({x} * 100) as bigint)"
    digits = f"cast(({cents} - {cents} % 100) / 100 as bigint)"
    three = lambda d: f"lpad(cast({d} as varchar(20)), 3, '0')"
    big = f"cast(({digits} - {digits} % 1000) / 1000 as bigint)"
    whole = f"case when {digits} >= 1000 then concat(cast({big} as varchar(20)), ',', {three(f'{digits} % 1000')}) else cast({digits} as varchar(20)) end"
    return f"concat({whole}, '.', lpad(cast({cents} % 100 as varchar(20)), 2, '0'))"


PRINTED = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, l_partkey % 8 AS form, l_returnflag, {grouped("l_extendedprice")} AS s
FROM {{lineitem}}"""

CELLS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, x, form, l_returnflag,
  CASE form WHEN 0 THEN s WHEN 1 THEN concat('(', s, ')') WHEN 2 THEN concat('$ ', s) WHEN 3 THEN concat(s, '-') WHEN 4 THEN concat('-', s)
    WHEN 5 THEN concat('Rs. ', s) WHEN 6 THEN concat(s, ' Cr') ELSE concat('$ (', s, ')') END AS raw_text
FROM ({PRINTED}) AS printed"""


@query(
    "value_parse",
    cells=CELLS,
    oracle="""
SELECT l_orderkey, l_linenumber, raw_text,
  CASE WHEN form IN (2, 5, 7) THEN 'currency' ELSE 'decimal' END AS value_type,
  round(x * (CASE WHEN form IN (1, 3, 4, 7) THEN -1 ELSE 1 END) * (CASE WHEN form = 6 THEN 1e7 ELSE 1 END), 2) AS value,
  CASE WHEN form IN (2, 7) THEN 'USD' WHEN form = 5 THEN 'INR' END AS unit, CASE WHEN form = 6 THEN 'crore' END AS scale,
  concat(CASE WHEN x >= 1000 THEN 'western-grouping' ELSE 'plain' END, CASE WHEN form IN (1, 7) THEN '/paren' WHEN form = 3 THEN '/trailing-sign' WHEN form = 4 THEN '/leading-sign' ELSE '/unsigned' END) AS rule
FROM cells""",
)
def value_parse(cells):
    p = parse_values(cells)
    return p.select("l_orderkey", "l_linenumber", "raw_text", "parsed.value_type", F.round("parsed.normalized_value", 2).alias("value"), "parsed.unit", "parsed.scale", "parsed.rule")


@query(
    "value_scales",
    cells="""
SELECT p_partkey, p_size, p_partkey % 6 AS form, concat(cast(p_size as varchar(10)), CASE p_partkey % 6 WHEN 0 THEN 'k' WHEN 1 THEN ' mn' WHEN 2 THEN ' lakh' WHEN 3 THEN 'bn' WHEN 4 THEN ' crores' ELSE '%' END) AS raw_text
FROM {part}""",
    oracle="""
SELECT p_partkey, CASE WHEN form = 5 THEN 'percent' ELSE 'integer' END AS value_type,
  cast(p_size AS double) * CASE form WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e5 WHEN 3 THEN 1e9 WHEN 4 THEN 1e7 ELSE 1 END AS value,
  CASE form WHEN 0 THEN 'thousand' WHEN 1 THEN 'million' WHEN 2 THEN 'lakh' WHEN 3 THEN 'billion' WHEN 4 THEN 'crore' END AS scale FROM cells""",
)
def value_scales(cells):
    return parse_values(cells).select("p_partkey", "parsed.value_type", F.col("parsed.normalized_value").alias("value"), "parsed.scale")


@query(
    "value_grouping",
    cells="""
SELECT o_orderkey, o_orderkey % 7 AS form, CASE o_orderkey % 7 WHEN 0 THEN '1,23,45,678' WHEN 1 THEN '12,345,678' WHEN 2 THEN '1,23,45,6789' WHEN 3 THEN '1,234.56.78' WHEN 4 THEN '.5' WHEN 5 THEN '5.' ELSE '–5' END AS raw_text FROM {orders}""",
    oracle="""
SELECT o_orderkey, CASE form WHEN 0 THEN 'integer' WHEN 1 THEN 'integer' WHEN 5 THEN 'decimal' ELSE 'text' END AS value_type,
  cast(CASE form WHEN 0 THEN 12345678 WHEN 1 THEN 12345678 WHEN 5 THEN 5 END AS double) AS value,
  CASE form WHEN 0 THEN 'indian-grouping/unsigned' WHEN 1 THEN 'western-grouping/unsigned' WHEN 5 THEN 'plain/unsigned' ELSE 'text' END AS rule,
  CASE WHEN form IN (2, 3) THEN 'PARSE_AMBIGUOUS' ELSE '' END AS notes FROM cells""",
)
def value_grouping(cells):
    return parse_values(cells).select("o_orderkey", "parsed.value_type", F.col("parsed.normalized_value").alias("value"), "parsed.rule", F.array_join("parsed.notes", "|").alias("notes"))


@query(
    "null_kinds",
    cells="""
SELECT p_partkey, p_size % 7 AS form, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'Nil.' WHEN 3 THEN 'N.A.' WHEN 4 THEN '#REF!' WHEN 5 THEN '0' ELSE '#N/A' END AS raw_text FROM {part}""",
    oracle="""
SELECT value_type, normalized_text, count(*) AS n FROM (
  SELECT CASE form WHEN 0 THEN 'empty' WHEN 1 THEN 'dash' WHEN 2 THEN 'nil' WHEN 3 THEN 'na' WHEN 5 THEN 'integer' ELSE 'error' END AS value_type,
    CASE form WHEN 4 THEN '#REF!' WHEN 6 THEN '#N/A' END AS normalized_text FROM cells) GROUP BY 1, 2""",
)
def null_kinds(cells):
    return parse_values(cells).groupBy("parsed.value_type", "parsed.normalized_text").agg(F.count("*").alias("n"))


_DATES = """
SELECT o_orderkey, o_orderkey % 6 AS form, cast(extract(year FROM o_orderdate) AS int) AS y, cast(extract(month FROM o_orderdate) AS int) AS m, cast(extract(day FROM o_orderdate) AS int) AS d FROM {orders}"""
_MONTH = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', m * 3 - 2, 3)"
_TWO = "lpad(cast({} AS varchar(4)), 2, '0')"


@query(
    "date_parse",
    cells=f"""
SELECT o_orderkey, form, y, m, d, CASE form WHEN 0 THEN concat(cast(y AS varchar(4)), '-', {_TWO.format('m')}, '-', {_TWO.format('d')}) WHEN 1 THEN concat({_TWO.format('d')}, '/', {_TWO.format('m')}, '/', cast(y AS varchar(4)))
  WHEN 2 THEN concat(cast(m AS varchar(4)), '/', cast(d AS varchar(4)), '/', cast(y AS varchar(4))) WHEN 3 THEN concat(cast(d AS varchar(4)), '.', cast(m AS varchar(4)), '.', cast(y AS varchar(4)))
  WHEN 4 THEN concat(cast(d AS varchar(4)), '-', {_MONTH}, '-', cast(y AS varchar(4))) ELSE concat({_MONTH}, ' ', cast(d AS varchar(4)), ', ', cast(y AS varchar(4))) END AS raw_text
FROM ({_DATES}) AS dates""",
    oracle="""
SELECT o_orderkey, concat(cast(y AS varchar), '-', lpad(cast(mm AS varchar), 2, '0'), '-', lpad(cast(dd AS varchar), 2, '0')) AS normalized_text,
  CASE form WHEN 0 THEN 'date:iso' WHEN 1 THEN 'date:slash' WHEN 2 THEN 'date:slash' WHEN 3 THEN 'date:dot' WHEN 4 THEN 'date:d-mon-y' ELSE 'date:mon-d-y' END AS rule,
  form IN (1, 2, 3) AND d <= 12 AS ambiguous
FROM (SELECT *, CASE WHEN form = 2 AND d <= 12 THEN d ELSE m END AS mm, CASE WHEN form = 2 AND d <= 12 THEN m ELSE d END AS dd FROM cells)""",
)
def date_parse(cells):
    return parse_values(cells).select("o_orderkey", "parsed.normalized_text", "parsed.rule", F.array_contains("parsed.notes", "DATE_ORDER_AMBIGUOUS").alias("ambiguous"))


@query(
    "fiscal_quarter",
    cells=f"""
SELECT o_orderkey, y, m, CASE WHEN form < 3 THEN concat('Q', cast(cast((m - 1 - (m - 1) % 3) / 3 AS int) + 1 AS varchar(2)), ' fy', cast(y AS varchar(4))) ELSE concat('FY ', cast(y AS varchar(4)), '-', {_TWO.format('(y + 1) % 100')}) END AS raw_text, form
FROM ({_DATES}) AS dates""",
    oracle="""
SELECT normalized_text, rule, count(*) AS n FROM (SELECT upper(raw_text) AS normalized_text, CASE WHEN form < 3 THEN 'date:quarter' ELSE 'date:fiscal' END AS rule FROM cells) GROUP BY 1, 2""",
)
def fiscal_quarter(cells):
    return parse_values(cells).groupBy("parsed.normalized_text", "parsed.rule").agg(F.count("*").alias("n"))


@query(
    "column_type_vote",
    deal=BY_ORDER,
    cells=CELLS.replace("THEN s WHEN 1", "THEN 'see note' WHEN 1").replace("ELSE concat('$ (', s, ')')", "ELSE '-'"),
    oracle="""
WITH votes AS (SELECT l_orderkey, CASE WHEN form IN (2, 5) THEN 'currency' WHEN form = 0 THEN 'text' ELSE 'decimal' END AS kind, CASE WHEN form = 2 THEN 'USD' WHEN form = 5 THEN 'INR' END AS unit, form FROM cells),
 n AS (SELECT l_orderkey, sum(CASE WHEN form <> 7 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN form NOT IN (0, 7) THEN 1 ELSE 0 END) AS num, sum(CASE WHEN form IN (2, 5) THEN 1 ELSE 0 END) AS cur,
   sum(CASE WHEN form NOT IN (0, 2, 5, 7) THEN 1 ELSE 0 END) AS dec, sum(CASE WHEN form = 0 THEN 1 ELSE 0 END) AS txt, sum(CASE WHEN form = 2 THEN 1 ELSE 0 END) AS usd, sum(CASE WHEN form = 5 THEN 1 ELSE 0 END) AS inr FROM votes GROUP BY 1)
SELECT l_orderkey, CASE WHEN n = 0 THEN 'empty' WHEN num > 0 AND num >= 0.7 * n THEN CASE WHEN dec >= cur THEN 'decimal' ELSE 'currency' END
   WHEN greatest(cur, dec, txt) < 0.7 * n THEN 'text' WHEN txt >= greatest(cur, dec) THEN 'text' WHEN dec >= cur THEN 'decimal' ELSE 'currency' END AS inferred_type,
  CASE WHEN num > 0 AND num >= 0.7 * n AND usd + inr > 0 THEN CASE WHEN inr >= usd THEN 'INR' ELSE 'USD' END END AS unit,
  round(CASE WHEN n = 0 THEN 1.0 WHEN num > 0 AND num >= 0.7 * n THEN cast(num AS double) / n ELSE cast(greatest(cur, dec, txt) AS double) / n END, 6) AS agreement
FROM n""",
)
def column_type_vote(cells):
    return column_types(parse_values(cells), ["l_orderkey"]).withColumn("agreement", F.round("agreement", 6))
