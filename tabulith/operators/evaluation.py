"""Comparing tables found with labelled ones, and ranking tables that look wrong."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.text import collapse, norm
from tabulith.functions.values import NUMERIC


def _dealt(df: DataFrame, keys: list[str], n_parts: int | None) -> DataFrame:
    return df if n_parts is None else df.repartition(n_parts, *keys)


def content_overlap(found: DataFrame, wanted: DataFrame, keys: list[str], n_parts: int | None = None) -> DataFrame:
    """Jaccard of the two bags of cell strings: (keys, overlap). Both bags are dealt out together, to ``n_parts`` if given."""
    bag = lambda d, n: d.select(*keys, norm(F.col("text")).alias("t"), *[F.lit(int(k == n)).alias(k) for k in "ab"]).where("t != ''")
    both = _dealt(bag(found, "a").unionByName(bag(wanted, "b")), keys, n_parts)
    counts = both.groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.groupBy(*keys).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("overlap"))


def to_number(text: Column) -> Column:
    """Plain figures with separators and parentheses for negatives; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(t, r"[^0-9.\-]", "")
    v = F.when(bare.rlike("[0-9]"), bare.try_cast("double"))
    return F.when(t.startswith("(") & t.endswith(")"), -v).otherwise(v)


def numeric_overlap(found: DataFrame, wanted: DataFrame, keys: list[str], slack: float = 0.005, n_parts: int | None = None) -> DataFrame:
    """Share of a label's different figures that some value found comes close to.

    Figures and values stand in one order; the nearest value on either side tells. Nothing is joined or
    written out more than once. Groups with a null key meet no value.
    """
    w = wanted.select(*keys, to_number(F.col("text")).alias("v"), F.lit(True).alias("is_wanted"))
    both = w.unionByName(found.select(*keys, F.col("value").cast("double").alias("v"), F.lit(False).alias("is_wanted"))).where("v is not null")
    both = _dealt(both, keys, n_parts).distinct()
    value = F.when(~F.col("is_wanted"), F.col("v"))
    up, down = Window.partitionBy(*keys).orderBy("v", "is_wanted"), Window.partitionBy(*keys).orderBy(F.desc("v"), "is_wanted")
    near = lambda by: F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    sides = both.withColumn("below", near(up)).withColumn("above", near(down)).where("is_wanted")
    hit = (F.abs(F.col("v") - F.col("below")) < slack) | (F.abs(F.col("v") - F.col("above")) < slack)
    for k in keys:
        hit = hit & F.col(k).isNotNull()
    return sides.groupBy(*keys).agg((F.count(F.when(hit, 1)) / F.count("*")).alias("overlap"))


def structure_similarity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean likeness of the occupancy strings (a, b) of aligned rows, by difflib."""
    import difflib

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    return rows.withColumn("r", ratio("a", "b")).groupBy(*keys).agg(F.avg("r").alias("similarity"))


def align_rows(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables aligned on their labels (row_idx, label): (keys, found_row, wanted_row)."""
    import difflib

    both = found.select(*keys, F.lit(0).alias("side"), "row_idx", norm(F.col("label")).alias("label")).unionByName(wanted.select(*keys, F.lit(1).alias("side"), "row_idx", norm(F.col("label")).alias("label")))

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == s].sort_values("row_idx") for s in (0, 1))
        out = []
        for op, i0, i1, j0, j1 in difflib.SequenceMatcher(None, list(a.label), list(b.label), autojunk=False).get_opcodes():
            if op in ("equal", "replace"):
                out += [(a.row_idx.iloc[i], b.row_idx.iloc[j]) for i, j in zip(range(i0, i1), range(j0, j1))]
        d = pd.DataFrame(out, columns=["found_row", "wanted_row"]).astype("int64")
        for k in keys:
            d[k] = pdf[k].iloc[0]
        return d[[*keys, "found_row", "wanted_row"]]

    types = dict(found.dtypes)
    return both.groupBy(*keys).applyInPandas(align, ", ".join(f"{k} {types[k]}" for k in keys) + ", found_row long, wanted_row long")


def align_rows_by_figures(found: DataFrame, wanted: DataFrame, keys: list[str], least: float = 0.55) -> DataFrame:
    """Rows (row_idx, label, figures array) matched first by a majority of figures, then by label."""
    import difflib

    cols = lambda d, s: d.select(*keys, F.lit(s).alias("side"), "row_idx", norm(F.col("label")).alias("label"), "figures")

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (list(pdf[pdf.side == s].sort_values("row_idx").itertuples()) for s in (0, 1))
        used, out = set(), []
        for w in b:
            best, best_n = None, 0
            for f in a:
                n = sum(any(abs(x - y) < 0.005 for y in f.figures) for x in w.figures)
                if f.row_idx not in used and n > best_n:
                    best, best_n = f, n
            if best is None or 2 * best_n <= len(w.figures):
                best = max((f for f in a if f.row_idx not in used), key=lambda f: (difflib.SequenceMatcher(None, f.label, w.label).ratio(), -f.row_idx), default=None)
                if best is None or difflib.SequenceMatcher(None, best.label, w.label).ratio() < least:
                    continue
            used.add(best.row_idx)
            out.append((best.row_idx, w.row_idx))
        d = pd.DataFrame(out, columns=["found_row", "wanted_row"]).astype("int64")
        for k in keys:
            d[k] = pdf[k].iloc[0]
        return d[[*keys, "found_row", "wanted_row"]]

    types = dict(found.dtypes)
    return cols(found, 0).unionByName(cols(wanted, 1)).groupBy(*keys).applyInPandas(align, ", ".join(f"{k} {types[k]}" for k in keys) + ", found_row long, wanted_row long")


def evaluate(found: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """Labelled tables against the best table of their page.

    ``found`` has doc_id, page_no, table_idx, row_idx, col_idx, text; ``wanted`` label_id, doc_id,
    page_no, row_idx, col_idx, text. Rows (label_id, table_idx, overlap, n_cells, n_found, n_exact,
    same_shape), with no table where none overlaps enough: cells that were never found count in
    ``n_cells``, and ``n_found`` says how many of them have a cell to compare with.
    """
    labels = wanted.select("label_id", "doc_id", "page_no").distinct()
    pairs = ["label_id", "table_idx"]
    near = found.join(labels, ["doc_id", "page_no"])
    tables = near.select(*pairs).distinct()
    overlaps = content_overlap(near, wanted.join(tables, "label_id"), pairs)
    best = overlaps.where(F.col("overlap") >= least).groupBy("label_id").agg(F.max_by(F.struct("table_idx", "overlap"), F.struct("overlap", -F.col("table_idx"))).alias("b")).select("label_id", "b.*")
    have, want = near.join(best.select(*pairs), pairs), wanted.join(best.select(*pairs), "label_id")
    label = lambda d: d.where("col_idx = 0").select(*pairs, "row_idx", F.col("text").alias("label"))
    rows = align_rows(label(have), label(want), pairs)
    h = have.select(*pairs, F.col("row_idx").alias("found_row"), "col_idx", norm(F.col("text")).alias("h"))
    w = want.select(*pairs, F.col("row_idx").alias("wanted_row"), "col_idx", norm(F.col("text")).alias("w"))
    compared = w.join(rows, [*pairs, "wanted_row"], "left").join(h, [*pairs, "found_row", "col_idx"], "left")
    counts = compared.groupBy("label_id").agg(F.count("*").alias("n_cells"), F.count("h").alias("n_found"), F.sum(F.coalesce(F.col("h") == F.col("w"), F.lit(False)).cast("long")).alias("n_exact"))
    shape = lambda d, p: d.groupBy("label_id").agg(F.max("row_idx").alias(f"{p}r"), F.max("col_idx").alias(f"{p}c"))
    shapes = shape(have, "h").join(shape(want, "w"), "label_id").select("label_id", F.expr("hr = wr and hc = wc").alias("same_shape"))
    return labels.select("label_id").distinct().join(best, "label_id", "left").join(counts, "label_id", "left").join(shapes, "label_id", "left").select("label_id", "table_idx", "overlap", "n_cells", "n_found", "n_exact", "same_shape")


BINS = [0.0, 0.2, 0.4, 0.6, 0.8, 0.9]


def flag_metrics(cells: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Precision and recall of flags, and silent errors, over cells (confidence, correct)."""
    flagged, wrong = F.col("confidence") < threshold, ~F.col("correct")
    n = lambda c: F.sum(c.cast("long"))
    return cells.agg(
        F.count("*").alias("n"), n(F.col("correct")).alias("n_correct"), n(flagged).alias("n_flagged"), n(wrong).alias("n_wrong"), n(flagged & wrong).alias("n_caught"), n(~flagged & wrong).alias("n_silent")
    ).withColumns({"precision": F.expr("try_divide(n_caught, n_flagged)"), "recall": F.expr("try_divide(n_caught, n_wrong)")})


def reliability(cells: DataFrame) -> DataFrame:
    """Mean confidence and accuracy by bin of confidence."""
    low = None
    for b in reversed(BINS):
        low = F.when(F.col("confidence") >= b, b) if low is None else low.when(F.col("confidence") >= b, b)
    return cells.withColumn("low", low).groupBy("low").agg(F.count("*").alias("n"), F.avg(F.col("confidence").cast("decimal(18,12)")).cast("double").alias("mean_confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def suspicion(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of six ratios of a table: sparse columns, prose, no numbers, unsteady edges, repeated labels, ragged rows.

    Cells (row_idx, col_idx, text, value_type), tables (n_rows, n_cols, n_mixed).
    """
    t = tables.select(*keys, F.greatest("n_rows", F.lit(1)).alias("nr"), F.greatest("n_cols", F.lit(1)).alias("nc"), "n_mixed")
    filled = cells.select(*keys, "row_idx", "col_idx", "value_type", collapse(F.col("text")).alias("t")).where("t != ''")
    per_col = filled.groupBy(*keys, "col_idx").agg(F.count("*").alias("n")).join(t, keys).groupBy(*keys).agg(F.sum((F.col("n") * 3 >= F.col("nr")).cast("int")).alias("dense"))
    pattern = filled.select(*keys, "row_idx", "col_idx").distinct().groupBy(*keys, "row_idx").agg(F.array_join(F.array_sort(F.collect_list("col_idx")), ",").alias("p"))
    ragged = pattern.groupBy(*keys, "p").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum((F.col("n") == 1).cast("int")).alias("lone"), F.sum("n").alias("rows"))
    base = filled.groupBy(*keys).agg(
        F.avg(F.size(F.split("t", " "))).alias("words"), F.avg(F.col("value_type").isin(NUMERIC).cast("int")).alias("numeric"),
        F.count(F.when(F.col("col_idx") == 0, 1)).alias("labels"), F.countDistinct(F.when(F.col("col_idx") == 0, F.col("t"))).alias("different"),
    )
    j = t.join(base, keys, "left").join(per_col, keys, "left").join(ragged, keys, "left")
    parts = {
        "sparse_cols": 1.0 - F.coalesce("dense", F.lit(0)) / F.col("nc"), "prose": F.least(F.lit(1.0), F.col("words") / 8.0), "no_numbers": 1.0 - F.col("numeric"),
        "unstable_align": F.col("n_mixed") / F.col("nc"), "label_repeat": (F.col("labels") - F.col("different")) / F.greatest("labels", F.lit(1)), "ragged": F.col("lone") / F.greatest("rows", F.lit(1)),
    }
    empty = F.col("words").isNull()
    mean = sum(parts.values(), F.lit(0.0)) / 6
    return j.select(*keys, F.when(empty, 1.0).otherwise(mean).alias("suspicion"), *[F.when(~empty, v).alias(k) for k, v in parts.items()])


def label_audit(cells: DataFrame, page_text: DataFrame, keys: list[str]) -> DataFrame:
    """Where a label's cells stand in its page's text: exact, without hyphens, or missing."""
    squash = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    j = cells.join(page_text.select(*keys, squash(F.col("page_text")).alias("p")), keys).withColumn("t", squash(F.col("text"))).where("t != ''")
    soft = lambda c: F.regexp_replace(c, "[-‐‑–—]", "")
    found = F.when(F.contains("p", F.col("t")), "exact").when(F.contains(soft(F.col("p")), soft(F.col("t"))), "hyphen").otherwise("missing")
    return j.select(*cells.columns, found.alias("found"))


def top(ranked: DataFrame, by: str, keys: list[str], n: int) -> DataFrame:
    return ranked.orderBy(F.desc(by), *keys).limit(n)


