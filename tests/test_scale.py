"""What a step shuffles and holds has to grow with its rows: plans and results of steps that used to grow faster."""

import numpy as np
import pytest

from tabulith.operators import columns, evaluation, pages, scoring
from tabulith.catalogue import QUERIES
from tabulith.queries import base

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_not_written_out_by_bins(spark):
    """one row a token, not one for each bin that it covers; also where tokens of a line overlap."""
    rows = [(d, n, float(x), float(x + w), 5.0) for d in (1, 2) for n in range(5) for x, w in ((72, 60), (100, 20 + n), (300 - 8 * n, 8 * n), (400, 12))]
    tokens = spark.createDataFrame([*rows, (None, 1, 0.0, 9.0, 5.0)], "doc_id long, line_idx int, x0 double, x1 double, unit double")
    found = columns.columns_from_gutters(tokens, ["doc_id"])
    assert "sequence(" not in plan(found)
    left, w, lines = 72.0, 1.25, [[(x0, x1) for d, n, x0, x1, _ in rows if d == 1 and n == k] for k in range(5)]
    cover = np.zeros(int(np.ceil((412 - left) / w)), int)
    for line in lines:
        hit = np.zeros(len(cover), bool)
        for x0, x1 in line:
            hit[max(0, int((x0 - 3 - left) // w)) : int((x1 + 3 - left) // w) + 1] = True
        cover += hit
    full = np.flatnonzero(cover > (1.0 - 0.8) * len(lines))
    cut = np.flatnonzero((np.diff(full) - 1) * w >= 11)
    edges = [left, *[left + (full[k] + 1 + full[k + 1]) / 2 * w for k in cut], 412.0]
    want = [(d, k, a, b) for d in (1, 2) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert [tuple(r) for r in found.orderBy("doc_id", "col_idx").collect()] == want and len(edges) > 2


def test_grid_cells_are_not_written_out(spark):
    """a column of the grid is some words of bits; overlaps count once, a page's only box counts as it is."""
    boxes = [(1, 0, 0, 100, 64), (1, 50, 32, 128, 128), (1, 50, 32, 128, 128), (2, 3, 60, 5, 70)]
    images = spark.createDataFrame([(d, 1, *map(float, b)) for d, *b in boxes], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    sheets = spark.createDataFrame([(d, 1, 128.0, 128.0) for d in (1, 2, 3)], "doc_id long, page_no int, width double, height double")
    found = pages.image_coverage(images, sheets)
    assert plan(found).count("explode(sequence") == 0
    grid = np.zeros((4, 128, 128), bool)
    for d, x0, y0, x1, y1 in boxes:
        grid[d, x0:x1, y0:y1] = True
    assert {r.doc_id: r.image_coverage for r in found.collect()} == {d: grid[d].mean() for d in (1, 2, 3)}


def test_tables_are_dealt_by_their_bytes(spark, monkeypatch):
    """Parts grow with the tables, whatever number of partitions the session has."""
    few = base.parts(spark, SF, ["lineitem"])
    monkeypatch.setattr(base, "PART_BYTES", 10_000)
    many = base.parts(spark, SF, ["lineitem"])
    assert few == spark.sparkContext.defaultParallelism and many > few
    assert f", {many}), REPARTITION_BY_NUM" in plan(QUERIES["gutter_columns"](spark, SF))


def test_figures_are_not_written_out_by_buckets(spark):
    """figures and values stand in one order; equal ones, ones on either side and ones just out of reach."""
    found = spark.createDataFrame([(1, 5.0), (1, 7.004), (1, 8.996), (1, 3.0), (2, None), (None, 1.0)], "doc_id long, value double")
    wanted = spark.createDataFrame([(1, t) for t in ("5", "7", "9.00", "3.006", "(5)", "5.000", "no figure")] + [(2, "1"), (None, "1")], "doc_id long, text string")
    got = evaluation.numeric_overlap(found, wanted, ["doc_id"])
    assert "explode(" not in plan(got) and "Join" not in plan(got)
    assert {r.doc_id: r.overlap for r in got.collect()} == {1: 3 / 5, 2: 0.0, None: 0.0}


def test_bags_are_counted_together(spark):
    """both bags in one pass, with no join of their strings."""
    found = spark.createDataFrame([(1, "a  B"), (1, "a b"), (1, "c"), (2, " ")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, "A b"), (1, "d"), (3, "x")], "doc_id long, text string")
    got = evaluation.content_overlap(found, wanted, ["doc_id"])
    assert "Join" not in plan(got)
    assert {r.doc_id: r.overlap for r in got.collect()} == {1: 0.25, 3: 0.0}


def test_cells_meet_groups_once(spark):
    """members and total of a group come from one join; a group of one member is none."""
    rows = [(1, 1, 2.0, "decimal"), (1, 2, 3.0, "decimal"), (1, 3, 5.0, "decimal"), (1, 4, 5.0, "decimal"), (2, 1, 2.0, "decimal"), (2, 2, None, "error"), (2, 3, 9.0, "decimal")]
    cells = spark.createDataFrame([(d, r, 1, k, v, "decimal") for d, r, v, k in rows], "doc_id long, row_idx int, col_idx int, value_type string, value double, column_type string")
    groups = spark.createDataFrame([(1, 0, 0, 1, 3), (1, 0, 0, 2, 3), (1, 0, 1, 3, 4), (2, 0, 0, 1, 3), (2, 0, 0, 2, 3)], "doc_id long, section_idx int, group_idx int, member_row int, subtotal_row int")
    found = scoring.crossfoot(cells, groups, ["doc_id"])
    assert sum("Join" in x for x in plan(found).split("\n")) == 1
    assert {(r.doc_id, r.subtotal_row, r.n_parts, r.status) for r in found.collect()} == {(1, 3, 2, "pass"), (2, 3, 1, "unverifiable")}
    signs = scoring.crossfoot_signals(found, groups, ["doc_id"])
    assert {(r.doc_id, r.row_idx, r.crossfoot) for r in signs.collect()} == {(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0)}


@pytest.mark.parametrize("name", "rule_columns trap_classify triage_suspicion stitch_absorb confidence calibrated review_queue issue_counts column_type_vote".split())
def test_lines_are_dealt(spark, monkeypatch, name):
    """F6-F8, F13, F14, F16-F19: parts by the bytes of the tables, not by the session's number."""
    monkeypatch.setattr(base, "PART_BYTES", 10_000)
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))
