"""Labels against tables found, and ruling lines."""

from tabulith.operators import evaluation, layout


def cells(spark, grid, **keys):
    rows = [(*keys.values(), r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)]
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in keys.items())
    return spark.createDataFrame(rows, f"{kinds}, row_idx int, col_idx int, text string")


def test_evaluate(spark):
    grid = [["", "2024"], ["Cash", "100"], ["Debt", "50"]]
    found = cells(spark, [["", "2024"], ["Cash", "100"], ["Extra", "1"], ["Debt", "51"]], doc_id="d", page_no=1, table_idx=0).union(cells(spark, [["x", "y"]], doc_id="d", page_no=1, table_idx=1))
    wanted = cells(spark, grid, label_id="a", doc_id="d", page_no=1).union(cells(spark, [["q", "z"]], label_id="b", doc_id="d", page_no=1))
    got = {r.label_id: r for r in evaluation.evaluate(found, wanted).collect()}
    assert (got["a"].table_idx, got["a"].n_cells, got["a"].n_found, got["a"].n_exact, got["a"].same_shape) == (0, 6, 6, 5, False)
    assert got["b"].table_idx is None


def test_row_alignment_and_structure(spark):
    a = spark.createDataFrame([("t", 0, "Cash at bank", [100.0]), ("t", 1, "Loans", [7.0, 8.0])], "t string, row_idx int, label string, figures array<double>")
    b = spark.createDataFrame([("t", 5, "Borrowings", [7.0, 8.0]), ("t", 6, "Cash at banks", [])], "t string, row_idx int, label string, figures array<double>")
    assert {tuple(r)[1:] for r in evaluation.align_rows_by_figures(a, b, ["t"]).collect()} == {(1, 5), (0, 6)}
    s = spark.createDataFrame([("t", "111", "111"), ("t", "10", "01")], "t string, a string, b string")
    assert evaluation.structure_similarity(s, ["t"]).first().similarity == 0.75


def test_ruling_lines(spark):
    """Pieces of one rule, a border drawn twice, an underline, a short stroke and a curve."""
    draw = [
        ("re", 72.0, 100.0, 150.0, 100.5), ("re", 151.0, 100.1, 300.0, 100.6), ("l", 72.0, 101.9, 300.0, 101.9), ("l", 80.0, 200.0, 120.0, 200.0), ("l", 10.0, 300.0, 20.0, 300.0),
        ("c", 72.0, 400.0, 300.0, 400.0), ("l", 72.0, 50.0, 72.0, 400.0),
    ]
    drawings = spark.createDataFrame([("d", 1, *x, 0.5) for x in draw], "doc_id string, page_no int, kind string, x0 double, y0 double, x1 double, y1 double, stroke double")
    links = spark.createDataFrame([("d", 1, 79.0, 190.0, 121.0, 201.0)], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double")
    stats = spark.createDataFrame([("d", 1, 14.0)], "doc_id string, page_no int, line_pitch double")
    got = sorted((r.orientation, r.x0, r.x1, round((r.y0 + r.y1) / 2, 2)) for r in layout.extract_rules(drawings, links, stats).collect())
    assert [g[0] for g in got] == ["h", "v"] and got[0][1:3] == (72.0, 300.0)
