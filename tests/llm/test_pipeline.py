"""The pipeline against a plain version of each stage on that stage's own input."""

import corpus_pipeline
from llm_rows import ODD
from test_jaccard import plain as plain_classes
from test_linededup import plain as plain_lines
from test_text_maps import check_packing, plain_contamination

from tabulith.llm.common import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, schema = rows(docs), docs.schema
        docs = materialize(stage(spark, docs, SF), "test")
        if name != "packing":
            assert docs.columns == schema.names and docs.where("n_chars != length(text)").isEmpty()
            after = rows(docs)
        if name == "language_id":
            assert set(after) <= set(before) and len(before) - len(after) <= 3
        elif name == "line_dedup":
            want = {i: t for i, t in plain_lines(before).items() if t.strip() or not dict(before)[i].strip()}
            assert dict(after) == want
        elif name == "jaccard_join":
            assert sorted(after) == sorted((i, t) for i, t in before if i in {i for i, _, c in plain_classes(before) if i == c})
        elif name == "decontamination":
            assert sum(r[5] for r in plain_contamination(before, items)) > 0
            assert sum(r[5] for r in plain_contamination(after, items)) == 0
            clean = {r[0] for r in plain_contamination(before, items) if not r[5]}
            assert {(i, t) for i, t in before if i in clean} <= set(after)
        else:
            check_packing(docs.collect(), before)


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for rows_ in (ODD, []):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), "test")
        docs.count()
    assert bench.count()
