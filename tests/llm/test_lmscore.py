import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_rows import ODD, SF

from tabulith.llm import lmscore, queries


def plain(rows, depth, min_count, min_gain, folds=10):
    """The tree by dictionaries."""
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % folds != 0 for i, _ in rows]
    words = Counter(w for ws, ok in zip(toks, train) if ok for w in ws)
    n_all, v = sum(words.values()), len(words)
    nexts = defaultdict(Counter)
    for ws, ok in zip(toks, train):
        if ok:
            for i, w in enumerate(ws):
                for d in range(1, min(depth, i) + 1):
                    nexts[tuple(ws[i - d : i])][w] += 1
    states = {}

    def p(context, w):
        if not context:
            return (words[w] + 0.1) / (n_all + 0.1 * (v + 1))
        below = p(context[1:], w)
        if context not in states:
            return below
        c = nexts[context]
        return (c[w] + len(c) * below) / (sum(c.values()) + len(c))

    for context in sorted(nexts, key=len):
        c = nexts[context]
        n, k = sum(c.values()), len(c)
        if n >= min_count:
            gain = 0.0
            for w, m in c.items():
                below, rest = p(context[1:], w), k - (m == 1)
                gain += m * math.log(max(m - 1 + rest * below, 1e-300) / (n - 1 + rest) / below)
            if gain >= min_gain:
                states[context] = True
    out = []
    for (i, _), ws, ok in zip(rows, toks, train):
        base = sum(math.log10(p((), w)) for w in ws)
        score = sum(math.log10(p(tuple(ws[max(0, j - depth) : j]), w)) for j, w in enumerate(ws))
        out.append((i, not ok, len(ws), sum(words[w] > 0 for w in ws), n_all, base, score))
    return out, len(states)


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


@pytest.mark.parametrize(("depth", "min_count", "min_gain"), [(2, 8, 4.0), (3, 2, 0.5)])
def test_scores(spark, depth, min_count, min_gain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, n_states = plain(rows, depth, min_count, min_gain)
    assert n_states > 10
    same([tuple(r) for r in lmscore.suffix_tree_scores(docs, depth, min_count, min_gain).collect()], want)


def test_odd_rows(spark, odd, empty):
    same([tuple(r) for r in lmscore.suffix_tree_scores(odd, min_count=2).collect()], plain(ODD, 2, 2, 4.0)[0])
    assert lmscore.suffix_tree_scores(empty).count() == 0


def test_held_out_texts_gain(spark):
    got = [r for r in queries.op9_lm_scoring(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
