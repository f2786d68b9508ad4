import re

from llm_rows import ODD, SF

from tabulith.llm import graph, jaccard, queries


def plain(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = {}
    for n, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(n)
    for n, s in enumerate(sets):
        shared = {}
        for g in s:
            for m in lists[g]:
                if m < n:
                    shared[m] = shared.get(m, 0) + 1
        for m, o in shared.items():
            if 100 * o >= 80 * (len(s) + len(sets[m]) - o):
                parent[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            r = find(n)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(find(n)) if s else i) for n, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_classes(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert result(queries.op4_ngram_jaccard_join(spark, SF)) == want
    assert len({c for _, _, c in want}) < len(want)


def test_chains_and_hot_groups(spark, monkeypatch):
    """Chains of near copies, of which the ends don't link, and 5-grams that most rows hold."""
    import random

    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    rows, passage = [], [rng.choice(vocab) for _ in range(60)]
    text = [rng.choice(vocab) for _ in range(150)]
    for k in range(60):  # a chain, one word after another
        text = list(text)
        text[rng.randrange(150)] = f"new{k}"
        rows.append((1000 - k, " ".join(text)))
    base = [rng.choice(vocab) for _ in range(120)]
    for k in range(150):  # a cloud of near copies
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(120)] = f"c{k}"
        rows.append((2000 + k, " ".join(t)))
    for k in range(200):  # the passage with more or less beside it
        rows.append((3000 + k, " ".join(passage + [f"p{k}x{j}" for j in range(rng.randrange(14))])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert result(jaccard.jaccard_classes(df)) == want
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 1)
    assert result(jaccard.jaccard_classes(df)) == want


def test_odd_rows(spark, odd, empty):
    assert result(jaccard.jaccard_classes(odd)) == plain(ODD)
    assert jaccard.jaccard_classes(empty).count() == 0


def test_components(spark):
    import random

    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == root[n] for n in got) and set(root) - set(got) <= {a for a, b in edges if a == b}
