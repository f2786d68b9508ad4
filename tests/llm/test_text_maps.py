"""Operators that look at one text at a time, against plain restatements."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_rows import ODD, SF
from tokenizers import Tokenizer

from tabulith.llm import decontam, langid, packing, quality, queries, tokencount
from tabulith.llm.common import tokenizer_path

WS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---- quality rules


def plain_quality(text):
    w = WS.findall(text or "")
    n = len(w)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    hit = set()
    for i in range(n - 4):
        if count[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WS.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality(spark, odd, empty):
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op1_quality_rules(spark, SF).collect()}
    assert got == {i: plain_quality(t) for i, t in docs(spark)}
    rows = collections.Counter(tuple(r)[:7] for r in quality.judge(odd).collect())
    assert rows == collections.Counter((i, *plain_quality(t)) for i, t in ODD)
    assert quality.judge(empty).count() == 0


def plain_kept(text):
    """The rules, restated on characters."""
    text = text or ""
    n, chars, symbols, dup, _, failed = plain_quality(text)
    w = WS.findall(text)
    letters = [c for c in text if c.isascii() and c.isalpha() or not c.isascii()]
    n_letters = sum(len(c.encode()) for c in letters)
    capitals = sum("A" <= c <= "Z" for c in text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    stretches = sum(len(set(w[a : a + 500])) for a in range(0, n, 500))
    bad = (
        5 * symbols > n, 2 * capitals > n_letters or 2 * text.count("!") > n, 5 * sum(a == b for a, b in zip(w, w[1:])) > n, 10 * dup > 3 * len(lines),
        chars < 2 * n or chars > 14 * n, n >= 50 and 5 * stretches < n, 2 * n_letters < sum(len(x.encode()) for x in w),
    )
    return not failed and not any(bad)


def test_verdicts(spark):
    got = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, SF).collect()}
    assert got == {i: plain_kept(t) for i, t in docs(spark)} and 0 < sum(got.values()) < len(got)
    long = [" ".join(f"w{k % 4000}" for k in range(n)) for n in (20_000, 20_001)] + [" ".join(f"w{(k * k) % 90}" for k in range(n)) for n in (20_000, 20_001, 60_000)]
    rules = {"few_distinct": quality.few_distinct}
    assert [any(r(quality.Text(t.encode())) for r in rules.values()) for t in long] == [False, False, True, True, True]


def test_cascade_orders_greedily_and_keeps_verdicts(spark):
    texts = [(t or "").encode() for _, t in docs(spark)]
    order = quality.measured(texts[:200], quality.RULES)
    assert sorted(r[0] for r in order) == sorted(quality.RULES)
    left = [n for _, n, _, _ in order]
    assert left == sorted(left, reverse=True) and all(n - r == m for (_, n, r, _), m in zip(order, left[1:]))
    assert quality.measured([], quality.RULES) and quality.rule_report(spark.read.parquet(f"{SF}/documents.parquet")).count() == len(quality.RULES)


def test_quality_keeps_good_documents(spark):
    got = queries.op1_quality_rules(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = got.join(labels, "doc_id").where("n_words >= 30").collect()
    good = [r.kept for r in both if r.quality == 1]
    bad = [r.kept for r in both if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


# ---- tokens


def test_token_counts(spark, odd, empty):
    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = lambda t: (len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False)))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op8_token_counts(spark, SF).collect()}
    assert got == {i: want(t) for i, t in docs(spark)}
    rows = collections.Counter(tuple(r) for r in tokencount.token_counts(odd, tokenizer_path("word_bpe_49k.json")).collect())
    assert rows == collections.Counter((i, *want(t)) for i, t in ODD)
    assert tokencount.token_counts(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_cache_is_used_and_appended(spark, odd, tmp_path):
    path, tk = str(tmp_path / "cache"), tokenizer_path("word_bpe_49k.json")
    first = sorted(map(str, tokencount.token_counts(odd, tk, path).collect()))
    n = spark.read.parquet(path).count()
    assert sorted(map(str, tokencount.token_counts(odd, tk, path).collect())) == first
    assert spark.read.parquet(path).count() == n
    more = odd.union(spark.createDataFrame([(99, "quite new", "", 0.0, [1])], odd.schema))
    assert tokencount.token_counts(more, tk, path).where("doc_id = 99").first().n_tokens == 2
    assert spark.read.parquet(path).count() == n + 1


def test_stretches_side_by_side(spark):
    """Encoding new stretches together gives what the library gives for each."""
    odd = ["\u00c9te\u0301", "e\u0301\u0301x", "\ufb03", "\u0130x", "a\u00a0b", "\u3000", "x\u0085y", "\U0001f600\u200d\U0001f525", "don't", "''s", "12\u00bd", "<|endoftext|><|x", "\u1e9e\u00df", "\u0301"]
    words = list(dict.fromkeys(odd + [w for _, t in docs(spark) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]))[:60_000]
    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = tokencount.chunk_counter(tokenizer_path("word_bpe_49k.json"))([w.encode() for w in words])
    assert list(got) == [len(e) for e in tk.encode_batch(words, add_special_tokens=False)]
    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [" ".join(words[k : k + 7]) + "  " + words[k] + "\n \t" for k in range(0, len(words), 7)] + ["\x1c a\x1f", " \u2003 b", "\x85c", " <|endoftext|> d", "\u180ee"]
    assert packing.encoder(tokenizer_path("byte_bpe_50k.json"))([t.encode() for t in texts]) == [np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# ---- packing


def check_packing(rows, texts, capacity=2048):
    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, text in texts:
        ids = np.array(tk.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: (r.piece, r.offset))
        copies = sum(j == i for j, _ in texts)
        at = 0
        for k, r in enumerate(pieces[::copies]):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_packing(spark, odd, empty):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    n, tokens = check_packing(rows, docs(spark))
    assert n <= -(-tokens // 2048) * 1.01 + 1
    path = tokenizer_path("byte_bpe_50k.json")
    check_packing(packing.pack(odd.repartition(5), path).collect(), ODD)
    assert packing.pack(empty, path).count() == 0


def test_packing_in_many_partitions(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(60)
    rows = packing.pack(d, tokenizer_path("byte_bpe_50k.json"), fan_in=3).collect()
    n, tokens = check_packing(rows, docs(spark))
    assert n <= -(-tokens // 2048) * 1.06 + 1


def tree(parts, capacity, fan_in, slack, least):
    """Bins of the whole tree, with every underfull bin of a node climbing where ``least`` is 0."""
    done, nodes = 0, []
    for sizes in parts:
        nodes.append(packing.best_fit(sizes, capacity)[2])
    least = least and min((f for fill in nodes for f in fill), default=0)
    while True:
        last, up = len(nodes) == 1, []
        for fill in nodes:
            climb = [f for b, f in enumerate(fill) if not last and b in packing.underfull(fill, capacity, slack) and f + least <= capacity]
            done += len(fill) - len(climb)
            up.append(climb)
        if last:
            return done
        nodes = [packing.best_fit([f for n in up[a : a + fan_in] for f in n], capacity)[2] for a in range(0, len(up), fan_in)]


def test_bins_that_stay_could_not_gain():
    rng = np.random.default_rng(4)
    for _ in range(60):
        parts = [[int(x) for x in rng.integers(500, 1500, rng.integers(1, 40))] for _ in range(rng.integers(9, 60))]
        for fan_in in (2, 3, 8):
            assert tree(parts, 2048, fan_in, 0, True) == tree(parts, 2048, fan_in, 0, False)


def test_best_fit_leaves_one_small_bin():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [int(x) for x in rng.integers(1, 101, rng.integers(1, 80))]
        bins, offsets, fill = packing.best_fit(sizes, 100)
        assert sum(2 * f <= 100 for f in fill) <= 1 and max(fill) <= 100
        assert sum(fill) == sum(sizes)


# ---- decontamination


def plain_contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in texts:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


def test_contamination(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = collections.Counter(tuple(r) for r in queries.op6_decontamination(spark, SF).collect())
    assert got == plain_contamination(docs(spark), items)
    assert sum(r[5] for r in got) > 5


def test_contamination_of_odd_rows(spark, odd, empty):
    items = [(1, "The of AND"), (2, None), (3, ""), (4, "word " * 30), (5, "a b c d e f g h i j k"), (6, "the of and"), (None, "line line")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, id string")
    want = plain_contamination(ODD, [("" if i is None else i, t) for i, t in items])
    for block in (10**6, 3):
        found = decontam.contamination(odd, bench, block_words=block)
        assert collections.Counter(tuple(r) for r in decontam.digest_columns(found).collect()) == want
    none = decontam.contamination(odd, bench.limit(0))
    assert none.where("size(items) > 0").count() == 0 and none.count() == len(ODD)
    assert decontam.contamination(empty, bench).count() == 0


def test_cleaning_is_the_same_in_blocks(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, "x y")], "item_id long, text string")
    texts = [(1, "a b c x y d e f g"), (1, "a b c x y d e f g"), (None, "x y"), (3, "keep a b x y it"), (4, None)]
    docs_ = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (10**6, 3):
        got = collections.Counter(tuple(r) for r in decontam.clean(docs_, bench, block_words=block).collect())
        assert got == collections.Counter([(3, "keep a b  it"), (4, None)])


@pytest.mark.parametrize("seed", range(5))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    seq = np.concatenate([rng.integers(1, 6, 400), [0]])
    order = decontam.full_suffix_order(seq)
    assert list(order) == sorted(range(len(seq)), key=lambda i: list(seq[i:]))
    index = decontam.FMIndex(seq, 6)
    assert list(index.locate(np.arange(len(seq)))) == list(order)


def test_remove_spans():
    assert decontam.remove_spans(b"One, two three! Four five.", [(1, 3)]) == b"One, ! Four five."


# ---- languages


def test_language_accuracy(spark, odd, empty):
    got = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(d, tokenizer_path("piece_bpe_32k.model"), sample_texts=100)
    rows = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (9, "und")} <= rows and len(langid.predict(odd, model).collect()) == len(ODD)
    assert langid.predict(empty, model).count() == 0
    assert langid.fit(empty, tokenizer_path("piece_bpe_32k.model")).languages == []


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces.names) + 1, 2)) / 100
    table[-1] = langid.UNKNOWN
    number = {p: n for n, p in enumerate(pieces.names)}

    def total(word, c):
        a = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - pieces.longest), j):
                p = word[i:j]
                if p in number:
                    a[j] += a[i] * table[number[p], c]
                elif j == i + 1:
                    a[j] += a[i] * langid.UNKNOWN
        return np.log(a[-1])

    words = ["▁the", "▁und", "▁thereable", "▁ñandóß", "▁x" + "ab" * 15, "▁information", "▁" + "abc" * 60]
    got = langid.forward(pieces, table, words)
    assert np.allclose(got, [[total(w, 0), total(w, 1)] for w in words])


def test_scores_tell_how_clear_a_text_is(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    model = langid.fit(d, tokenizer_path("piece_bpe_32k.model"), sample_texts=150)
    one = {r.lang: r.text for r in d.where("length(text) > 2000").orderBy("doc_id").collect()}
    a, b = (one[k][:1500] for k in sorted(one)[:2])
    rows = [(1, a), (2, b), (3, a + " " + b), (4, "Съешь же ещё этих мягких французских булок, да выпей чаю " * 3), (5, "qzxv wkjq zzxqk vvkqj xqzw " * 6), (6, "κλμ " * 30)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in langid.predict(docs_, model).collect()}
    assert score[3] < min(score[1], score[2])
    assert {r.doc_id for r in langid.keep_known(docs_, model, 0.3).collect()} == {1, 2, 3}
    kept = langid.keep_known(d, model, 0.3)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    assert labels.join(d, "doc_id", "left_semi").join(kept, "doc_id", "left_anti").count() == 0


def test_tokenizers_that_keep_white_space(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rows = [(1, "a  b"), (2, "a b"), (3, " a\n\n b "), (4, None)]
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {i: len(tk.encode(t or "", add_special_tokens=False)) for i, t in rows}
    assert tokencount.drops_white_space(tokenizer_path("word_bpe_49k.json"))
