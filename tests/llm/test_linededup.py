"""Line dedup of lines of every length against a plain version."""

import random
import re
from collections import Counter

from llm_rows import ODD

from tabulith.llm import linededup


def words_of(line):
    return re.split(r"[ \t\r\x0b\f]+", line.lower().strip(" \t\r\x0b\x0c"))


def got(spark, rows):
    return {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_short_lines_that_are_repeated(spark):
    rows = [(1, "All rights reserved.\n\nles.\n \none"), (2, "les.\n\nall  rights RESERVED. \n \ntwo"), (3, "les\nall rights kept.\nles."), (None, "one")]
    assert got(spark, rows) == {1: rows[0][1], 2: "\n \ntwo", 3: "les\nall rights kept.", None: ""}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(rows):
    lines = [((i is None, i or 0, k), words_of(line)) for i, text in rows for k, line in enumerate((text or "").split("\n")) if line.strip(" \t\r\x0b\x0c")]
    # What differs in the bags of words is at most the distance.
    may = lambda a, b, k: abs(len(a) - len(b)) <= k and sum((Counter(a) - Counter(b)).values()) <= k and distance(a, b) <= k
    like = lambda a, b: a == b or min(len(a), len(b)) >= 10 and may(a, b, min(len(a), len(b)) // 10)
    gone = {at for at, w in lines if any(o < at and like(v, w) for o, v in lines)}
    return {i: text and "\n".join(x for k, x in enumerate(text.split("\n")) if (i is None, i or 0, k) not in gone) for i, text in rows}


def test_edits_grow_with_the_line(spark):
    draw = random.Random(7)
    rows, n = [], 0
    for size in (9, 10, 19, 20, 21, 29, 30, 33, 47, 60, 99, 119):
        base = [f"w{draw.randrange(400)}" for _ in range(size)]
        for edits in range(size // 10 + 3):
            line = list(base)
            for _ in range(edits):
                at, kind = draw.randrange(len(line)), draw.randrange(3)
                line[at : at + (kind < 2)] = [] if kind == 0 else [f"new{draw.randrange(10**6)}"]
            rows.append((n, " ".join(line)))
            n += 1
    draw.shuffle(rows)
    want = plain(rows)
    assert got(spark, rows) == want and 15 < sum(not t for t in want.values()) < len(rows)


def test_documents_and_odd_rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for rows in (docs, ODD):
        assert got(spark, rows) == plain(rows)


def test_lines_with_a_common_passage_are_few_pairs(spark, monkeypatch):
    draw, made = random.Random(3), {}
    passage = "passagethatallhaveq incommonandthatislongq thanotherse"
    rows = [(i, f"{' '.join(f'w{draw.randrange(10**6)}n' for _ in range(12))} {passage} {' '.join(f'w{draw.randrange(10**6)}n' for _ in range(15 + i % 3))}") for i in range(300)]
    rows += [(300 + i, t.replace(" incommonandthatislongq", " x")) for i, t in rows[::50]]
    write = linededup.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    assert got(spark, rows) == plain(rows)
    assert made["more-pairs"] < len(rows)


def counted(monkeypatch):
    """Rows by name that line dedup writes, and those of the join of further pairs before they are made distinct."""
    made, write, others = {}, linededup.materialize, linededup._others

    def writes(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    def joins(*args):
        out = others(*args)
        made["joined"] = out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", writes)
    monkeypatch.setattr(linededup, "_others", joins)
    return made


def test_words_that_stand_twice_do_not_hide_that_lines_differ(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, " ".join(2 * [*(f"w{draw.randrange(10**6)}n" for _ in range(14 + i % 3)), "passagethatallhaveq incommonandthatislongq thanotherse"])) for i in range(200)]
    rows += [(200 + i, t.replace(" incommonandthatislongq", " x", 1)) for i, t in rows[::50]]
    made = counted(monkeypatch)
    assert got(spark, rows) == plain(rows)
    assert made["more-pairs"] < len(rows)


def test_lines_with_many_common_keys_meet_once(spark, monkeypatch):
    draw = random.Random(6)
    # The repeated passage fills the lines' keys, and what else they hold is a little beyond the bound.
    rows = [(i, " ".join([*(f"w{draw.randrange(10**6)}" for _ in range(22 + i % 2)), *(70 * ["is", "onhe."])])) for i in range(60)]
    rows += [(60 + i, t.replace("is onhe.", "was on", 4)) for i, t in rows[::20]]
    made = counted(monkeypatch)
    assert got(spark, rows) == plain(rows)
    assert 0 < made["joined"] <= 2 * made["more-pairs"]


def test_edits_of_lines_with_repeated_words(spark):
    draw = random.Random(8)
    rows, n = [], 0
    for size in (10, 12, 20, 24, 40, 75, 130, 400):
        for words in (3, 9):
            base = [f"{draw.choice('abcdef')}{draw.randrange(words)}{draw.choice('nqe')}" for _ in range(size)]
            for edits in (0, 1, 2, size // 10, size // 10 + 1):
                line = list(base)
                for _ in range(edits):
                    line[draw.randrange(len(line))] = draw.choice(base) if draw.randrange(2) else f"x{draw.randrange(99)}e"
                rows.append((n, " ".join(line)))
                n += 1
    draw.shuffle(rows)
    assert got(spark, rows) == plain(rows)
