"""Quality rules as a short-circuit cascade.

A text passes when no rule rejects it, in whatever order the rules are asked. One task asks all
rules of a bounded sample of texts and times them beyond the statistics that every row needs
anyway. The rule that rejects most of the sample per second comes first, the next one is chosen by
what is left of the sample, and so on. Every task asks in that order and stops at the first rule
that rejects. The order changes the cost alone, never a verdict.

Words are stretches without ASCII white space. Defined results: a null or empty text has no words
and fails the base rule; a null id stays null; repeated rows are judged each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulith.llm.common import only, text_slices

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Texts on which rules are timed, at most; any will do, as they decide the order alone.
SAMPLE_ROWS = 400
#: Words of a stretch in which distinct words are counted.
STRETCH = 500

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LETTER = bytes(c for c in range(128) if c not in _LETTERS)


class Text:
    """A text and what the rules ask of it, each worked out at most once."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows that the text holds twice or more, the first one included."""
        w = self.words
        if len(w) <= WINDOW:
            return 0
        windows = list(zip(*(w[i:] for i in range(WINDOW))))
        if len(set(windows)) == len(windows):
            return 0
        counts, total, covered = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                total += i + WINDOW - max(covered, i)
                covered = i + WINDOW
        return total

    @cached_property
    def letters(self) -> int:
        return len(self.raw.translate(None, _NOT_LETTER))

    @cached_property
    def capitals(self) -> int:
        return len(self.raw.translate(None, _NOT_UPPER))

    @cached_property
    def distinct(self) -> int:
        """Words distinct within their stretch of the text: the share does not fall as texts grow."""
        return sum(len(set(self.words[a : a + STRETCH])) for a in range(0, self.n_words, STRETCH))

    def prepare(self) -> Text:
        """Works out what every row returns, so that it is no rule's cost."""
        _ = self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words
        return self


Rule = Callable[[Text], bool]


def base_rule(t: Text) -> bool:
    return t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words


def symbol_words(t: Text) -> bool:
    """More than one symbol in five words."""
    return 5 * t.n_symbols > t.n_words


def shouting(t: Text) -> bool:
    """Mostly capitals, or an exclamation mark in two words."""
    return 2 * t.capitals > t.letters or 2 * t.raw.count(b"!") > t.n_words


def stammer(t: Text) -> bool:
    """A fifth of the words equal the word before."""
    w = t.words
    return 5 * sum(map(bytes.__eq__, w, w[1:])) > len(w)


def repeated_lines(t: Text) -> bool:
    """More than three tenths of the lines stand there again."""
    return 10 * t.n_dup_lines > 3 * len(t.lines)


def word_length(t: Text) -> bool:
    """Words of less than 2 or more than 14 characters on average."""
    return not 2 * t.n_words <= t.word_chars <= 14 * t.n_words


def few_distinct(t: Text) -> bool:
    """In 50 words or more, less than a fifth differ within their stretches."""
    return t.n_words >= 50 and 5 * t.distinct < t.n_words


def no_letters(t: Text) -> bool:
    """Less than half of the bytes of words belong to letters."""
    return 2 * t.letters < sum(map(len, t.words))


RULES: dict[str, Rule] = {f.__name__: f for f in (symbol_words, shouting, stammer, repeated_lines, word_length, few_distinct, no_letters)}


def measured(texts: list[bytes], rules: dict[str, Rule]) -> list[tuple[str, int, int, float]]:
    """(rule, texts asked, rejected, seconds) in the order of the cascade, greedily: each rule by what it
    rejects per second of the texts that the rules before it pass."""
    asked = [t for t in (Text(raw).prepare() for raw in texts) if not base_rule(t)]
    seconds: dict[str, list[float]] = {}
    rejects: dict[str, list[bool]] = {}
    for name, rule in rules.items():
        seconds[name], rejects[name] = [], []
        for t in asked:
            fresh = Text(t.raw).prepare()
            began = time.perf_counter()
            rejects[name].append(bool(rule(fresh)))
            seconds[name].append(time.perf_counter() - began)
    left, open_, out = list(range(len(asked))), list(rules), []
    while open_:
        figures = {n: (sum(rejects[n][i] for i in left), sum(seconds[n][i] for i in left)) for n in open_}
        name = max(open_, key=lambda n: figures[n][0] / (figures[n][1] + 1e-9))
        out.append((name, len(left), *figures[name]))
        left = [i for i in left if not rejects[name][i]]
        open_.remove(name)
    return out


def cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, text: str = "text", sample: int = SAMPLE_ROWS) -> list[tuple[str, int, int, float]]:
    """``measured`` on at most ``sample`` texts, in one task."""
    rules = dict(RULES if rules is None else rules)

    def kernel(batches):
        texts = [t for _, ts in text_slices(batches) for t in ts]
        columns = list(zip(*measured(texts, rules))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["rule", "n", "rejected", "seconds"])

    got = only(docs, text).toDF("text").where("text is not null").limit(sample).coalesce(1).mapInArrow(kernel, "rule string, n long, rejected long, seconds double").collect()
    known = [tuple(r) for r in got]
    return known + [(n, 0, 0, 0.0) for n in rules if n not in {r[0] for r in known}]


_OUT = [
    ("id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
]


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, text: str = "text", id: str = "doc_id", sample: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (id, the statistics, base_failed, kept)."""
    rules = dict(RULES if rules is None else rules)
    ordered = [rules[r[0]] for r in cascade(docs, rules, text, sample)]

    def kernel(batches):
        for part, texts in text_slices(batches):
            cols: list[list] = [[] for _ in _OUT[1:]]
            for raw in texts:
                t = Text(raw)
                failed = base_rule(t)
                kept = not failed and not any(rule(t) for rule in ordered)
                row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept)
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *[pa.array(c, kind) for c, (_, kind) in zip(cols, _OUT[1:])]], names=[n for n, _ in _OUT])

    own = only(docs, id, text).toDF("id", "text")
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return own.mapInArrow(kernel, schema).withColumnRenamed("id", id)


def rule_report(docs: DataFrame, rules: dict[str, Rule] | None = None, text: str = "text", sample: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (place, rule, n, rejected, seconds): the cascade's order and what it was chosen by."""
    rows = [(k, *r) for k, r in enumerate(cascade(docs, rules, text, sample))]
    return docs.sparkSession.createDataFrame(rows, "place int, rule string, n long, rejected long, seconds double")
