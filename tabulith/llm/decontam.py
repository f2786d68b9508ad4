"""Benchmark decontamination with an FM-index for each shard of training text.

A shard's words are numbered by the benchmark's vocabulary; any other word is a wall that no
phrase crosses, and runs of known words that are shorter than the shortest phrase are left out,
as they can't hold one. Over the rest the shard builds an FM-index: suffix order, the
Burrows-Wheeler sequence as a wavelet tree with rank counts, and suffix positions sampled at
regular steps. Phrases are found by backward search, located by walking to the next sampled
position, and their spans are merged for each document.

Defined results: null or empty texts have no words and no hits; an item without words has no
phrase; equal items are each reported; repeated rows each get a row; an empty benchmark or table
gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import drop, materialize, only, text_slices, thrifty

#: ASCII letters in lower case, digits as they are, all other ASCII characters as space.
WORD_TABLE = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
WINDOW = 10
#: Benchmark words that driver and executors hold at once; a larger benchmark is searched block after block.
BLOCK_WORDS = 1_000_000
SAMPLE_STEP = 8


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Phrases:
    """The distinct windows of some items, numbered over those items' words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        known: dict[tuple[int, ...], int] = {}
        self.owners: list[list[str]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if ids else 0):
                n = known.setdefault(tuple(ids[i : i + k]), len(known))
                if n == len(self.owners):
                    self.owners.append([])
                if not self.owners[n] or self.owners[n][-1] != item:
                    self.owners[n].append(item)
        self.lengths = np.array([len(k) for k in known], np.int64)
        self.shortest = int(self.lengths.min()) if known else window
        self.longest = int(self.lengths.max()) if known else window
        self.symbols = np.zeros((len(known), self.longest), np.int64)  # right-aligned
        for k, n in known.items():
            self.symbols[n, self.longest - len(k) :] = k


class WaveletTree:
    """Rank over a sequence of small integers: one level of bits for each binary digit."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place beside it."""
        lo, hi = np.zeros_like(places), places.copy()
        for k, level in enumerate(reversed(range(self.bits))):
            one = ((symbols >> level) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, places: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(places), places.copy()
        for k in range(self.bits):
            ones = self.ones[k][at]
            one = (self.ones[k][at + 1] - ones).astype(bool)
            out = out * 2 + one
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    """FM-index of a sequence whose last symbol is 0, found nowhere else; symbols are below ``size``."""

    def __init__(self, sequence: np.ndarray, size: int, step: int = SAMPLE_STEP):
        # Walls (1) end every phrase, but LF-walks cross them, so the order has to be a full one.
        order = full_suffix_order(sequence)
        self.bwt = WaveletTree(sequence[order - 1].astype(np.int64), size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size))])
        self.sampled = np.where(order % step == 0, order, -1)
        self.n = len(sequence)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of each phrase, all phrases at once, a symbol a step."""
        m = len(phrases.lengths)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for k in range(phrases.longest):
            alive = alive[(phrases.lengths[alive] > k) & (lo[alive] < hi[alive])]
            s = phrases.symbols[alive, phrases.longest - 1 - k]
            lo[alive] = self.first[s] + self.bwt.rank(s, lo[alive])
            hi[alive] = self.first[s] + self.bwt.rank(s, hi[alive])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: step back until a sampled row."""
        at, out, walked = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.sampled[at[open_]]
            out[open_[found >= 0]] = found[found >= 0] + walked
            open_ = open_[found < 0]
            s = self.bwt.access(at[open_])
            at[open_] = self.first[s] + self.bwt.rank(s, at[open_])
            walked += 1
        return out


def full_suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that are still tied are sorted again."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    key = sequence[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start  # a class's rank is its first place
    step = 1
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        places = np.flatnonzero(~alone)
        if not len(places):
            return order
        tied = order[places]
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        own = rank[tied]
        again = np.argsort(own * (n + 1) + after + 1, kind="stable")
        tied, own, after = tied[again], own[again], after[again]
        order[places] = tied
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        first[places] = new
        head = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        rank[tied] = places[head]
        step *= 2


def _runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Which words stand in a run of at least ``shortest`` known words."""
    known = ids > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= shortest
    mark = np.zeros(len(ids) + 1, np.int32)
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long], -1)
    return np.cumsum(mark[:-1]) > 0


def hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its words, the merged spans of hit words, and the items found."""
    get = phrases.vocabulary.get
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    out = [(int(n), [], []) for n in sizes]
    ends = np.cumsum(sizes + 1)
    ids = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)  # a wall after each text
    for x, end, n in zip(lists, ends, sizes):
        ids[end - 1 - n : end - 1] = [get(w, 1) for w in x]
    keep = np.flatnonzero(_runs(ids, phrases.shortest)) if len(phrases.lengths) else np.zeros(0, np.int64)
    if not len(keep):
        return out
    # Runs side by side, with a wall between two of them.
    gap = np.concatenate([[0], np.cumsum(np.diff(keep) > 1)])
    sequence = np.ones(len(keep) + int(gap[-1]) + 2, np.int64)
    sequence[np.arange(len(keep)) + gap] = ids[keep]
    sequence[-1] = 0
    origin = np.full(len(sequence), -1, np.int64)
    origin[np.arange(len(keep)) + gap] = keep
    index = FMIndex(sequence, len(phrases.vocabulary) + 2)
    lo, hi = index.search(phrases)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    start = origin[index.locate(rows)]
    doc = np.searchsorted(ends, start, side="right")
    begin = start - (ends - sizes - 1)[doc]
    order = np.lexsort((begin, doc))
    found: dict[int, set[str]] = {}
    for i in order:
        d, a, k = int(doc[i]), int(begin[i]), int(which[i])
        spans, b = out[d][1], int(begin[i] + phrases.lengths[k])
        if spans and a <= spans[-1][1]:
            if b > spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
        found.setdefault(d, set()).update(phrases.owners[k])
    for d, items in found.items():
        out[d][2].extend(sorted(items))
    return out


_OUT = "id long, n_words long, starts array<long>, ends array<long>, items array<string>"
_SPANS = [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kernel(phrases: Phrases, more: bool):
    """Rows with what this block and the blocks before it found; the text goes on while ``more`` follow."""

    def kernel(batches):
        for part, texts in text_slices(batches, size=4_000_000):
            got = hits(texts, phrases)
            if "starts" in part.schema.names:
                old = part.to_pydict()
                got = [
                    (n, merged([*spans, *zip(a, b)]), sorted({*items, *c})) for (n, spans, items), a, b, c in zip(got, old["starts"], old["ends"], old["items"])
                ]
            columns = [[g[0] for g in got], [[s for s, _ in g[1]] for g in got], [[e for _, e in g[1]] for g in got], [g[2] for g in got]]
            arrays = [part.column(0), *([part.column(1)] if more else []), *[pa.array(c, kind) for c, (_, kind) in zip(columns, _SPANS)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *(["text"] if more else []), *[n for n, _ in _SPANS]])

    return kernel


def _blocks(benchmark: DataFrame, item: str, item_text: str, window: int, block_words: int):
    """The benchmark's phrases, in blocks of at most ``block_words`` words (an item more), and whether more follow."""
    rows = only(benchmark, item, item_text).where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item}`").cast("string"), F.col(f"`{item_text}`"))
    block, size, full = [], 0, None
    for i, t in rows.orderBy(*rows.columns).toLocalIterator():
        if full is not None:
            yield Phrases(full, window), True
            full = None
        block.append((i if i is not None else "", t.encode()))
        size += len(words(block[-1][1]))
        if size >= block_words:
            full, block, size = block, [], 0
    if full is not None and block:
        yield Phrases(full, window), True
        full = None
    yield Phrases(full or block, window), False


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (id, n_words, starts, ends, items): merged spans of hit words and the items found.

    The benchmark passes the driver in blocks of at most ``block_words`` words (an item more). Each
    block adds to the rows that the block before it wrote, so every row stays its own.
    """
    own = only(docs, id, text).withColumnsRenamed({id: "id", text: "text"}).withColumn("id", F.col("id").cast("long"))
    out, last = own, None
    for phrases, more in _blocks(benchmark, item, item_text, window, block_words):
        found = out.mapInArrow(thrifty(_kernel(phrases, more)), _OUT.replace("long, n_words", "long, text string, n_words") if more else _OUT)
        if not more:
            return found.withColumnRenamed("id", id)
        out = materialize(found, "found-spans")
        if last is not None:
            drop(last)
        last = out


def digest_columns(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated, from spans and items."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        id,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans; what stands between two words stays."""
    import re

    if not spans:
        return text
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str = "n_chars", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without the words of benchmark passages, ``n_chars`` brought up to date.

    A row that loses all its words goes. Where two ends that meet make up a passage, it goes too:
    all blocks are asked again until none finds anything.
    """

    def cleaning(phrases: Phrases):
        def kernel(batches):
            for part, texts in text_slices(batches, text, 4_000_000):
                found = hits(texts, phrases)
                changed = [k for k, f in enumerate(found) if f[1]]
                if not changed:
                    yield part
                    continue
                at, keep = part.schema.get_field_index(text), [True] * len(texts)
                column = part.column(at).to_pylist()
                for k in changed:
                    new, spans = texts[k], found[k][1]
                    while spans:
                        new = remove_spans(new, spans)
                        spans = hits([new], phrases)[0][1]
                    column[k], keep[k] = new.decode(), bool(words(new))
                part = part.set_column(at, part.schema.field(at), pa.array(column, part.schema.field(at).type))
                if (at := part.schema.get_field_index(n_chars)) >= 0:
                    sizes = part.column(at).to_pylist()
                    for k in changed:
                        sizes[k] = len(column[k])
                    part = part.set_column(at, part.schema.field(at), pa.array(sizes, part.schema.field(at).type))
                yield part.filter(pa.array(keep))

        return kernel

    out, blocks = docs, 0
    while True:
        for phrases, more in _blocks(benchmark, item, item_text, window, block_words):
            last, out, blocks = out, out.mapInArrow(thrifty(cleaning(phrases)), docs.schema), blocks + 1
            if more or blocks > 1:
                out = materialize(out, "cleaned")
                if last is not docs:
                    drop(last)
        # One block leaves nothing that it would find itself.
        if blocks == 1 or contamination(out.withColumn("__no_id", F.lit(0)), benchmark, text, "__no_id", item, item_text, window, block_words).where("size(starts) > 0").isEmpty():
            return out
