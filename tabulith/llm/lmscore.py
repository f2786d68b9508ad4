"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words before the next one. A context is a candidate once it
is seen ``min_count`` times in training, and becomes a state if its next-word distribution diverges
from that of its longest proper suffix: the log-likelihood that it gains over the suffix on its own
occurrences, each left out in turn, has to reach ``min_gain``. A state's distribution is smoothed
with its suffix's, P(w) = (c(w) + D * P_suffix(w)) / (N + D) with D distinct next words; the empty
context has P(w) = (c + 0.1) / (N + 0.1 * (V + 1)). A text is scored with the longest suffix that is
a state at every word.

Nothing of the model is gathered anywhere. Texts become shards of word hashes. For each kind of
count a shard asks buckets of keys for totals, sending its distinct keys with its own counts, and
gets the totals back in the same order, so each key costs one entry a shard however frequent it
is. Grams of words that one shard alone holds are not asked for. Counts of level d, distinct next words of level d - 1 and gains of level d - 2 travel in one
exchange. What is sent grows with the text.

Defined results: a null or empty text is its end alone; null ids count as training texts; repeated
rows count and are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import GOLD, LEAST_BUCKETS, bucket_of, bucket_start, drop, give_back, materialize, mix, only, order_of, pack_counts, pack_keys, shuffle_parts, text_slices, thrifty, unpack_counts, unpack_keys

DEPTH = 2
MIN_COUNT = 8
MIN_GAIN = 4.0
FOLDS = 10
ALPHA = 0.1
SHARD_BYTES = 10_000_000
#: Hash of a text's end; no word hashes to it but by chance.
END = np.uint64(0x8000000000000001)

_ROW = "kind int, bucket int, chunk long, ids array<long>, a binary, b binary, c binary, d binary"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_SHARD, _TOTALS = 0, 1
#: Kinds of exchange at level d: 10 * d + one of these. Counts are whole numbers, the others doubles.
_COUNT, _DISTINCT, _GAIN = 2, 3, 4


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def in_training(ids, folds: int) -> np.ndarray:
    return np.array([i is None or zlib.crc32(str(i).encode()) % folds != 0 for i in ids], bool)


def _shards(batches):
    from itertools import chain

    import xxhash
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    for part, texts in text_slices(batches, size=SHARD_BYTES):
        lists = [t.lower().split() for t in texts]
        sizes = np.array([len(x) + 1 for x in lists], np.uint32)
        # Each distinct word is hashed once, and tokens are numbered by their words' hashes.
        words_ = dict.fromkeys(chain.from_iterable(lists))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words_), np.uint64, len(words_))
        vocabulary, number = np.unique(np.append(hashes, END), return_inverse=True)
        rank = dict(zip(words_, number.tolist()))
        of = np.full(int(sizes.sum()), number[-1], np.int64)
        word = np.ones(len(of), bool)
        word[np.cumsum(sizes) - 1] = False
        of[word] = np.fromiter(map(rank.__getitem__, chain.from_iterable(lists)), np.int64, int(word.sum()))
        yield from _table([(_SHARD, 0, shard, part.column(0).to_pylist(), _planes(of), vocabulary.tobytes(), sizes.tobytes(), None)]).to_batches()
        shard += 1


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first: the high bytes are nearly all alike and pack well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _values(kind: int, raw: bytes) -> np.ndarray:
    return unpack_counts(raw) if kind % 10 == _COUNT else np.frombuffer(raw, np.float64)


def _raw(kind: int, values: np.ndarray) -> bytes:
    return pack_counts(values) if kind % 10 == _COUNT else values.astype(np.float64).tobytes()


class Shard:
    """A shard's texts with the totals that it has got so far."""

    def __init__(self, table: pa.Table, settings: dict):
        self.depth, self.min_count, self.min_gain = settings["depth"], settings["min_count"], settings["min_gain"]
        self.settings = settings
        kind = table["kind"].to_pylist()
        home = table.slice(kind.index(_SHARD), 1)
        self.chunk = home["chunk"][0].as_py()
        self.ids = home["ids"][0].as_py()
        self.of = _from_planes(home["a"][0].as_py())
        self.vocabulary = np.frombuffer(home["b"][0].as_py(), np.uint64)
        self.sizes = np.frombuffer(home["c"][0].as_py(), np.uint32).astype(np.int64)
        self.train_doc = in_training(self.ids, settings["folds"])
        self.train = np.repeat(self.train_doc, self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.offset = np.arange(len(self.of)) - np.repeat(starts, self.sizes)
        self.got: dict[int, list] = {}
        for k, b, x, y in sorted(zip(kind, table["bucket"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()), key=lambda r: r[:2]):
            if k >= 10 or k == _COUNT:
                self.got.setdefault(k, []).append((x, y))
        self.levels: dict[int, dict] = {}

    def totals(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [(_values(kind, x), y) for x, y in self.got.get(kind, [])]
        if not parts:
            return np.zeros(0), np.zeros(0, bool)
        own = np.concatenate([np.unpackbits(np.frombuffer(y, np.uint8), count=len(x)) for x, y in parts])
        return np.concatenate([x for x, _ in parts]).astype(np.float64), own.astype(bool)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and how often training texts here hold them."""
        return self.vocabulary, np.bincount(self.of[self.train], minlength=len(self.vocabulary))

    def level(self, d: int) -> dict:
        """Positions with a candidate context of d words; their distinct grams and contexts."""
        if d in self.levels:
            return self.levels[d]
        if d == 0:
            counts = self.totals(_COUNT)[0][self.of] if _COUNT in self.got else None
            self.levels[0] = {"number": self.of.astype(np.int64), "size": len(self.vocabulary), "keys": self.vocabulary, "counts": counts}
            return self.levels[0]
        below = self.level(d - 1)
        at = np.flatnonzero(self.offset >= d)
        n = below["counts"][at - 1]
        at, n = at[n >= self.min_count], n[n >= self.min_count]
        context = below["number"][at - 1]
        code = context * len(self.vocabulary) + self.of[at]
        order = order_of(code, int(below["size"] * len(self.vocabulary)).bit_length())
        new = np.diff(code[order], prepend=-1) != 0
        of = np.empty(len(code), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[new]  # a position of each distinct gram
        keys = mix((below["keys"][context[one]] * GOLD) ^ mix(self.vocabulary[self.of[at[one]]] + np.uint64(d)))
        # Grams in the order of their keys, as the buckets answer.
        rank = order_of(keys >> np.uint64(24), 40)
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        of, one, keys = back[of], one[rank], keys[rank]
        seen = np.zeros(below["size"], bool)
        seen[context] = True
        contexts = np.flatnonzero(seen)
        slot = np.zeros(below["size"], np.int64)
        slot[contexts] = np.arange(len(contexts))
        # A word that no other shard holds has all its grams here: nothing to ask.
        alone = self.totals(_COUNT)[1][self.of[at[one]]]
        trained = np.bincount(of[self.train[at]], minlength=len(keys))
        out = {"at": at, "n": n, "keys": keys, "ask": ~alone, "first": one, "of": of, "contexts": below["keys"][contexts], "context_of": slot[context], "trained": trained}
        if 10 * d + _COUNT in self.got or alone.all():
            out["total"], out["own"] = trained.astype(np.float64), alone.copy()
            out["total"][~alone], out["own"][~alone] = self.totals(10 * d + _COUNT)
            if d < self.depth:
                out["number"] = np.zeros(len(self.of), np.int64)
                out["number"][at] = of
                out["size"] = max(1, len(keys))
                out["counts"] = np.zeros(len(self.of))
                out["counts"][at] = out["total"][of]
        self.levels[d] = out
        return out

    def counts_asked(self, d: int):
        x = self.level(d)
        return x["keys"][x["ask"]], x["trained"][x["ask"]]

    def distinct_asked(self, d: int):
        x = self.level(d)
        mine = x["own"] & (x["total"] > 0)
        return x["contexts"], np.bincount(x["context_of"][x["first"][mine]], minlength=len(x["contexts"])).astype(np.float64)

    def gains_asked(self, d: int):
        """The log-likelihood that contexts gain over their suffixes, each occurrence left out in turn."""
        x = self.level(d)
        mine = x["own"] & (x["total"] > 0)
        first = x["first"][mine]
        c, n = x["total"][mine], x["n"][first]
        distinct = self.totals(10 * d + _DISTINCT)[0][x["context_of"][first]]
        below = self.probabilities(d - 1)[x["at"][first]] if d > 1 else self.base(self.of[x["at"][first]])
        rest = distinct - (c == 1)
        gain = c * (np.log(np.maximum(c - 1 + rest * below, 1e-300)) - np.log(n - 1 + rest) - np.log(below))
        return x["contexts"], np.bincount(x["context_of"][first], gain, len(x["contexts"]))

    def base(self, words: np.ndarray) -> np.ndarray:
        """Probabilities without a context, of words by their numbers."""
        s = self.settings
        return ((self.totals(_COUNT)[0] + ALPHA) / (s["tokens"] + ALPHA * (s["distinct"] + 1)))[words]

    def probabilities(self, d: int, base: np.ndarray | None = None) -> np.ndarray:
        """Of every token, by the longest state of at most d words; ``base`` is changed."""
        p = self.base(self.of) if base is None else base
        for k in range(1, d + 1):
            x = self.level(k)
            if not len(x["at"]):
                break
            state = (self.totals(10 * k + _GAIN)[0] >= self.min_gain)[x["context_of"]]
            at = x["at"][state]
            distinct = self.totals(10 * k + _DISTINCT)[0][x["context_of"][state]]
            p[at] = (x["total"][x["of"][state]] + distinct * p[at]) / (x["n"][state] + distinct)
        return p

    def scores(self) -> pa.Table:
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        add = lambda v: np.bincount(doc, v, len(self.sizes))
        known = (self.totals(_COUNT)[0] > 0)[self.of]
        p = self.base(self.of)
        base_score = add(np.log10(p))
        return pa.table({
            "id": pa.array(self.ids, pa.int64()), "held_out": pa.array(~self.train_doc), "n_tokens": pa.array(self.sizes),
            "n_known": pa.array(add(known).astype(np.int64)), "base_score": pa.array(base_score),
            "score": pa.array(add(np.log10(self.probabilities(self.depth, p)))),
        })


def _asking(wanted: list[tuple[int, str, int]], buckets: int, settings: dict):
    """A shard's rows of the wanted kinds: (kind, what to ask, level)."""

    def kernel(key, table):
        shard, rows = Shard(table, settings), []
        for kind, ask, d in wanted:
            keys, values = getattr(shard, ask)(*[d] * (ask != "words"))
            keys = keys >> np.uint64(8)
            cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
            rows += [(kind, b, shard.chunk, None, pack_keys(keys[i:j], bucket_start(b, buckets)), _raw(kind, values[i:j]), None, None) for b, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
        out = _table(rows)
        del shard
        give_back(collect=False)
        return out

    return kernel


def _totalling(key, table):
    """One bucket of one kind: totals of its keys, for every shard that asked, and who came first;
    of words instead, whether one shard alone asked."""
    kind, bucket = key[0].as_py(), key[1].as_py()
    rows = sorted(zip(table["chunk"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()))
    keys = [unpack_keys(a) for _, a, _ in rows]
    ends = np.cumsum([len(k) for k in keys])
    every, values = np.concatenate(keys), np.concatenate([_values(kind, b) for _, _, b in rows]).astype(np.float64)
    order = order_of(every, 48)
    new = np.concatenate([[True], np.diff(every[order]) != 0])
    group = np.cumsum(new) - 1
    sums = np.bincount(group, values[order])
    total, own = np.empty(len(every)), np.zeros(len(every), np.uint8)
    total[order] = sums[group]
    if kind == _COUNT:
        own[order] = (np.bincount(group) == 1)[group]
    else:
        own[order[new]] = 1
    out = [(kind, bucket, c, None, _raw(kind, total[e - len(k) : e]), np.packbits(own[e - len(k) : e]).tobytes(), None, None) for (c, _, _), k, e in zip(rows, keys, ends)]
    if kind == _COUNT:
        out.append((_TOTALS, bucket, -1, [int(sums.sum()), int((sums > 0).sum())], None, None, None, None))
    return _table(out)


def _scoring(settings: dict):
    def kernel(key, table):
        out = Shard(table, settings).scores()
        give_back(collect=False)
        return out

    return kernel


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN, folds: int = FOLDS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    own = only(docs, id, text).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    buckets = max(LEAST_BUCKETS, 2 * shuffle_parts(own.sparkSession))
    settings = {"depth": depth, "min_count": min_count, "min_gain": min_gain, "folds": folds, "tokens": 0, "distinct": 0}
    shards = materialize(own.mapInArrow(thrifty(_shards), _ROW), "shards")
    known: list[DataFrame] = []

    def with_known() -> DataFrame:
        out = shards
        for k in known:
            out = out.unionByName(k.where(F.col("chunk") >= 0))
        return out.groupBy("chunk")

    def exchange(wanted: list[tuple[int, str, int]]) -> None:
        known.append(materialize(with_known().applyInArrow(_asking(wanted, buckets, settings), _ROW).groupBy("kind", "bucket").applyInArrow(_totalling, _ROW), "totals"))

    exchange([(_COUNT, "words", 0)])
    sums = known[0].where(F.col("kind") == _TOTALS).agg(F.sum(F.col("ids")[0]), F.sum(F.col("ids")[1])).first()
    settings["tokens"], settings["distinct"] = sums[0] or 0, sums[1] or 0
    for step in range(1, depth + 3):
        wanted = [(10 * step + _COUNT, "counts_asked", step), (10 * (step - 1) + _DISTINCT, "distinct_asked", step - 1), (10 * (step - 2) + _GAIN, "gains_asked", step - 2)]
        exchange([w for w in wanted if 1 <= w[2] <= depth])
    out = materialize(with_known().applyInArrow(_scoring(settings), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    for x in (shards, *known):
        drop(x)
    return out.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(settings["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
