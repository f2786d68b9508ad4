"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, which a forward pass gives; a text's is
the product over its words. Distributions are fitted by expectation maximisation over the same
lattices, on a bounded sample of labelled texts.

Words are lower-cased and lose ASCII digits and punctuation. A character that no piece covers
counts as one piece of a fixed small probability, alike for every language. The score is the best
language's share of the likelihood of the text's average word, so that it tells how clear a text
is whatever its length. ``keep_known`` asks besides that the likelihood of the average letter is
not far below what labelled texts of the language have, which foreign texts and gibberish miss.

Defined results: ``und`` with score 0 for a null text or one without a letter; ties between
languages go to the first by name; an empty table gives no rows; a table without labelled texts
gives ``und`` for all; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import only, text_slices, thrifty

#: Labelled texts of each language that are learned from, about (rows are chosen by a hash of their id).
SAMPLE_TEXTS = 1500
#: Share of a language's labelled texts that may lie below its floor, and nats a letter that the floor lies lower.
FLOOR_SHARE, FLOOR_MARGIN = 0.02, 1.0
ITERATIONS = 3
UNKNOWN = 1e-7
START = "▁"

_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def scored(word: bytes) -> str:
    """A raw word as the string that is scored; without a letter, none."""
    s = word.decode().lower()
    return START + s if any(map(str.isalpha, s)) else ""


class Pieces:
    """The vocabulary as a hash table over character sequences, looked up for many at once."""

    PRIME = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.names = sorted(p for p in names if p)
        self.longest = max(map(len, self.names))
        keys = np.zeros(len(self.names), np.uint64)
        for n, p in enumerate(self.names):
            k = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    k = (k + np.uint64(ord(c) + 1)) * self.PRIME
            keys[n] = k
        self.bits = np.uint64(64 - 18)
        self.table_key = np.zeros(1 << 18, np.uint64)
        self.table_id = np.full(1 << 18, -1, np.int32)
        for n, k in enumerate(keys):
            at = int(k >> self.bits)
            while self.table_id[at] >= 0:
                at = (at + 1) % (1 << 18)
            self.table_key[at], self.table_id[at] = k, n
        run, self.probe = 0, 1
        for filled in np.concatenate([self.table_id, self.table_id[:64]]) >= 0:
            run = run + 1 if filled else 0
            self.probe = max(self.probe, run)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for what is no piece."""
        at = (keys >> self.bits).astype(np.int64)
        out = np.where(self.table_key[at] == keys, self.table_id[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.table_id[at] >= 0))
        for step in range(1, self.probe + 1):
            if not len(open_):
                break
            a = (at[open_] + step) % len(self.table_id)
            hit = self.table_key[a] == keys[open_]
            out[open_[hit]] = self.table_id[a[hit]]
            open_ = open_[~hit & (self.table_id[a] >= 0)]
        return out

    def lattice(self, words: list[str], length: int):
        """(from, to, piece of each word) of every span of the words, all of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)
        for i in range(length):
            key = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                key = (key + codes[:, j - 1]) * self.PRIME
                piece = self.find(key)
                if j == i + 1 or (piece >= 0).any():
                    yield i, j, piece


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def forward(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word) for every word and language; ``table`` is piece by language, last row the unknown."""
    out = np.zeros((len(words), table.shape[1]))
    for length, places in _by_length(words).items():
        for a in range(0, len(places), 20_000):
            part = places[a : a + 20_000]
            alpha = np.zeros((length + 1, len(part), table.shape[1]))
            alpha[0] = 1
            scale = np.zeros((len(part), 1))
            at = 0
            for i, j, piece in pieces.lattice([words[p] for p in part], length):
                if i != at:  # all that ends at i is summed: keep what follows in range
                    at = i
                    top = alpha[i].max(axis=1, keepdims=True)
                    scale += np.log(top)
                    alpha[i : i + pieces.longest] /= top
                if j == i + 1:
                    alpha[j] += alpha[i] * table[piece]
                else:
                    hit = np.flatnonzero(piece >= 0)
                    alpha[j][hit] += alpha[i][hit] * table[piece[hit]]
            out[part] = np.log(alpha[length]) + scale
    return out


def expected(pieces: Pieces, probs: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, by forward and backward sums."""
    total = np.zeros(len(probs))
    for length, places in _by_length(words).items():
        for a in range(0, len(places), 20_000):
            part = places[a : a + 20_000]
            edges = [(i, j, p) for i, j, p in pieces.lattice([words[x] for x in part], length)]
            # Sums are kept in range: alpha[i] and beta[i] stand for exp(up[i]) and exp(down[i]) times themselves.
            alpha = np.zeros((length + 1, len(part)))
            beta = np.zeros((length + 1, len(part)))
            up, down = np.zeros((length + 1, len(part))), np.zeros((length + 1, len(part)))
            alpha[0] = beta[length] = 1
            chance = lambda i, j, p: np.where(p >= 0, probs[p], UNKNOWN if j == i + 1 else 0)
            into: dict[int, list] = {}
            out_of: dict[int, list] = {}
            for i, j, p in edges:
                into.setdefault(j, []).append((i, p))
                out_of.setdefault(i, []).append((j, p))
            for j in range(1, length + 1):
                up[j] = up[j - 1]
                alpha[j] = sum(alpha[i] * np.exp(up[i] - up[j]) * chance(i, j, p) for i, p in into[j])
                up[j] += np.log(alpha[j])
                alpha[j] = 1
            for i in range(length - 1, -1, -1):
                down[i] = down[i + 1]
                beta[i] = sum(beta[j] * np.exp(down[j] - down[i]) * chance(i, j, p) for j, p in out_of[i])
                down[i] += np.log(beta[i])
                beta[i] = 1
            for i, j, p in edges:
                hit = p >= 0
                share = np.exp(up[i] + down[j] - up[length]) * probs[p] * weights[part]
                total += np.bincount(p[hit], share[hit], len(total))
    return total


def _count_words(batches):
    for part, texts in text_slices(batches):
        counts: dict[tuple[str, bytes], int] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts):
            for w in text.translate(_TABLE).split():
                counts[lang, w] = counts.get((lang, w), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([counts[k] for k in keys], pa.int64())],
            names=["lang", "word", "n"],
        )


class Model:
    def __init__(self, languages: list[str], pieces: Pieces | None, table: np.ndarray | None, floors: dict[str, float] | None = None):
        self.languages, self.pieces, self.table, self.floors = languages, pieces, table, floors or {}


def fit(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", id: str = "doc_id", sample_texts: int = SAMPLE_TEXTS, iterations: int = ITERATIONS) -> Model:
    """Learn from about ``sample_texts`` rows of each language, chosen by a hash of their id."""
    own = only(labelled, id, text, lang).withColumnsRenamed({id: "id", text: "text", lang: "lang"}).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], None, None)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_texts / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    sample = own.where(F.coalesce(draw < share[F.col("lang")], F.lit(False))).select("lang", "text")
    counts = sample.mapInArrow(thrifty(_count_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    pieces = Pieces(vocabulary)
    by = {k: ([], []) for k in languages}
    for k, w, n in zip(got["lang"].to_pylist(), got["word"].to_pylist(), got["n"].to_pylist()):
        if s := scored(w):
            by[k][0].append(s)
            by[k][1].append(n)
    table = np.full((len(pieces.names) + 1, len(languages)), UNKNOWN)  # piece -1 is the last row
    for c, k in enumerate(languages):
        probs = np.full(len(pieces.names), 1 / len(pieces.names))
        for _ in range(iterations):
            used = expected(pieces, probs, by[k][0], np.array(by[k][1], float))
            probs = (used + 0.01) / (used.sum() + 0.01 * len(used))
        table[:-1, c] = probs
    model = Model(languages, pieces, table)
    letters = lambda part, names, score, letter: pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(letter)], names=["lang", "found", "letter"])
    own = sample.mapInArrow(thrifty(_predict(model, letters)), "lang string, found string, letter double").where("lang = found")
    low = own.groupBy("lang").agg(F.percentile_approx("letter", FLOOR_SHARE).alias("low")).collect()
    model.floors = {r["lang"]: r["low"] - FLOOR_MARGIN for r in low}
    return model


def _predict(model: Model, use, text: str = "text", limit: int = 300_000):
    """Kernel that yields ``use(batch, languages, scores, log-likelihoods of the average letter)`` for every slice."""
    languages, pieces, table = model.languages, model.pieces, model.table

    def kernel(batches):
        number: dict[bytes, int] = {}
        logs = np.zeros((0, len(languages)))
        letters = np.zeros(0, np.int64)
        for part, texts in text_slices(batches, text):
            if len(number) > limit:
                number.clear()
                logs, letters = logs[:0], letters[:0]
            lists = [t.translate(_TABLE).split() for t in texts]
            flat = [w for x in lists for w in x]
            new = [w for w in dict.fromkeys(flat) if w not in number]
            if new:
                number.update(zip(new, range(len(logs), len(logs) + len(new))))
                strings = [scored(w) for w in new]
                owner = np.flatnonzero([bool(x) for x in strings])
                values = np.zeros((len(new), len(languages)))
                if len(owner):
                    values[owner] = forward(pieces, table, [strings[n] for n in owner])
                logs, letters = np.concatenate([logs, values]), np.concatenate([letters, np.array([len(x) for x in strings], np.int64)])
            at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            n_letters = np.bincount(doc, letters[at], len(lists))
            n_words = np.maximum(np.bincount(doc, letters[at] > 0, len(lists)), 1)[:, None]
            sums = np.stack([np.bincount(doc, logs[at, c], len(lists)) for c in range(len(languages))], axis=1)
            odds = np.exp((sums - sums.max(axis=1, keepdims=True)) / n_words)
            best = odds.argmax(axis=1)
            score = np.where(n_letters > 0, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            names = [languages[b] if ok else "und" for b, ok in zip(best, n_letters > 0)]
            yield use(part, names, score, sums.max(axis=1) / np.maximum(n_letters, 1))

    return kernel


def predict(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, lang_pred, score): the likeliest language and its share of the likelihood."""
    own = only(docs, id, text).withColumnsRenamed({id: "id", text: "text"})
    kind = own.schema["id"].dataType.simpleString()
    if not model.languages:
        return own.select(F.col("id").alias(id), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    row = lambda part, names, score, letter: pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
    return own.mapInArrow(thrifty(_predict(model, row)), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)


def keep_known(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a language whose score is ``least`` or more and whose letters are as likely as the language's floor asks; without a model, all."""
    if not model.languages:
        return docs
    floors = model.floors
    sure = lambda part, names, score, letter: part.filter(pa.array([n != "und" and s >= least and x >= floors.get(n, -np.inf) for n, s, x in zip(names, score, letter)], pa.bool_()))
    return docs.mapInArrow(thrifty(_predict(model, sure, text)), docs.schema)


def held_out(id: F.Column, folds: int) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(False))
