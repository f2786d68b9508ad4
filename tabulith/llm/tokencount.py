"""Token counts behind a digest cache.

Texts are reduced to a digest of their normalised content; digests are joined with the counts
that a cache table already holds for the same tokenizer version, only the distinct misses are
encoded, and their counts are appended to the cache.

Normalising collapses runs of ASCII white space and trims, which cannot change a count of a
tokenizer that drops white space. Encoding splits a text at ASCII white space, where such a
tokenizer always splits, and asks the library once for every distinct stretch. A tokenizer that
keeps white space is found out by a few probes: its texts are digested and encoded as they are.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
rows each keep their own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import in_worker, materialize, only, path_exists, scratch, text_slices, thrifty


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether ASCII white space only parts words for this tokenizer: probes of all its characters."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    ids = lambda t: tk.encode(t, add_special_tokens=False).ids
    plain = ids("ab cd")
    return all(ids(t) == plain for c in " \t\n\r\x0b\x0c" for t in (f"ab{c}cd", f"ab {c}cd", f"ab{c}{c}cd", f"{c}ab cd", f"ab cd{c}")) and plain == ids("ab") + ids("cd")


def content_digest(text: F.Column, normal: bool = True) -> F.Column:
    text = F.coalesce(text, F.lit(""))
    return F.sha2(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")) if normal else text, 256)


def chunk_counter(path: str, limit: int = 400_000):
    """Function: list of stretches without ASCII white space -> token counts.

    A stretch seen before costs a dictionary look-up; the memory of stretches is emptied at
    ``limit``. New ones go to the library side by side, with spaces between them, and their tokens
    are told apart by offsets. Stretches that could hold an added token's string are whole here as
    well, since such strings hold no white space.
    """
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    known: dict[bytes, int] = {}

    def count(stretches: list[bytes]) -> np.ndarray:
        if len(known) > limit:
            known.clear()
        new = [s for s in set(stretches) if s not in known]
        for at in range(0, len(new), 200):
            part = [x.decode() for x in new[at : at + 200]]
            e = tk.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(x) + 1 for x in part])
            of = np.searchsorted(ends, np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0], side="right")
            known.update(zip(new[at : at + 200], np.bincount(of, minlength=len(part)).tolist()))
        return np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))

    return count


def _encode(path: str, normal: bool):
    def kernel(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if not normal:
            from tokenizers import Tokenizer

            tk = in_worker(f"tokenizer {path}", lambda: Tokenizer.from_file(path))
            for part, texts in text_slices(batches):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(tk.encode(t.decode(), add_special_tokens=False)) for t in texts], pa.int64())], names=["digest", "n_tokens"])
            return
        count = in_worker(f"count {path}", lambda: chunk_counter(path))
        for part, texts in text_slices(batches):
            pieces = [t.split() for t in texts]
            sizes = np.array([len(p) for p in pieces])
            sums = np.concatenate([[0], np.cumsum(count([w for p in pieces for w in p]))])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[ends] - sums[ends - sizes])], names=["digest", "n_tokens"])

    return kernel


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, n_bytes, n_tokens). ``cache``: folder of the cache table, kept between calls; by
    default a new one in the shared folder, for this process alone."""
    spark = docs.sparkSession
    version, normal = tokenizer_version(tokenizer), drops_white_space(tokenizer)
    cache = cache or scratch(spark, "token-cache")
    own = only(docs, id, text).withColumnsRenamed({id: "id", text: "text"})
    digests = materialize(
        own.select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), content_digest(F.col("text"), normal).alias("digest")),
        "digests",
    )
    texts = own.select(content_digest(F.col("text"), normal).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    if path_exists(spark, cache):
        stored = spark.read.parquet(cache).where(F.col("tokenizer") == version).select("digest")
        missing = digests.select("digest").distinct().join(stored, "digest", "left_anti")
        texts = texts.join(missing, "digest", "left_semi")
    # One text for each digest, combined before the shuffle, so many copies of one text travel once a task.
    distinct = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
    counted = distinct.mapInArrow(thrifty(_encode(tokenizer, normal)), "digest string, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    stored = spark.read.parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(stored, "digest", "left").select(F.col("id").alias(id), "n_bytes", "n_tokens")
