"""Exact Jaccard join of documents on sets of word 5-grams, and its classes.

1. Shards of text turn into sets of hashed 5-grams. Every 5-gram goes, with the sets of its shard
   that hold it, to one of many buckets, which count its sets. A 5-gram that a shard holds more
   than ``HOT`` times travels as one count, and its list stays with the shard.
2. 5-grams of one set alone are dropped; they can't be shared, and they come first in the order
   (frequency, hash) of all sets. A set whose own 5-grams fill the prefix that any link has to
   share needs no partner and is done. The others keep the rest of their 5-grams, which is enough
   to verify links exactly.
3. Prefixes are posted to index lists. Each list compares its members with one pivot, the member
   with the least of its own. A set's answers are then derived from a highly similar set's: what
   hangs on one pivot is one class, so only pairs of different classes remain, and of these only
   those that sizes, positions in the list and the overlaps with the pivot allow. Such bounds skip
   whole blocks of a list: entries carry size and position, and bounds need no words.
4. The pairs left are verified on their 5-grams; links become classes by connected components.

No pair inside a class is listed, so a group of n copies costs n comparisons. Defined results: a
document without words has an empty set, links with nothing and is its own class; fewer than five
words are one 5-gram; null ids sort last (a class of null ids alone has null); repeated rows each
get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import GOLD, LEAST_BUCKETS, bucket_of, bucket_start, drop, in_worker, materialize, mix, only, pack_keys, shuffle_parts, text_slices, thrifty, unpack_keys, word_hasher
from tabulith.llm.graph import components

SHINGLE = 5
#: Holders of one 5-gram in a shard from which it travels as a count.
HOT = 32
SHARD_BYTES, SHARD_ROWS = 3_000_000, 60_000
#: Pivots that lists are compared with, one after another, before pairs are listed.
PIVOT_ROUNDS = 2

_ROW = "bucket int, chunk long, kind int, ids array<long>, a binary, b binary, c binary, d binary, e binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5]
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_META, _POSTED, _HOT_LISTS = 0, 1, 2


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text: its distinct 5-gram hashes in order."""
    hashed = in_worker("word hashes", word_hasher)
    lists = [t.lower().split() for t in texts]
    sizes = [len(x) for x in lists]
    flat = np.fromiter((hashed(w) for x in lists for w in x), np.uint64, sum(sizes))
    n = max(0, len(flat) - size + 1)
    grams = flat[:n].copy()
    for k in range(1, size):
        grams *= GOLD
        grams ^= flat[k : n + k]
        grams = mix(grams)
    out, at = [], 0
    for words, k in zip(lists, sizes):
        if k >= size:
            out.append(np.unique(grams[at : at + k - size + 1]))
        elif k:
            g = np.array([k], np.uint64)
            for h in flat[at : at + k]:
                g = mix((g * GOLD) ^ h)
            out.append(g)
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def _post(buckets: int):
    """Shards of text to rows for the buckets."""

    def kernel(batches):
        import xxhash
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for part, texts in text_slices(batches, size=SHARD_BYTES, rows=SHARD_ROWS):
            number: dict[bytes, int] = {}
            sets, of = [], []
            for s in shingle_sets(texts):
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""
                k = number.setdefault(digest, len(number))
                if k == len(sets):
                    sets.append(s)
                of.append(k)
            ns = np.array([len(s) for s in sets], np.uint32)
            keys = np.concatenate(sets) >> np.uint64(8)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), ns)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            runs = np.diff(np.append(start, len(keys)))
            hot_runs = runs > HOT
            hot = np.repeat(hot_runs, runs)
            hot_keys, hot_counts = keys[start[hot_runs]], runs[hot_runs].astype(np.uint32)
            home = int(chunk * 2654435761 % 2**32 % buckets)
            rows = [
                (home, chunk, _META, part.column(0).to_pylist(), np.array(of, np.uint32).tobytes(), ns.tobytes(), b"".join(d.ljust(16, b"\0") for d in number), None, None),
                (home, chunk, _HOT_LISTS, None, hot_keys.tobytes(), hot_counts.tobytes(), owner[hot].tobytes(), None, None),
            ]
            keys, owner = keys[~hot], owner[~hot]
            ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
            hot_ends = np.searchsorted(bucket_of(hot_keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                i, j, p, q = int(ends[b]), int(ends[b + 1]), int(hot_ends[b]), int(hot_ends[b + 1])
                if i < j or p < q:
                    start = bucket_start(b, buckets)
                    rows.append((b, chunk, _POSTED, None, pack_keys(keys[i:j], start), owner[i:j].tobytes(), pack_keys(hot_keys[p:q], start), hot_counts[p:q].tobytes(), None))
            chunk += 1
            yield from _table(rows).to_batches()

    return kernel


def _column(table: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's arrays end to end, and their lengths; without a type, of packed hashes."""
    values = [unpack_keys(x or b"") if dtype is None else np.frombuffer(x or b"", dtype) for x in table[name].to_pylist()]
    dtype = dtype or np.uint64
    return np.concatenate(values) if values else np.zeros(0, dtype), np.array([len(v) for v in values], np.int64)


def _count(key, table):
    """One bucket: how many sets hold each 5-gram; those of two sets or more go back."""
    kind = np.array(table["kind"].to_pylist())
    through = table.filter(pa.array(kind != _POSTED))
    posted = table.filter(pa.array(kind == _POSTED))
    if not posted.num_rows:
        return through
    chunks = np.array(posted["chunk"].to_pylist(), np.int64)
    keys, n = _column(posted, "a", None)
    owner, _ = _column(posted, "b", np.uint16)
    hot, hot_n = _column(posted, "c", None)
    hot_count, _ = _column(posted, "d", np.uint32)
    every = np.concatenate([keys, hot])
    weight = np.concatenate([np.ones(len(keys), np.int64), hot_count.astype(np.int64)])
    order = np.argsort(every, kind="stable")
    first = np.concatenate([[True], np.diff(every[order]) != 0])
    group = np.cumsum(first) - 1
    total = np.bincount(group, weight[order]).astype(np.int64)
    df = np.empty(len(every), np.uint16)
    df[order] = np.minimum(total[group], 2**16 - 1)  # the order of sets' members needs no more
    df, hot_df = df[: len(keys)], df[len(keys) :]
    keep = df > 1
    row = np.repeat(np.arange(len(chunks)), n)
    ends = np.cumsum(np.bincount(row[keep], minlength=len(chunks)))
    keys, owner, df = keys[keep], owner[keep], df[keep]
    hot_ends = np.cumsum(hot_n)
    rows, i, p, none = [], 0, 0, np.uint64(0)
    for c, j, q in zip(chunks, ends, hot_ends):
        if i < j or p < q:
            rows.append((int(key[0].as_py()), int(c), _POSTED, None, pack_keys(keys[i:j], none), owner[i:j].tobytes(), df[i:j].tobytes(), pack_keys(hot[p:q], none), hot_df[p:q].tobytes()))
        i, p = j, q
    return pa.concat_tables([through.cast(_table([]).schema), _table(rows)])


def prefix_length(n):
    """Members of a set of n, in order, of which any linked set shares one: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


_SETS = "id long, sid binary, n int, keys array<long>"


def _assemble(buckets: int):
    return lambda key, table: _shard_sets(table, buckets)


def _shard_sets(table: pa.Table, buckets: int) -> pa.Table:
    """One shard: its documents, and the sets that may have a link, with their shared 5-grams."""
    kind = np.array(table["kind"].to_pylist())
    meta = table.filter(pa.array(kind == _META))
    of = np.frombuffer(meta["a"][0].as_py(), np.uint32)
    ns = np.frombuffer(meta["b"][0].as_py(), np.uint32).astype(np.int64)
    digests = meta["c"][0].as_py()
    posted = table.filter(pa.array(kind == _POSTED))
    start = np.array([bucket_start(b, buckets) for b in posted["bucket"].to_pylist()], np.uint64)
    keys, n = _column(posted, "a", None)
    keys = keys + np.repeat(start, n)
    owner, _ = _column(posted, "b", np.uint16)
    df, _ = _column(posted, "c", np.uint16)
    hot, n = _column(posted, "d", None)
    hot = hot + np.repeat(start, n)
    hot_df, _ = _column(posted, "e", np.uint16)
    lists = table.filter(pa.array(kind == _HOT_LISTS))
    local, _ = _column(lists, "a", np.uint64)
    count, _ = _column(lists, "b", np.uint32)
    members, _ = _column(lists, "c", np.uint16)
    if len(local):
        at = np.argsort(hot)
        their_df = hot_df[at][np.searchsorted(hot[at], local)]
        keys = np.concatenate([keys, np.repeat(local, count)])
        owner = np.concatenate([owner, members])
        df = np.concatenate([df, np.repeat(their_df, count)])
    order = np.lexsort((keys, df, owner))
    keys, owner = keys[order].view(np.int64), owner[order]
    shared = np.bincount(owner, minlength=len(ns))
    ends = np.cumsum(shared)
    alive = (ns > 0) & (ns - shared < prefix_length(ns))
    sid = [digests[16 * k : 16 * k + 16] if ns[k] else None for k in range(len(ns))]
    docs = pa.table({
        "id": meta["ids"][0].values, "sid": pa.array([sid[k] for k in of], pa.binary()), "n": pa.array(ns[of], pa.int32()),
        "keys": pa.nulls(len(of), pa.list_(pa.int64())),
    })
    some = np.flatnonzero(alive)
    sets = pa.table({
        "id": pa.nulls(len(some), pa.int64()), "sid": pa.array([sid[k] for k in some], pa.binary()), "n": pa.array(ns[some], pa.int32()),
        "keys": pa.array([keys[ends[k] - shared[k] : ends[k]] for k in some], pa.list_(pa.int64())),
    })
    return pa.concat_tables([docs, sets])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sizes and their overlap."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ka", "kb")).alias("o"))


_LINKED = "9 * o >= 4 * (na + nb)"  # o / (na + nb - o) >= 0.8


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that have the components of all links between the sets."""
    posts = materialize(
        sets.select("sid", "n", (F.col("n") - F.size("keys")).alias("own"), F.posexplode(F.expr("slice(keys, 1, n - (4 * n + 4) div 5 + 1 - (n - size(keys)))")).alias("at", "key"))
        .select("key", "sid", "n", "own", (F.col("own") + F.col("at")).cast("int").alias("pos"), F.col("sid").alias("c")),
        "postings",
    )
    found = overlaps = None
    for round_ in range(PIVOT_ROUNDS):
        # A list's pivot: first the member with the least of its own, then any.
        rank = F.expr("own * 1000000L div n") if round_ == 0 else F.xxhash64("sid", F.lit(round_))
        pivots = posts.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("sid").alias("pivot"), F.col("n").alias("pn"), F.col("c").alias("pc"))).alias("p")).select("key", "p.*")
        # Of the pivots that a set meets, it is compared with the one that it meets in most lists.
        met = posts.join(pivots, "key").where("c != pc and 5 * least(n, pn) >= 4 * greatest(n, pn)").groupBy("sid", "pivot").agg(F.count("*").alias("k"))
        pairs = met.groupBy("sid").agg(F.max(F.struct("k", "pivot")).alias("best")).select(F.col("sid").alias("a"), F.col("best.pivot").alias("b"))
        seen = materialize(_verified(pairs, sets), "overlaps")
        overlaps = seen if overlaps is None else overlaps
        new = seen.where(_LINKED).select("a", "b")
        found = new if found is None else found.unionByName(new)
        label = components(found).select(F.col("node").alias("sid"), "root")
        # Lists of one class have nothing more to say.
        last, now = posts, posts.drop("c").join(label, "sid", "left").withColumn("c", F.coalesce("root", "sid")).drop("root")
        now = materialize(now, "labelled")
        open_ = now.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("key")
        posts = materialize(now.join(open_, "key", "left_semi"), "open-postings")
        drop(last)
        drop(now)
    # What is left: pairs of different classes that the bounds allow.
    with_pivot = posts.join(overlaps.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "o"), "sid", "left")
    side = lambda a, n, i, c, p, o: with_pivot.select("key", F.col("sid").alias(a), F.col("n").alias(n), F.col("pos").alias(i), F.col("c").alias(c), F.col("pivot").alias(p), F.col("o").alias(o))
    small = side("a", "na", "i", "ca", "pa", "oa").where("i <= na - (8 * na + 8) div 9")
    large = side("b", "nb", "j", "cb", "pb", "ob")
    need = "4 * (na + nb)"
    allowed = (
        "ca != cb and 5 * na >= 4 * nb and (na < nb or (na = nb and a < b))"
        f" and 9 * least(na - i, nb - j) >= {need}"
        f" and (pa is null or pb is null or pa != pb or 9 * (least(oa, ob) + least(na - oa, nb - ob)) >= {need})"
    )
    # What both have in common up to their last common place in the prefixes, and at most beyond it.
    pairs = small.join(large, "key").where(allowed).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.max("i").alias("i"), F.max("j").alias("j"))
    pairs = pairs.where(f"9 * (k + least(na - i, nb - j) - 1) >= {need}").select("a", "b")
    rest = materialize(_verified(pairs, sets).where(_LINKED).select("a", "b"), "late-links")
    drop(posts)
    return found.unionByName(rest)


def jaccard_classes(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, n_shingles, component_id): each document with the least id of its class."""
    own = only(docs, id, text).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    buckets = max(LEAST_BUCKETS, 4 * shuffle_parts(own.sparkSession))
    posted = own.mapInArrow(thrifty(_post(buckets)), _ROW)
    counted = posted.groupBy("bucket").applyInArrow(_count, _ROW)
    both = materialize(counted.groupBy("chunk").applyInArrow(_assemble(buckets), _SETS), "shingle-sets")
    sets = materialize(both.where("keys is not null").select("sid", "n", "keys").dropDuplicates(["sid"]), "live-sets")
    members = both.where("keys is null").select("id", "sid", "n")
    found = links(sets)
    least = members.where("sid is not null").groupBy("sid").agg(F.min("id").alias("least"))
    roots = components(found).select(F.col("node").alias("sid"), "root")
    by_root = least.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    least = by_root.join(lowest, "root").select("sid", "component_id")
    return members.join(least, "sid", "left").select(
        F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its class, one row where rows are repeated."""
    classes = jaccard_classes(docs, text, id).select(F.col(f"`{id}`").alias("__id"), (F.col(f"`{id}`").eqNullSafe(F.col("component_id"))).alias("__first"))
    by_id = materialize(classes.groupBy("__id").agg(F.max("__first").alias("__first"), (F.count("*") > 1).alias("__again")), "first-of-class")
    same = F.col(f"`{id}`").eqNullSafe(F.col("__id"))
    if by_id.where("__first and __again").isEmpty():
        return docs.join(by_id.where("not __first"), same, "left_anti")
    once = docs.join(by_id.where("not __first or __again"), same, "left_anti")
    return once.unionByName(docs.join(by_id.where("__first and __again"), same, "left_semi").dropDuplicates([id, text]))
