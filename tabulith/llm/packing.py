"""Best-fit packing of token sequences by hierarchical residual packing.

Texts are encoded, a separator is added, and only documents longer than a sequence are cut: the
first piece takes the remainder, so all later ones are full. Every partition packs its own pieces
best-fit, largest first, and emits the bins that are full enough. The rest climbs a tree: groups
of neighbouring nodes merge, their underfull bins are items of a further best-fit round, until
one root is left.

A bin climbs if it is underfull and could hold, or be held beside, the emptiest underfull bin of
all; what climbs is 16 bytes a bin and a member. Bins that nothing fits are done where they are.
After a best-fit round no two bins of a node fit together, so at most one of them is half full or
less, and others climb only as far as such small bins leave them a partner.

Defined results: a null text counts as empty and gives one piece, the separator alone; a null id
stays null; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import in_worker, materialize, only, text_slices, thrifty

CAPACITY = 2048
SEPARATOR = 0
FAN_IN = 8
#: A bin with this share of the capacity or less left is full enough.
SLACK = 1 / 256


def encoder(path: str, limit: int = 300_000):
    """Function: texts (bytes) -> their ids as little-endian unsigned 32-bit bytes, as the library gives.

    Byte-level BPE merges within the stretches of its splitting pattern alone, so each distinct
    stretch is encoded by the library once and then looked up. New stretches go to the library side
    by side: one that starts with a space and holds no other white space is split off again there.
    Added tokens are cut out first, as the library does.
    """
    import re

    import regex
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    added = {t.content: int(i).to_bytes(4, "little") for i, t in tk.get_added_tokens_decoder().items()}
    marks = regex.compile("(" + "|".join(regex.escape(t) for t in added) + ")") if added else None
    split = regex.compile(PATTERN).findall
    # The same pattern for the faster engine, on texts of characters that both class alike.
    unlike = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]").search
    split_plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    known: dict[str, bytes] = {}

    def learn(new: list[str]) -> None:
        joined = []
        for s in new:
            if s[0] == " " and len(s) > 1 and not s[1].isspace():
                joined.append(s)
            else:
                known[s] = np.array(tk.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        for at in range(0, len(joined), 400):
            part = joined[at : at + 400]
            e = tk.encode("".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))).tolist()
            known.update((s, ids[i:j]) for s, i, j in zip(part, ends, ends[1:]))

    def encode(texts: list[bytes]) -> list[bytes]:
        if len(known) > limit:
            known.clear()
        lists = []
        for t in texts:
            s = t.decode()
            if marks is not None and b"<|" in t:
                lists.append([y for x in marks.split(s) if x for y in ([x] if x in added else split(x))])
            else:
                lists.append(split(s) if unlike(s) else split_plain(s))
        known.update(added)
        learn([s for s in set().union(*lists) if s not in known])
        return [b"".join(map(known.__getitem__, x)) for x in lists]

    return encode


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first one takes the remainder."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, largest first: the bin and the offset of each item, and how full each bin is."""
    open_: list[int] = []  # distinct free sizes, in order
    stacks: dict[int, list[int]] = {}
    fill: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        at = bisect_left(open_, n)
        if at < len(open_):
            free = open_[at]
            b = stacks[free].pop()
            if not stacks[free]:
                del stacks[free]
                open_.pop(at)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        free -= n
        if free:
            if free not in stacks:
                stacks[free] = []
                insort(open_, free)
            stacks[free].append(b)
    return bins, offsets, fill


def underfull(fill: list[int], capacity: int, slack: float) -> set[int]:
    """The bins that are not full enough."""
    return {b for b, f in enumerate(fill) if f < capacity * (1 - slack)}


_PIECES = "id long, piece int, start long, length long, ids_crc32 long, node long, bin long, offset long, bin_fill long, up boolean"


def _encode_and_pack(path: str, capacity: int, separator: int, slack: float):
    def kernel(batches):
        from array import array

        from pyspark import TaskContext

        encode, tail = in_worker(f"encode {path}", lambda: encoder(path)), int(separator).to_bytes(4, "little")
        # All pieces of the partition, as plain numbers: ids may be null.
        ids_, known, piece, start_, length, crc = array("q"), array("b"), array("i"), array("q"), array("q"), array("q")
        for part, texts in text_slices(batches, size=3_000_000):
            for i, ids in zip(part.column(0).to_pylist(), encode(texts)):
                ids += tail
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    ids_.append(i or 0)
                    known.append(i is not None)
                    piece.append(k)
                    start_.append(start)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * start : 4 * (start + n)]))
        node, sizes = TaskContext.get().partitionId(), length.tolist()
        bins, offsets, fill = best_fit(sizes, capacity)
        up = underfull(fill, capacity, slack)
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for a in range(0, len(sizes), 10_000):
            b = slice(a, a + 10_000)
            own = bins[b]
            arrays = [
                pa.array(np.array(ids_[b], np.int64), mask=np.array(known[b], np.int8) == 0), pa.array(np.array(piece[b], np.int32)),
                *[pa.array(np.array(x[b], np.int64)) for x in (start_, length, crc)], pa.array([node] * len(own), pa.int64()), pa.array(own, pa.int64()),
                pa.array(offsets[b], pa.int64()), pa.array([fill[x] for x in own], pa.int64()), pa.array([x in up for x in own]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kernel


_RESIDUAL = "node long, fill long, members array<struct<home:long,bin:long,at:long>>, up boolean"


def _merge(capacity: int, slack: float, least: int, last: bool):
    """One node's round: its bins are items; members keep where each first bin stands."""

    def kernel(key, table):
        fills, members = table["fill"].to_pylist(), table["members"].to_pylist()
        order = sorted(range(len(fills)), key=lambda i: (members[i][0]["home"], members[i][0]["bin"]))
        fills, members = [fills[i] for i in order], [members[i] for i in order]
        bins, offsets, fill = best_fit(fills, capacity)
        out: list[list[dict]] = [[] for _ in fill]
        for i, (b, at) in enumerate(zip(bins, offsets)):
            out[b] += [{"home": m["home"], "bin": m["bin"], "at": m["at"] + at} for m in members[i]]
        up = set() if last else {b for b in underfull(fill, capacity, slack) if fill[b] + least <= capacity}
        member = pa.list_(pa.struct([("home", pa.int64()), ("bin", pa.int64()), ("at", pa.int64())]))
        return pa.table({
            "node": pa.array([key[0].as_py()] * len(fill), pa.int64()), "fill": pa.array(fill, pa.int64()),
            "members": pa.array(out, member), "up": pa.array([b in up for b in range(len(fill))]),
        })

    return kernel


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, fan_in: int = FAN_IN, slack: float = SLACK, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece."""
    own = only(docs, id, text).withColumnsRenamed({id: "id", text: "text"}).withColumn("id", F.col("id").cast("long"))
    pieces = materialize(own.mapInArrow(thrifty(_encode_and_pack(tokenizer, capacity, separator, slack)), _PIECES), "pieces")
    top, least = pieces.agg(F.max("node"), F.min(F.when(F.col("up"), F.col("bin_fill")))).first()
    pieces = pieces.withColumn("up", F.col("up") & (F.col("bin_fill") + (least or 0) <= capacity))
    residual = (
        pieces.where("up and offset = 0")
        .select("node", F.col("bin_fill").alias("fill"), F.array(F.struct(F.col("node").alias("home"), "bin", F.lit(0).cast("long").alias("at"))).alias("members"))
    )
    nodes, done = (top or 0) + 1, []
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = residual.withColumn("node", F.expr(f"node div {fan_in}")).groupBy("node").applyInArrow(_merge(capacity, slack, least, nodes == 1), _RESIDUAL)
        level = materialize(level, "residuals")
        done.append(level.where("not up"))
        residual = level.where("up").drop("up")
    sequence = lambda node, bin: F.struct(node.alias("node"), bin.alias("bin"))
    if not done:
        return _result(pieces.select("*", F.col("node").alias("n"), F.col("bin").alias("b"), F.lit(0).cast("long").alias("at")), id)
    moved = done[0]
    for d in done[1:]:
        moved = moved.unionByName(d)
    # A sequence is named after the first bin of its first member.
    moved = (
        moved.select(F.col("members")[0]["home"].alias("n"), F.col("members")[0]["bin"].alias("b"), F.explode("members").alias("m"))
        .select("n", "b", F.col("m.home").alias("node"), F.col("m.bin").alias("bin"), F.col("m.at").alias("at"))
    )
    stay = pieces.where("not up").select("*", F.col("node").alias("n"), F.col("bin").alias("b"), F.lit(0).cast("long").alias("at"))
    climb = pieces.where("up").join(moved, ["node", "bin"])
    return _result(stay.unionByName(climb), id)


def _result(placed: DataFrame, id: str) -> DataFrame:
    return placed.select(
        F.col("id").alias(id), "piece", "start", "length", "ids_crc32",
        (F.col("n") * F.lit(1 << 32) + F.col("b")).alias("sequence_id"), (F.col("offset") + F.col("at")).alias("offset"),
    )
