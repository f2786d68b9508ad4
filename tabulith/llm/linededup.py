"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions alone.

Two lines are alike when their lower-cased words are equal, or when one turns into the other by
inserting, deleting or replacing at most a word for every full ``words_per_edit`` words of the
shorter one. A line is removed when a like line stands earlier, by document id and then line
number; blank lines are never removed, and lines of fewer than ``min_words`` words only if they are
equal. A like line counts as earlier whether it stays itself or not.

1. Equal lines meet by two hashes in one row with their earliest place.
2. Every line emits hashed keys of what is left of it when words are deleted, so that two lines
   within the bound always share a key:

   - a line that may have one edit emits all variants, with one word deleted, of the five words that
     come first in a fixed order of all words (longest first): two such lines share four of these;
   - a longer one is cut into chunks behind words that end in certain characters. An edit touches
     two chunks at most, so of lines within k edits all but 2 k chunks are common, and the 2 k + 1
     chunks that come first in a fixed order of all chunks (longest first) share one. Each is the
     variant that has all other chunks deleted;
   - a line with too few distinct chunks for that numbers its equal chunks, which come behind all
     distinct ones; one with too few chunks altogether emits its stretches that k edits could leave
     as they were, at all places. Two such lines share one of k + 1 equal segments.

3. Keys that one line alone emits are dropped. Lines of the others meet within classes of like
   length, the earliest of the class and neighbours in it first; those that are like none of these
   meet the others. Pairs whose lengths differ too much go at once, and those of which more bits
   differ than edits could turn over: every word turns over one of a line's 256 bits, and of further
   ones in long lines. Two lines that share many keys mostly meet in one of them alone.
4. Edits are verified on characters that stand for words, whose distance is never above that of the
   words and is that distance where a pair has as many of them as words; else on the words
   themselves. The text is rebuilt without removed lines.

Defined results: a null text stays null; an empty one stays empty; null ids come last and count as
one document; rows of one id that are repeated are treated alike; ties in place can't occur but for
these; an empty table gives no rows; other columns, of any name, are ignored or handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.common import drop, materialize, only, shuffle_parts, small_or_hashed

MIN_WORDS = 5
WORDS_PER_EDIT = 10
BLANKS = " \t\r\x0b\x0c"
#: A chunk ends behind a word that ends in one of these: any choice is right, this one is frequent.
ANCHORS = r"[ens0-9.,;:!?)\"|&%*#<>$-]"


def normal_line(raw: Column) -> Column:
    """Lower-cased words of a line with a space between them."""
    low = F.lower(raw)
    odd = F.contains(raw, F.lit("  "))
    for blank in BLANKS[1:]:
        odd |= F.contains(raw, F.lit(blank))
    return F.when(odd, F.btrim(F.regexp_replace(low, "[ \t\r\x0b\f]+", " "))).otherwise(F.btrim(low))


# A line's place is one number, so that the earliest is a minimum without structs or sorts.
_LINES = 1 << 31
_NO_ID = "10000000000000000000"


def _place(id: Column, line: Column) -> Column:
    return (F.coalesce(id.cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)")) * F.lit(_LINES).cast("decimal(10,0)") + line.cast("decimal(10,0)")).cast("decimal(38,0)")


def _id_and_line(place: str) -> list[Column]:
    line = F.expr(f"cast(pmod({place}, {_LINES}) as int)")
    return [F.expr(f"if({place} >= {_NO_ID}BD * {_LINES}, null, ({place} - pmod({place}, {_LINES})) div {_LINES})").alias("id"), line.alias("line")]


#: Words of a line with one edit that are left in each of its keys.
HEAD = 4
#: A long that puts longer texts first, then their hashes.
_NUMBER = "shiftleft(cast(4095 - least(octet_length(x), 4095) as long), 51) | (xxhash64(x) & 2251799813685247)"


def _variants() -> str:
    """Keys of a line with one edit at most: the words that come first, with one deleted; a shorter line itself, too."""
    head = f"array(slice(sort_array(transform(split(line, ' '), x -> {_NUMBER})), 1, {HEAD + 1}))"
    less = f"sequence(0, if(size(h) > {HEAD}, {HEAD}, size(h)))"
    return f"array_distinct(transform({head}, h -> transform({less}, i -> xxhash64(concat(slice(h, 1, i), slice(h, i + 2, size(h))))))[0])"


def _chunks() -> str:
    """Numbers of a line's chunks in order, the longest ones first."""
    return f"sort_array(transform(split(line, ' (?<={ANCHORS} )'), x -> {_NUMBER}))"


def _repeated(e: int) -> str:
    """Chunks that stand there again, numbered, as many as the distinct ones fall short."""
    # Where each chunk begins among the sorted ones, and behind the last one.
    begins = "array(concat(transform(sets, x -> array_position(chunks, x)), array(cast(size(chunks) + 1 as long))))"
    again = "flatten(transform(sets, (x, i) -> if(b[i + 1] - b[i] > 1, transform(sequence(1L, b[i + 1] - b[i] - 1), j -> xxhash64(x, j)), cast(array() as array<long>))))"
    return f"slice(sort_array(transform({begins}, b -> {again})[0]), 1, cast(2 * (n div {e}) + 1 - size(sets) as int))"


def _stretches(e: int) -> str:
    """Keys of a line's stretches at all places, as long as segments of lines within the bound are."""
    sizes = f"array_distinct(transform(sequence(greatest(1, (n - {e} + 1 + {e}) div ({e} + 1)), n div {e}), k -> ({e} * k) div (k + 1)))"
    places = f"transform(sequence(0, n - w), i -> xxhash64(slice(h, i + 1, cast(w as int))))"
    return f"array_distinct(flatten(transform(array(transform(split(line, ' '), x -> xxhash64(x))), h -> flatten(transform({sizes}, w -> {places})))))"


#: Lines of a key from which they meet by classes of length: fewer comparisons, more rows.
CROWD = 100
#: Neighbours of a line in the order of a key's classes that it meets before all others.
NEIGHBOURS = (1, -1)


#: Columns of 64 bits each, and the part of a word's hash that chooses one.
BITS = {f"bits{part}": part for part in (0, 64, 128, 192)}
#: Words from which a line has further bits, in so many longs: half of the first ones differ in any two such lines.
LONG, FURTHER = 360, 8
#: First keys of a line and of its repeated chunks: two lines that share some of them meet in one of these alone.
FIRST = ("first0", "first1", "again0")


def _parities() -> Column:
    """256 bits of which every word turns one over, and further ones of long lines. Equal words are
    numbered up to a few, else two of them would turn the same bit over and back."""
    numbered = "transform(w, (x, i) -> if(get(w, i - 1) = x, hash(x, if(get(w, i - 2) = x, if(get(w, i - 3) = x, if(get(w, i - 4) = x, 4, 3), 2), 1)), x))"
    bits = [f"aggregate(h, 0L, (a, x) -> a ^ if((x & 192) = {part}, shiftleft(1L, x), 0L)) as {name}" for name, part in BITS.items()]
    # The & of other bits of the hash chooses the long, and still others the bit.
    further = ", ".join(f"aggregate(h, 0L, (a, x) -> a ^ if((x & 1792) = {256 * k}, shiftleft(1L, shiftright(x, 11)), 0L))" for k in range(FURTHER))
    line = "array(sort_array(transform(split(line, ' '), x -> hash(x))))"
    return F.expr(f"transform(transform({line}, w -> {numbered}), h -> struct({', '.join(bits)}, if(size(h) >= {LONG}, array({further}), null) as further))[0]")


def _may(first: str, second: str, e: int, further: bool = True) -> str:
    """Whether a line stands earlier than another and lengths and words allow that they are alike.

    An edit takes one word away and adds one, so it turns over two bits at most."""
    bound = f"cast(least({first}n, {second}n) div {e} as int)"
    turned = " + ".join(f"bit_count({first}{b} ^ {second}{b})" for b in BITS)
    more = " + ".join(f"bit_count({first}further[{k}] ^ {second}further[{k}])" for k in range(FURTHER))
    long = f"({first}further is null or {second}further is null or {more} <= 2 * {bound})"
    return f"{second}place > {first}place and abs({first}n - {second}n) <= {bound} and {turned} <= 2 * {bound}" + (f" and {long}" if further else "")


def _meet(first: str, second: str) -> str:
    """Whether two lines that share key k meet there: if they share some of their first keys, in one of these alone."""
    others = ", ".join(f"{second}{c}" for c in FIRST)
    return f"coalesce(case {' '.join(f'when {first}{c} in ({others}) then {first}{c}' for c in FIRST)} end, k) = k"


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (place, line) of all lines that are not blank."""
    raw = docs.select("id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).where(F.btrim("raw", F.lit(BLANKS)) != "")
    return raw.select(_place(F.col("id"), F.col("at")).alias("place"), normal_line(F.col("raw")).alias("line"))


def near_lines(docs: DataFrame, min_words: int = MIN_WORDS, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """Rows (id, lines): the numbers, from 0, of the lines to remove; ``docs`` has id and text.

    Lines are read from ``docs`` again where their words are needed: texts are not written."""
    e = words_per_edit
    kept = ("n", *BITS, "further")
    same = ["whole", "other"]
    lines = materialize(_lines(docs).select("place", F.xxhash64("line").alias("whole"), F.xxhash64(F.lit(1), "line").alias("other")), "lines")
    # Distinct lines: all that follows knows each line once.
    distinct = materialize(lines.groupBy(*same).agg(F.min("place").alias("place"), (F.count("*") > 1).alias("again")), "distinct-lines")

    # Lines that may have edits, with their keys.
    worded = _lines(docs).withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= max(e, min_words))
    # Lines with k edits at most of 2 or more; a line of 2 e words may meet one with a single edit.
    single, several = F.col("n") <= 2 * e, F.col("n") >= 2 * e
    keyed = worded.select("place", "line", "n", _parities().alias("w"), F.when(several, F.expr(_chunks())).alias("chunks"))
    keyed = keyed.select("place", "line", "n", "w.*", "chunks", F.array_distinct("chunks").alias("sets"))
    few = several & F.expr(f"size(sets) <= 2 * (n div {e})")
    keyed = keyed.select(
        "place", *kept, F.when(single, F.expr(_variants())).alias("v"), F.expr(f"slice(sets, 1, 2 * (n div {e}) + 1)").alias("c"),
        F.when(few, F.when(F.expr(f"size(chunks) > 2 * (n div {e})"), F.expr(_repeated(e))).otherwise(F.expr(_stretches(e)))).alias("s"),
    )
    none = "cast(array() as array<long>)"
    keys = F.expr(f"case when v is null and s is null then c when c is null then v else array_distinct(concat(coalesce(v, {none}), c, coalesce(s, {none}))) end")
    first = [F.get("keys", F.lit(0)), F.get("keys", F.lit(1)), F.coalesce(F.get("s", F.lit(0)), F.get("keys", F.lit(2)))]
    keyed = keyed.select("place", *kept, keys.alias("keys"), "s").select("place", *kept, "keys", *[x.alias(c) for x, c in zip(first, FIRST)])
    keyed = keyed.join(small_or_hashed(distinct).select("place"), "place", "left_semi")
    keyed = materialize(keyed.withColumn("no", F.monotonically_increasing_id()), "keyed-lines")

    # Keys of two lines or more: nearly all are shuffled only to be dropped, so they travel with a number alone.
    by_key = Window.partitionBy("k")
    met = keyed.select("no", F.explode("keys").alias("k")).select("k", "no", F.min("no").over(by_key).alias("a"), F.max("no").over(by_key).alias("b"), F.count("*").over(by_key).alias("c"))
    met = materialize(met.where("a != b").select("k", "no", (F.col("c") > CROWD).alias("crowd")), "shared-keys")
    # Lengths within the bound are in the same class or in neighbouring ones.
    size = F.floor(F.log("n") / F.log(F.lit(1 + 1.1 / e))).cast("int").alias("size")
    by_size = Window.partitionBy("k").orderBy("size")
    near_size = by_size.rangeBetween(-1, 1)
    alive = met.join(keyed.select("no", "place", *kept, *FIRST, size), "no").drop("no")
    it = F.struct("place", "n", *BITS)
    some = F.array(F.min(it).over(near_size), *[F.lag(it, d).over(by_size) for d in NEIGHBOURS])
    alive = alive.select("*", F.count("*").over(near_size).alias("c"), some.alias("p")).where("c > 1")
    alive = materialize(alive.drop("c").withColumn("p", F.expr(f"transform(filter(p, x -> x is not null and {_may('x.', '', e, False)}), x -> x.place)")), "alive-keys")
    drop(met)
    drop(keyed)

    # Each line with the earliest of its keys and with neighbours, and where none is like it, with the others.
    pairs = materialize(alive.select("place", F.explode("p").alias("p")).distinct(), "pairs-with-some")
    near = _verified(pairs, docs, e)
    more = _others(alive, near, e).distinct()
    more = materialize(more.join(small_or_hashed(pairs), ["place", "p"], "left_anti"), "more-pairs")
    drop(alive)
    also = _verified(more, docs, e)

    # Lines that stand there again, or are near an earlier one.
    all_near = near.unionByName(also).select("place", F.lit(True).alias("near"))
    verdict = distinct.join(all_near, "place", "left").where("again or near").select(*same, F.col("place").alias("earliest"), "near")
    verdict = materialize(verdict, "verdicts")
    gone = lines.join(small_or_hashed(verdict), same).where("near or place != earliest").select(*_id_and_line("place"))
    out = materialize(gone.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "removed-lines")
    for x in (lines, distinct, pairs, more, near, also, verdict):
        drop(x)
    return out


def _others(alive: DataFrame, near: DataFrame, e: int) -> DataFrame:
    """Rows (place, p): lines that are near none yet with all earlier lines of their keys that they may be near."""
    columns = ("place", "n", *BITS, "further", *FIRST)
    # In the keys of many lines classes of length meet, in the others all do. Two classes are one
    # here, and those beside a line's class are in two of these at most.
    size, class_ = F.when(F.col("crowd"), F.col("size")), lambda x: F.floor(x / 2).cast("int")
    classes = F.when(F.col("crowd"), F.array_distinct(F.array(class_(size - 1), class_(size + 1)))).otherwise(F.array(F.lit(-9)))
    later = alive.join(small_or_hashed(near), "place", "left_anti").select("k", F.explode(classes).alias("size"), F.struct(*columns).alias("x"))
    earlier = alive.select("k", F.coalesce(class_(size), F.lit(-9)).alias("size"), F.struct(*columns).alias("y"))
    both = later.join(earlier, ["k", "size"]).where(f"{_may('y.', 'x.', e)} and {_meet('x.', 'y.')}")
    return both.select(F.col("x.place").alias("place"), F.col("y.place").alias("p"))


#: A character for a word; as few words share one, it mostly tells the words of a pair apart.
_CHARACTER = "hex(4096 + pmod(hash(x), 51200))"


def _verified(pairs: DataFrame, docs: DataFrame, e: int) -> DataFrame:
    """Places of the pairs whose lines are within the bound."""
    wanted = materialize(pairs.select(F.explode(F.array("place", "p")).alias("place")).distinct(), "wanted-lines")
    found = _lines(docs).join(small_or_hashed(wanted), "place", "left_semi").dropDuplicates(["place"])
    coded = F.expr(f"decode(unhex(array_join(transform(split(line, ' '), x -> {_CHARACTER}), '')), 'UTF-16BE')")
    found = materialize(found.select("place", F.size(F.split("line", " ")).alias("n"), coded.alias("f"), F.col("line").alias("x")), "wanted-columns")
    drop(wanted)
    side = lambda k: found.select("place", *[F.col(c).alias(f"{c}{k}") for c in ("n", "f", "x")])
    dealt = pairs.repartition(shuffle_parts(docs.sparkSession), "place", "p")
    both = dealt.join(side(1), "place").join(side(2).withColumnRenamed("place", "p"), "p")
    may = F.expr(f"levenshtein(f1, f2, cast(least(n1, n2) div {e} as int)) >= 0")
    # As many characters as words: each word has its own, and the distance of characters is that of the words.
    apart = F.expr("size(array_union(split(x1, ' '), split(x2, ' '))) = size(array_union(split(f1, ''), split(f2, '')))")
    out = materialize(both.where(F.when(may, F.when(apart, True).otherwise(within_edits(e))).otherwise(False)).select("place").distinct(), "near-lines")
    drop(found)
    return out


def within_edits(words_per_edit: int) -> Column:
    """Edit distance of the words of x1 and x2 at most a word for every full ``words_per_edit`` of the shorter.

    Words become characters, numbered within the pair above the surrogates."""
    words = "transform(split({x}, ' '), x -> xxhash64(x))"
    text = "decode(unhex(array_join(transform({w}, x -> lpad(hex(65536 + array_position(d, x)), 8, '0')), '')), 'UTF-32')"
    distance = f"levenshtein({text.format(w='w.a')}, {text.format(w='w.b')}, cast(least(n1, n2) div {words_per_edit} as int))"
    return F.expr(f"exists(array(struct({words.format(x='x1')} as a, {words.format(x='x2')} as b)), w -> exists(array(array_distinct(concat(w.a, w.b))), d -> {distance} >= 0))")


_REST = "transform(array(split({text}, '\n')), all -> array_join(transform(array_except(sequence(0, size(all) - 1), {gone}), i -> all[i]), '\n'))[0]"


def _with_rest(docs: DataFrame, min_words: int, words_per_edit: int, text: str, id: str) -> DataFrame:
    """Rows (row, id, text, lines, rest): the row as it was, its lines to remove and what remains."""
    gone = near_lines(only(docs, id, text).toDF("id", "text"), min_words, words_per_edit)
    gone = small_or_hashed(gone).withColumnRenamed("id", "gid")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")), "left")
    return joined.withColumn("rest", F.when(F.col("lines").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.expr(_REST.format(text="text", gone="lines"))))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, words_per_edit: int = WORDS_PER_EDIT, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, text, n_lines, n_removed) with the remaining text of every row."""
    return _with_rest(only(docs, id, text), min_words, words_per_edit, text, id).select(
        F.col("id").alias(id), F.col("rest").alias("text"),
        (F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(-1)) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS, words_per_edit: int = WORDS_PER_EDIT, text: str = "text", id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` without lines that stand earlier; a row that loses all its words goes."""
    changed = F.col("lines").isNotNull() & F.col("text").isNotNull()
    new = _with_rest(docs, min_words, words_per_edit, text, id).where(~changed | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    columns = {text: F.col("rest"), n_chars: F.when(changed, F.length("rest").cast("long")).otherwise(F.col("row").getField(n_chars)) if n_chars in docs.columns else None}
    return new.select(*[(columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in docs.columns])
