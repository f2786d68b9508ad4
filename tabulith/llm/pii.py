"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Values are found by pattern, validated, and permuted within their own format by Feistel networks
keyed with a secret: letters stay letters of their case, digits stay digits, separators stay.
Equal values get equal pseudonyms in every document, so they stay linked, and who has the key can
turn a value of a known kind back (``pseudonym`` with ``back``). Rounds are keyed by HMAC with a
digest of the key, so the key itself never stands in a plan, a log or the user interface.

- cards: all digits but the last are permuted, the check digit is worked out anew (of a number that
  fails the check it stays as far from the right one);
- account numbers (IBAN): the part after country and check digits is permuted, the check digits
  are worked out anew;
- social security numbers: permuted within the numbers that may be issued;
- network addresses: the 32 bits are permuted;
- dates: permuted within the 400 years from 1700, whose days are a whole calendar cycle;
- telephone numbers: the digits after the country code are permuted;
- mail addresses: the part before the @ is permuted; secrets: the value is.

A value after words such as ``password:`` or ``token =`` is a secret, whatever else it looks like;
of other kinds the first in the order of the patterns wins. Values that stay as they are count for
nothing.

Defined results: a null text stays null with no kinds; invalid dates and addresses stay as they
are, unless they are secrets; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import only

ROUNDS = 8
#: Characters that are moved within their class; the small letters with accents are two classes more.
_MOVED = "0-9A-Za-zà-öø-ÿ"
MARK, ESCAPE = "\u0001", "\u0002"

# The patterns of each kind, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?",
    "secret": r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk[-_](?:live[-_]|test[-_])?[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])|(?<=(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?)(?=[^\s\"']*[0-9])[^\s\"',;]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4})(?![0-9A-Za-z/-])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])",
}
# The one back-reference counts the group that holds all alternatives.
_ANY = "(" + "|".join(PATTERNS.values()) + ")"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pads(key: str) -> tuple[Column, Column]:
    """Inner and outer pad of HMAC-SHA256, of a digest of the key."""
    block = hashlib.sha256(b"pseudonyms|" + key.encode()).digest().ljust(64, b"\0")
    return F.lit(bytearray(b ^ 0x36 for b in block)), F.lit(bytearray(b ^ 0x5C for b in block))


def _digest(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as hexadecimal digits."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.concat_ws("|", *parts), "UTF-8")), 256))), 256)


def _shift(chars: Column, digest: Column, back: bool) -> Column:
    """Each letter or digit moved on (or back) in its class by a byte of the digest."""

    def moved(c, i):
        code = F.ascii(c)
        step = F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda low, n: F.char(F.lit(low) + F.pmod(code - low - step if back else code - low + step, F.lit(n)))
        out = F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26))
        return out.when(c.between("à", "ö"), within(224, 23)).when(c.between("ø", "ÿ"), within(248, 8)).otherwise(c)

    return F.transform(chars, moved)


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel_text(s: Column, key: str, tweak: str, back: bool = False) -> Column:
    """Permutes strings of letters and digits, class by class; ``back`` is the inverse."""
    chars = F.split(s, "")
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, 1, half).alias("l"), F.slice(chars, half + 1, F.size(chars) - half).alias("r"))

    def round_(state, i):
        n = i.cast("string")
        left = _let(_digest(key, F.lit(tweak), n, F.array_join(state["r"], "")), lambda d: _shift(state["l"], d, back))
        right = _let(_digest(key, F.lit(tweak), n, F.array_join(state["l"], "")), lambda d: _shift(state["r"], d, back))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), state["r"].alias("r"))).otherwise(F.struct(state["l"].alias("l"), right.alias("r")))

    return F.aggregate(_rounds(back), start, round_, lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))


def feistel_number(a: Column, b: Column, size_a: int, size_b: int, key: str, tweak: str, back: bool = False) -> Column:
    """Permutes pairs (a, b) below (size_a, size_b): struct<a: bigint, b: bigint>; ``back`` is the inverse."""
    noise = lambda i, x: F.conv(F.substring(_digest(key, F.lit(tweak), i.cast("string"), x.cast("string")), 1, 12), 16, 10).cast("bigint")

    def round_(s, i):
        move = lambda x, by, n: F.pmod(x - by if back else x + by, F.lit(n))
        return F.when(i % 2 == 0, F.struct(move(s["a"], noise(i, s["b"]), size_a).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), move(s["b"], noise(i, s["a"]), size_b).alias("b"))
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(_rounds(back), start, round_)


def _only_chars(s: Column) -> Column:
    return F.regexp_replace(s, f"[^{_MOVED}]", "")


def _in_place(s: Column, new: Column) -> Column:
    """Letters and digits of ``s``, in order, replaced by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(state, c):
        return F.when(
            c.rlike(f"[{_MOVED}]"), F.struct(F.concat(state["out"], F.substring(new, state["k"], F.lit(1))).alias("out"), (state["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(state["out"], c).alias("out"), state["k"].alias("k")))

    return F.aggregate(F.split(s, ""), start, put, lambda x: x["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that belongs to the digits before it."""
    doubled = F.transform(F.split(F.reverse(payload), ""), lambda c, i: _let(c.cast("int") * (2 - i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _head(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - 1)


def card(s: Column, key: str, back: bool = False) -> Column:
    """The check digit stays as far from the right one as it was, so that invalid numbers stay so."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    off = F.right(digits, F.lit(1)).cast("int") - luhn_digit(_head(digits)).cast("int")
    new = _let(feistel_text(_head(digits), key, "card", back), lambda p: F.concat(p, F.pmod(luhn_digit(p).cast("int") + off, F.lit(10)).cast("string")))
    return _in_place(s, new)


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of a country and an account."""
    step = lambda m, c: F.when(c.between("0", "9"), (m * 10 + c.cast("int")) % 97).otherwise((m * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda m, c: step(m, F.when(c.rlike("[0-9A-Z]"), c).otherwise("0")).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def iban(s: Column, key: str, back: bool = False) -> Column:
    bare = _only_chars(s)
    country, check, account = F.substring(bare, 1, 2), F.substring(bare, 3, 2), F.substring(bare, F.lit(5), F.length(bare))
    off = check.cast("int") - iban_check(country, account).cast("int")
    new = _let(feistel_text(account, key, "iban", back), lambda a: F.concat(country, F.lpad(F.pmod(iban_check(country, a).cast("int") + off, F.lit(100)).cast("string"), 2, "0"), a))
    return _in_place(s, new)


def ssn(s: Column, key: str, back: bool = False) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999; in others what makes them invalid stays."""
    area, group, serial = (F.substring(s, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)

    def text(x):
        a = F.floor(x["a"] / 99)
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((x["a"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((x["b"] + 1).cast("string"), 4, "0"))

    two = lambda x: F.concat(F.lpad(F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((x["b"] + 1).cast("string"), 2, "0"), F.substring(s, 7, 5))
    whole = _let(feistel_number(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", back), text)
    bad_area = (area == 0) | (area >= 900) | (area == 666)
    return (
        F.when(valid, whole)
        .when(bad_area, _in_place(s, F.concat(F.substring(s, 1, 3), feistel_text(F.concat(F.substring(s, 5, 2), F.substring(s, 8, 4)), key, "ssn area", back))))
        .when(group == 0, F.concat(F.substring(s, 1, 7), feistel_text(F.substring(s, 8, 4), key, "ssn group", back)))
        .otherwise(_let(feistel_number(rank, group - 1, 898, 99, key, "ssn serial", back), two))
    )


def ip(s: Column, key: str, back: bool = False) -> Column:
    part = F.transform(F.split(s, r"\."), lambda x: x.cast("bigint"))
    valid = ~F.exists(part, lambda x: x > 255)
    at = lambda i: F.element_at(part, i)
    text = lambda x: F.concat_ws(".", F.floor(x["a"] / 256).cast("string"), (x["a"] % 256).cast("string"), F.floor(x["b"] / 256).cast("string"), (x["b"] % 256).cast("string"))
    return F.when(valid, _let(feistel_number(at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536, key, "ip", back), text)).otherwise(s)


#: Days of 400 years, a whole cycle of the calendar, and its factors.
_DAYS = (189, 773)


def date(s: Column, key: str, back: bool = False) -> Column:
    iso = s.rlike(r"^[0-9]{4}-")
    number = lambda g: F.regexp_extract(s, r"^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$", g)
    slash = F.contains(s, F.lit("/"))
    # With slashes the month stands first unless it can't.
    month_first = slash & (F.coalesce(number(1).try_cast("int"), F.lit(99)) <= 12)
    year = F.when(iso, number(1)).otherwise(number(3))
    month = F.when(iso | ~month_first, number(2)).otherwise(number(1))
    day = F.when(iso, number(3)).when(month_first, number(2)).otherwise(number(1))
    value = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    days = F.datediff(value, F.lit("1700-01-01").cast("date"))
    valid = value.isNotNull() & days.between(0, _DAYS[0] * _DAYS[1] - 1)

    def text(x):
        d = F.date_add(F.lit("1700-01-01").cast("date"), (x["a"] * _DAYS[1] + x["b"]).cast("int"))
        y, m, dd = (F.lpad(f(d).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.day, 2)))
        sep = F.when(slash, "/").otherwise(".")
        # Slashes keep their order: the day stays first only where it says so itself.
        return F.when(iso, F.concat_ws("-", y, m, dd)).when(slash, F.concat(m, sep, dd, sep, y)).otherwise(F.concat(dd, sep, m, sep, y))

    a, b = F.floor(days / _DAYS[1]), days % _DAYS[1]
    return F.when(valid, _let(feistel_number(a, b, *_DAYS, key, "date", back), text)).otherwise(s)


def phone(s: Column, key: str, back: bool = False) -> Column:
    code = F.regexp_extract(s, r"^(\+[0-9]{1,3}(?=[ .(-])[ .-]?)", 1)
    rest = F.substring(s, F.length(code) + 1, F.length(s))
    return F.concat(code, _let(rest, lambda r: _in_place(r, feistel_text(_only_chars(r), key, "phone", back))))


def email(s: Column, key: str, back: bool = False) -> Column:
    local = F.substring_index(s, "@", 1)
    return F.concat(_in_place(local, feistel_text(_only_chars(local), key, "email", back)), F.substring(s, F.length(local) + 1, F.length(s)))


def secret(s: Column, key: str, back: bool = False) -> Column:
    return _in_place(s, feistel_text(_only_chars(s), key, "secret", back))


KINDS = {"email": email, "secret": secret, "iban": iban, "ssn": ssn, "date": date, "ip": ip, "card": card, "phone": phone}


#: What stands before a secret.
_CONTEXT = r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?$"


def kind_of(value: Column, before: Column) -> Column:
    """A value after ``token =`` or the like is a secret; else the first kind whose pattern holds the whole value."""
    out = F.when(before.rlike(_CONTEXT) & value.rlike("^[^\\s\"',;]{8,}$"), "secret")
    for name, pattern in PATTERNS.items():
        whole = value.rlike("^(?:" + pattern.replace(r"\2", r"\1") + ")$")
        out = out.when(whole, name)
    return out.otherwise("secret")


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a value of a kind; ``back``: the value of a pseudonym."""
    out = None
    for name, f in KINDS.items():
        out = F.when(kind == name, f(value, key, back)) if out is None else out.when(kind == name, f(value, key, back))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Rows (id, text, n_found, kinds): the text with pseudonyms, how many and of which kinds."""
    own = only(docs, id, text).toDF("id", "text")
    t = F.col("text")
    escaped = F.when(t.rlike(f"[{MARK}{ESCAPE}]"), F.replace(F.replace(t, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))).otherwise(t)
    marked = F.when(t.rlike("[0-9@]"), F.regexp_replace(escaped, _ANY, f"{MARK}$1{MARK}"))
    # Only texts with a value are taken apart: at odd places of the parts stand the values.
    parts = F.when(F.contains(F.col("marked"), F.lit(MARK)), F.split("marked", MARK))
    before = lambda i: F.right(F.get("split", i - 1), F.lit(32))
    typed = F.transform("split", lambda x, i: F.struct(F.when(i % 2 == 1, kind_of(x, before(i))).alias("kind"), x.alias("value")))
    new = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), F.when(p["kind"].isNull(), p["value"]).otherwise(pseudonym(p["value"], p["kind"], key)).alias("new")))
    back = F.replace(F.replace(F.array_join(F.transform("parts", lambda p: p["new"]), ""), F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
    found = F.transform(F.filter("parts", lambda p: p["kind"].isNotNull() & (p["new"] != p["value"])), lambda p: p["kind"])
    return (
        own.withColumn("marked", marked)
        .withColumn("split", parts)
        .withColumn("parts", typed)
        .withColumn("parts", new)
        .select(
            F.col("id").alias(id),
            F.when(F.col("parts").isNull(), t).otherwise(back).alias("text"),
            F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_found"),
            F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>")).alias("kinds"),
        )
    )
