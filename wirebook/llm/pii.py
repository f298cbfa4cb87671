"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within a value's format.

The rounds are SQL expressions; their function is SHA-256 of the key, the kind
of value, the round and the other half. A permutation maps equal values to
equal pseudonyms and different values to different ones, so records stay
linked across documents. What is permuted, by kind:

* ``email``: letters and digits of the part before the ``@``, each within its class;
* ``phone``: the digits after the country code;
* ``ssn``: the digits; ``card``: the digits of a number that satisfies its
  check digit, which is computed anew;
* ``ip``: the 32-bit number of a dotted quad with parts up to 255;
* ``date``: valid dates from 1900-01-01 on, 270 * 270 days, written
  ``yyyy-MM-dd``, ``MM/dd/yyyy`` or ``dd.MM.yyyy``.

What looks like a value but is not valid stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.common import free_name

ROUNDS = 10
DAYS = 270

# Repeats are possessive or bounded, so that a long run of characters costs no more than its length.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
ANY = "|".join([EMAIL, DATE, IP, PHONE, SSN, CARD])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _keystream(key: str, kind: str, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other.cast("string")), 256)


def _shifted(text: Column, stream: Column) -> Column:
    """Each letter and digit moved within its class by the keystream's next four hexadecimal digits."""

    def move(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(stream, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") + (i / 16).cast("int")
            within = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - F.lit(first) + by) % n)
            return (
                F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return _let(stream, move)


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """A Feistel network over the halves of a string: letters and digits stay in their class, all else in place."""

    def halves(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), cut).alias("a"), F.substring(v, cut + 1, F.length(v)).alias("b"))
        turn = lambda acc, r: F.struct(acc["b"].alias("a"), _shifted(acc["a"], _keystream(key, kind, r, acc["b"])).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))

    return _let(text, halves)


def permuted_number(number: Column, base: int, key: str, kind: str) -> Column:
    """A Feistel network over a number below ``base`` squared."""
    start = lambda v: F.struct(F.floor(v / base).cast("bigint").alias("a"), (v % base).cast("bigint").alias("b"))
    drawn = lambda acc, r: F.conv(F.substring(_keystream(key, kind, r, acc["b"]), 1, 12), 16, 10).cast("bigint")
    turn = lambda acc, r: F.struct(acc["b"].alias("a"), ((acc["a"] + drawn(acc, r)) % base).alias("b"))
    return _let(number, lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start(v), turn, lambda acc: acc["a"] * base + acc["b"]))


def _check_sum(digits: Column) -> Column:
    """The sum of a card number's digits, every second one from the right doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(value: Column, key: str) -> Column:
    digits = lambda v: F.regexp_replace(v, "[ -]", "")
    body = permuted_text(F.substring(value, F.lit(1), F.length(value) - 1), key, "card")
    check = lambda b: F.concat(b, ((10 - _check_sum(F.concat(digits(b), F.lit("0"))) % 10) % 10).cast("string"))
    return F.when(_check_sum(digits(value)) % 10 == 0, _let(body, check)).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    quad = lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.forall(parts, lambda p: p <= 255), _let(permuted_number(number, 1 << 16, key, "ip"), quad)).otherwise(value)


def _date(value: Column, form: str, key: str) -> Column:
    day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))
    moved = lambda d: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), permuted_number(d, DAYS, key, "date").cast("int")), form)
    return _let(day, lambda d: F.when(d.between(0, DAYS * DAYS - 1), moved(d)).otherwise(value))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that ``ANY`` matched."""
    at = F.instr(value, "@")
    code = F.length(F.regexp_extract(value, r"^\+(?:\d{1,3}(?=[ .(-])|\d)", 0))
    return (
        F.when(at > 0, F.concat(permuted_text(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value))))
        .when(value.startswith("+"), F.concat(F.substring(value, F.lit(1), code), permuted_text(F.substring(value, code + 1, F.length(value)), key, "phone")))
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(value, "yyyy-MM-dd", key))
        .when(value.rlike(r"^\d{2}/"), _date(value, "MM/dd/yyyy", key))
        .when(value.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), _date(value, "dd.MM.yyyy", key))
        .when(value.rlike(r"\.\d+\."), _ip(value, key))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), permuted_text(value, key, "ssn"))
        .otherwise(_card(value, key))
    )


def pseudonymised(text: Column | str, key: str) -> Column:
    """The text with every value replaced; null stays null. Only texts with a digit or an ``@`` are searched."""
    text = F.col(text) if isinstance(text, str) else text
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    joined = F.zip_with(F.split(text, ANY), values, lambda gap, value: F.concat(gap, F.coalesce(pseudonym(value, key), F.lit(""))))
    return F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.array_join(joined, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """Every row with its text pseudonymised and ``n_values``, how many values the text had; null for a null text.

    Other columns stay as they are; a column named ``n_values`` is replaced.
    Repeated rows give repeated rows, no rows none. It is one pass without a
    shuffle: the permutation needs no table of what was seen.
    """
    counted = free_name(docs, "_values")
    count = F.when(F.col(f"`{text_col}`").rlike("[0-9@]"), F.regexp_count(f"`{text_col}`", F.lit(ANY))).otherwise(F.when(F.col(f"`{text_col}`").isNotNull(), 0))
    out = docs.withColumn(counted, count)
    kept = [c for c in docs.columns if c.lower() != "n_values"]
    return out.select(*[pseudonymised(F.col(f"`{c}`"), key).alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in kept], F.col(counted).alias("n_values"))
