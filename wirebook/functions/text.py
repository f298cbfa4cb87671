"""Column expressions on bytes and text. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirebook.schema import REDACTED

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def lossy_utf8(data: Column) -> Column:
    """Bytes as text, U+FFFD for every bad sequence. Never fails."""
    return F.make_valid_utf8(data.cast("string"))


def byte_text(data: Column) -> Column:
    """One character per byte, so that character offsets are byte offsets."""
    return F.decode(data, "ISO-8859-1")


def byte_text_lossy(text: Column) -> Column:
    """Turn a piece of :func:`byte_text` into real text."""
    return lossy_utf8(F.encode(text, "ISO-8859-1"))


def _continues(data: Column, offset: int) -> Column:
    byte = F.substring(data, offset + 1, 1)
    return (byte >= F.lit(b"\x80")) & (byte < F.lit(b"\xc0"))


def cut_utf8(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of ``text``, ending on a character boundary."""
    data = text.cast("binary")
    cuts = [at for at in range(limit, limit - 4, -1) if at >= 0]
    length = reduce(
        lambda found, at: F.when(~_continues(data, at), F.lit(at)).otherwise(found),
        reversed(cuts),
        F.lit(cuts[-1]),
    )
    cut = F.substring(data, F.lit(1), length).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def body_text(body: Column, limit: int | None) -> Column:
    """Lossy text of a body, at most ``limit`` bytes of it.

    Decoding never makes bytes fewer, and a broken sequence spans at most
    three bytes, so ``limit + 4`` raw bytes settle the first ``limit`` decoded
    ones exactly; a large body is not decoded to its end only to be cut.
    """
    if limit is None:
        return lossy_utf8(body)
    return cut_utf8(lossy_utf8(F.substring(body, 1, limit + 4)), limit)


def body_is_longer(body: Column, limit: int) -> Column:
    """Whether :func:`body_text` had to cut."""
    return F.octet_length(lossy_utf8(F.substring(body, 1, limit + 4))) > limit


def redact(headers: Column, names: list[str]) -> Column:
    """Hide the values of the named headers; ASCII case is ignored on both sides."""
    if not names:
        return headers
    wanted = sorted({"".join(c.lower() if c in _UPPER else c for c in n) for n in names})
    return F.transform_values(
        headers,
        lambda name, value: F.when(ascii_lower(name).isin(wanted), F.lit(REDACTED)).otherwise(value),
    )


def last_wins(entries: Column) -> Column:
    """Map from an array of ``key``, ``value`` structs; the last duplicate wins.

    Independent of ``spark.sql.mapKeyDedupPolicy``.
    """

    def picked(keys: Column) -> Column:
        later = lambda i: F.slice(keys, i + F.lit(2), F.greatest(F.size(keys) - i - F.lit(1), F.lit(0)))
        last = F.filter(entries, lambda e, i: ~F.array_contains(later(i), e["key"]))
        return F.when(F.size(keys) == F.size(F.array_distinct(keys)), entries).otherwise(last)

    # As an element of an array the keys are evaluated once, not for every entry.
    keys = F.array(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.get(F.transform(keys, picked), F.lit(0)))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_to_bytes(text: Column, size: int) -> Column:
    """Bytes of a hex string of exactly ``size`` bytes, else null."""
    return F.when(text.rlike(rf"\A[0-9a-fA-F]{{{2 * size}}}\z"), F.unhex(text))


def base64_encode(data: Column) -> Column:
    return F.translate(F.base64(data), "\r\n", "")


def base64_decode(text: Column) -> Column:
    """Strict base64: padding is required and spare bits must be zero; else null."""
    data = F.try_to_binary(text, F.lit("base64"))
    return F.when(base64_encode(data) == text, data)


def present(data: Column) -> Column:
    """A whole body; an empty one counts as none."""
    return F.when(F.octet_length(data) > 0, data)


def cap_bytes(data: Column, limit: int) -> Column:
    """First ``limit`` bytes; an empty body counts as none."""
    return F.substring(present(data), 1, limit)


def clock_utc(ts_ns: Column) -> Column:
    """``HH:MM:SS`` of the UTC day, independent of the session time zone."""
    whole = F.call_function("div", F.greatest(ts_ns, F.lit(0)), F.lit(1_000_000_000))
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60)


def rfc3339_ms(ms: Column) -> Column:
    """``yyyy-MM-ddTHH:MM:SS.mmmZ``, independent of the session time zone."""
    day = F.floor(ms / 86_400_000)
    rest = ms - day * 86_400_000
    return F.format_string(
        "%sT%02d:%02d:%02d.%03dZ",
        F.date_from_unix_date(day.cast("int")).cast("string"),
        F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60, rest % 1000,
    )


def duration_label(ns: Column) -> Column:
    """Rounded to a whole unit (halves to even): ``2s``, ``42ms``, ``850µs``, ``7ns``."""

    def whole(unit: int) -> Column:
        low = F.call_function("div", ns, F.lit(unit))
        rest = (ns % unit) * 2
        up = (rest > unit) | ((rest == unit) & (low % 2 == 1))
        return (low + up.cast("bigint")).cast("string")

    return (
        F.when(ns >= 1_000_000_000, F.concat(whole(1_000_000_000), F.lit("s")))
        .when(ns >= 1_000_000, F.concat(whole(1_000_000), F.lit("ms")))
        .when(ns >= 1_000, F.concat(whole(1_000), F.lit("µs")))
        .otherwise(F.concat(ns.cast("string"), F.lit("ns")))
    )


def ellipsis(text: Column, limit: int) -> Column:
    """Text of more than ``limit`` bytes is cut to ``limit - 1`` and gets an ellipsis."""
    return F.when(
        F.octet_length(text) > limit, F.concat(cut_utf8(text, limit - 1), F.lit("…"))
    ).otherwise(text)


def first_lines(text: Column, count: int) -> Column:
    """The first ``count`` lines, joined by newlines, without the final line end."""
    trimmed = F.regexp_replace(text, r"\r?\n\z", "")
    return F.array_join(F.slice(F.split(trimmed, r"\r?\n", count + 1), 1, count), "\n")
