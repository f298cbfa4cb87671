"""Column expressions for HTTP fields and HTTP/1.x message heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.functions.text import byte_text, byte_text_lossy, last_wins
from wirebook.schema import METHODS


def known_method(method: Column, ignore_case: bool = True) -> Column:
    """One of the nine methods; anything else counts as GET."""
    name = F.upper(method) if ignore_case else method
    return F.when(name.isin(METHODS), name).otherwise(F.lit("GET"))


def absolute_url(uri: Column, host: Column, path: Column) -> Column:
    """An absolute URI is kept, else the URL is put together from host and path."""
    built = F.concat(
        F.lit("http://"), F.coalesce(host, F.lit("unknown")), F.coalesce(path, F.lit("/"))
    )
    return F.when(uri.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://"), uri).otherwise(built)


def header_map(entries: Column) -> Column:
    """(name, value bytes) pairs to a map; a value that is not visible ASCII reads ``<binary>``."""

    def pair(entry: Column) -> Column:
        text = byte_text(entry["value"])
        plain = text.rlike(r"\A[\x20-\x7e\t]*\z")
        return F.struct(
            F.lower(entry["name"]).alias("key"),
            F.when(plain, text).otherwise(F.lit("<binary>")).alias("value"),
        )

    return last_wins(F.transform(entries, pair))


def status_class(status: Column) -> Column:
    digit = F.when(status.between(200, 599), F.floor(status / 100).cast("string"))
    return F.coalesce(F.concat(digit, F.lit("xx")), F.lit("other"))


def trace_ids(*parts: Column) -> tuple[Column, Column]:
    """Deterministic (trace_id, span_id) of a record, so that a retried task
    gives the same ids."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return F.substring(digest, 1, 32), F.substring(digest, 33, 16)


#: So large that adding a head to it still fits a BIGINT.
ENDLESS = 1 << 62

# Head grammar, on text that has one character per byte.
_TOKEN = r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+"
REQUEST_LINE = rf"\A({_TOKEN}) ([\x21-\x7e\x80-\xff]+) HTTP/1\.[01]\z"
STATUS_LINE = r"\AHTTP/1\.[01] ([0-9]{3})(?: [\t\x20-\x7e\x80-\xff]*)?\z"
HEADER_LINE = rf"\A({_TOKEN}):[ \t]*([\t\x20-\x7e\x80-\xff]*?)[ \t]*\z"
#: The same lines without groups, so that a line is gone through once; no name has a colon.
_HEADER_LINE = rf"\A{_TOKEN}:[\t\x20-\x7e\x80-\xff]*+\z"


#: Bytes in which the end of a head is looked for first.
HEAD_WINDOW = 1 << 16


def _head_text(buffer: Column, window: int) -> Column:
    """The head of a buffer as :func:`byte_text`, empty if it has no end within the window."""
    return F.regexp_extract(byte_text(F.substring(buffer, 1, window)), r"\A(?s:.*?\n)\r?\n", 0)


def with_head(df: DataFrame, buffer: str, start_line: str) -> DataFrame:
    """Parse the message head at the start of a byte buffer.

    Adds ``head_ended`` (whether an empty line ends it), ``head_size`` (null
    without a complete, valid head), ``start_line`` and ``head_headers``
    (lower-case names, last duplicate wins). Built in steps, so that every
    expression is evaluated once per row. Only the first window of a buffer is
    decoded where the head ends there, so a body behind it is not.
    """
    found = df.withColumn("_found", _head_text(F.col(buffer), HEAD_WINDOW))
    for window in (HEAD_WINDOW << 5, HEAD_WINDOW << 10, 1 << 30):
        undecided = (F.length("_found") == 0) & (F.octet_length(buffer) > window >> 5)
        found = found.withColumn("_found", F.when(undecided, _head_text(F.col(buffer), window)).otherwise(F.col("_found")))
    # A head that ends gives two empty lines behind its own.
    lines = found.withColumn("_lines", F.split("_found", r"\r?\n"))
    fields = lines.withColumns({
        "head_ended": F.length("_found") > 0,
        "start_line": F.get("_lines", F.lit(0)),
        "_fields": F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 3, F.lit(0))),
    })
    checked = fields.withColumn(
        "head_size",
        F.when(
            F.col("head_ended")
            & F.col("start_line").rlike(start_line)
            & F.forall("_fields", lambda line: line.rlike(_HEADER_LINE)),
            F.length("_found"),
        ),
    )
    entries = checked.withColumn(
        "_entries",
        F.transform(
            "_fields",
            lambda line: F.struct(
                F.lower(F.substring_index(line, ":", 1)).alias("key"),
                byte_text_lossy(F.btrim(F.substr(line, F.locate(":", line) + 1), F.lit(" \t"))).alias("value"),
            ),
        ),
    )
    return entries.withColumn(
        "head_headers", F.when(F.col("head_size").isNotNull(), last_wins(F.col("_entries")))
    ).drop("_found", "_lines", "_fields", "_entries")


def head_method(start_line: Column) -> Column:
    return F.regexp_extract(start_line, REQUEST_LINE, 1)


def head_target(start_line: Column) -> Column:
    return byte_text_lossy(F.regexp_extract(start_line, REQUEST_LINE, 2))


def head_status(start_line: Column) -> Column:
    return F.regexp_extract(start_line, STATUS_LINE, 1).try_cast("int")


def content_length(headers: Column) -> Column:
    """Declared length; null when absent or not an unsigned 64-bit number.

    Lengths beyond ENDLESS, which no body reaches, read as that.
    """
    digits = F.regexp_extract(headers["content-length"], r"\A\+?0*([0-9]{1,20})\z", 1)
    number = digits.try_cast("decimal(20,0)")
    return F.when(number <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), F.least(number, F.lit(ENDLESS).cast("decimal(20,0)")).cast("bigint"))


def is_chunked(headers: Column) -> Column:
    return F.contains(F.lower(headers["transfer-encoding"]), F.lit("chunked"))
