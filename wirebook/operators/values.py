"""Values that one response gives and a later request of the same trace uses.

Outputs and inputs are put in the order of their time for each trace and value;
the last output before an input is a running value. So a value that a third of
all messages hold costs no more than others: no pairs are made of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.operators.endpoints import path_of
from wirebook.operators.scan import Last, scan
from wirebook.session import durable, ship

_ROWS = 10_000
_LEAVES = pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("at", pa.int64()), ("made", pa.bool_()), ("place", pa.string()), ("value", pa.string())])
_LEAVES_DDL = "trace_id string, span_id string, at bigint, made boolean, place string, value string"


def json_leaves(text: bytes) -> Iterator[tuple[str, str]]:
    """Pointers and texts of a body's strings and numbers, numbers as they are written; nothing if it is no JSON."""
    try:
        rest = [("", json.loads(text.decode(), parse_int=str, parse_float=str, parse_constant=lambda _: None))]
    except (ValueError, RecursionError):
        return
    while rest:
        place, found = rest.pop()
        if isinstance(found, str):
            yield place, found
        elif isinstance(found, dict):
            rest += [(f"{place}/{name.replace('~', '~0').replace('/', '~1')}", inner) for name, inner in found.items()]
        elif isinstance(found, list):
            rest += [(f"{place}/{k}", inner) for k, inner in enumerate(found)]


def _from_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head, bodies = batch.select(range(4)), batch.column(4)
        whose, places, values = [], [], []
        for k in range(batch.num_rows):
            for place, value in json_leaves(bodies[k].as_py()):
                whose.append(k)
                places.append(f"body{place}")
                values.append(value)
                if len(whose) == _ROWS:
                    yield _told(head, whose, places, values)
                    whose, places, values = [], [], []
        if whose:
            yield _told(head, whose, places, values)


def _told(head: pa.RecordBatch, whose: list[int], places: list[str], values: list[str]) -> pa.RecordBatch:
    own = head.take(pa.array(whose, pa.int64()))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(places, pa.string()), pa.array(values, pa.string())], schema=_LEAVES)


def _in_url(url: Column) -> Column:
    """Places and values of the path's segments and of the query's parameters."""
    segments = F.split(F.regexp_replace(path_of(url), "^/", ""), "/")
    asked = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    plain = lambda s: F.coalesce(F.try_url_decode(s), s)
    one = lambda place, value: F.struct(place.alias("place"), value.alias("value"))
    return F.concat(
        F.transform(segments, lambda s, k: one(F.concat(F.lit("path/"), k.cast("string")), plain(s))),
        F.transform(asked, lambda s: one(F.concat(F.lit("query/"), plain(F.substring_index(s, "=", 1))), plain(F.regexp_extract(s, "^[^=]*=(.*)$", 1)))),
    )


def value_links(traces: DataFrame, shortest: int = 1, partitions: int | None = None) -> DataFrame:
    """``trace_id, span_id, place, value, source_span_id, source_place``: inputs that an earlier response gave.

    Inputs are path segments (``path/0``), query parameters (``query/name``)
    and the strings and numbers of a JSON request body (``body`` and a JSON
    pointer), outputs those of a JSON response body. An input is linked to the
    last response of its trace with the same text that ended before the request
    began; of several that ended at once to the greatest id, of several places in
    one response to the least. Values shorter than ``shortest`` characters are
    no inputs. Rows without a trace, an id or a time are passed over; repeated rows
    give repeated links.
    """
    ship(traces.sparkSession)
    known = traces.where(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & F.col("ts_ns").isNotNull())
    ended = (F.col("ts_ns") + F.coalesce("duration_ns", F.lit(0))).cast("bigint")
    sides = F.inline(F.array(*[
        F.struct(at.cast("bigint").alias("at"), F.lit(made).alias("made"), F.col(body).alias("content"))
        for at, made, body in ((F.col("ts_ns"), False, "request_body"), (ended, True, "response_body"))
    ]))
    leaves = known.select("trace_id", "span_id", sides).where(F.octet_length("content") > 0).mapInArrow(_from_bodies, _LEAVES_DDL)
    urls = known.where(F.col("url").isNotNull()).select("trace_id", "span_id", F.col("ts_ns").cast("bigint").alias("at"), F.lit(False).alias("made"), F.inline(_in_url(F.col("url"))))
    fit = durable(leaves.unionByName(urls).where(F.length("value") >= max(shortest, 1)), "values")

    key = F.md5("value").alias("_value")
    outputs = fit.where("made").groupBy("trace_id", key, "span_id", "at").agg(F.min("place").alias("place")).withColumns({"made": F.lit(True), "value": F.lit(None).cast("string")})
    both = fit.where(~F.col("made")).withColumn("_value", key).unionByName(outputs)
    # At one moment inputs come first: a response that ends then is not before them.
    order = F.struct("at", "made", "span_id", "place").alias("_order")
    both = durable(both.select("trace_id", "_value", order, "span_id", "place", "value", "made"), "met")
    half = [F.when(F.col("made"), F.conv(F.substring("span_id", at, 8), 16, 10)).cast("bigint") for at in (1, 9)]
    told = {"_high": Last(half[0]), "_low": Last(half[1]), "_hash": Last(F.when(F.col("made"), F.xxhash64("place")))}
    linked = scan(both, ["trace_id", "_value"], "_order", told, partitions).where(~F.col("made") & F.col("_high").isNotNull())
    source = F.lower(F.concat(*[F.lpad(F.hex(part), 8, "0") for part in ("_high", "_low")]))
    places = fit.where("made").select(F.col("place").alias("source_place")).distinct().withColumn("_hash", F.xxhash64("source_place"))
    return linked.join(places, "_hash").select("trace_id", "span_id", "place", "value", source.alias("source_span_id"), "source_place")
