"""HTTP/2 exchanges from decoded frames.

Input is the ``h2_frames`` table. As for HTTP/1.x, order-dependent steps are
scans over narrow rows. What a connection keeps in mind is put as associative
state: the last unfinished header block of each direction, and for each stream
id a machine of four states whose rounds are the streams that the id stood for,
one after the other. Payloads are joined back on their unique key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.functions.http import trace_ids
from wirebook.functions.text import present
from wirebook.operators.gather import PACKED_BYTES, packed, put_together, unpacked
from wirebook.operators.scan import Last, Machine, Max, Sum, scan
from wirebook.schema import BUFFER_LIMIT
from wirebook.session import durable, tasks_for
from wirebook.sources.tables import with_storage_columns

# Fixed values of the protocol.
DATA, HEADERS, CONTINUATION = 0, 1, 9
END_STREAM, END_HEADERS, PADDED, PRIORITY = 0x1, 0x4, 0x8, 0x20

#: A stream id of a connection between two closes, and one stream that it stood for.
STREAM = ["conn_id", "epoch", "stream_id"]
ROUND = [*STREAM, "round"]
SIDES = ["request_body", "response_body"]


def _flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bit)) != 0


def _pad_size(payload: Column) -> Column:
    return F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")


def data_range(payload: Column) -> tuple[Column, Column]:
    """(offset, size) of the data in a DATA payload, padding removed."""
    total = F.octet_length(payload)
    padded = _flag(PADDED) & (total > 0)
    return (
        F.when(padded, F.lit(1)).otherwise(F.lit(0)),
        F.when(padded, F.greatest(total - 1 - _pad_size(payload), F.lit(0))).otherwise(total),
    )


def header_block_range(payload: Column) -> tuple[Column, Column]:
    """(offset, size) of the header block in a HEADERS payload, without padding and priority."""
    total = F.octet_length(payload)
    padded = _flag(PADDED)
    offset = F.when(padded, 1).otherwise(0) + F.when(_flag(PRIORITY), 5).otherwise(0)
    end = F.when(padded, F.greatest(total - _pad_size(payload), F.lit(0))).otherwise(total)
    usable = (offset <= end) & ~(padded & (total == 0))
    return F.when(usable, offset).otherwise(F.lit(0)), F.when(usable, end - offset).otherwise(F.lit(0))


#: An unsigned 16-bit number, with the range checked apart.
STATUS = r"\A\+?0*[0-9]{1,5}\z"


def narrow_frames(frames: DataFrame) -> DataFrame:
    """The frames that matter, without payloads and header fields.

    ``status`` is 1 for a good status among a frame's header fields, 0 for a
    bad one, and null where there is none; the last one counts.
    """
    c = F.col
    is_close = c("dir") == "close"
    _, size = data_range(c("payload"))
    status = F.try_element_at(F.filter("headers", lambda h: h["name"] == ":status"), F.lit(-1))["value"]
    good = status.rlike(STATUS) & (status.try_cast("int") <= 65535)
    return frames.where(
        is_close | ((c("stream_id") > 0) & c("frame_type").isin(DATA, HEADERS, CONTINUATION))
    ).select(
        "conn_id", "seq", "ts_ns", "dir", "tls", "stream_id", "frame_type",
        _flag(END_STREAM).alias("end_stream"), _flag(END_HEADERS).alias("end_headers"),
        F.when(c("frame_type") == DATA, size.cast("bigint")).alias("size"),
        F.when(status.isNotNull(), F.coalesce(good, F.lit(False)).cast("int")).alias("status"),
    )


def tag_frames(narrow: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add the connection's epoch (number of its last close) and the header
    block each frame belongs to.

    A connection has one unfinished header block per direction: a HEADERS frame
    without an end replaces it, and a CONTINUATION frame goes on with it if it
    has its stream id. ``block_start`` is the HEADERS frame that opened the
    block, null for a CONTINUATION that continues nothing; ``ends`` says that
    the block or DATA frame ends the stream.
    """
    c = F.col
    unfinished = (c("frame_type") == HEADERS) & ~c("end_headers")
    values = {"last_close": Max(F.when(c("dir") == "close", c("seq")), before=True)}
    for way in ("out", "in"):
        opens = unfinished & (c("dir") == way)
        # The last bit of the code carries END_STREAM of the opening frame.
        values[f"{way}_opened"] = Max(F.when(opens, c("seq") * 2 + c("end_stream").cast("int")))
        values[f"{way}_stream"] = Last(F.when(opens, c("stream_id")))
    lined = scan(narrow, ["conn_id"], "seq", values, partitions).withColumns({
        "epoch": F.coalesce("last_close", F.lit(-1)),
        "opened": F.when(c("dir") == "out", c("out_opened")).otherwise(c("in_opened")),
        "opened_stream": F.when(c("dir") == "out", c("out_stream")).otherwise(c("in_stream")),
    })
    begun = F.call_function("div", c("opened"), F.lit(2))
    continues = (c("frame_type") == CONTINUATION) & (c("opened_stream") == c("stream_id")) & (begun > c("epoch"))
    return lined.select(
        *STREAM, "seq", "ts_ns", "dir", "tls", "frame_type", "size", "status", "end_headers",
        F.when(c("frame_type") == HEADERS, c("seq")).when(continues, begun).alias("block_start"),
        F.when(c("frame_type") == CONTINUATION, c("opened") % 2 == 1).otherwise(c("end_stream")).alias("ends"),
    )


def header_blocks(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed header blocks as events (seq is that of the frame that
    completed it), and the frames of those that have more than one."""
    c = F.col
    whole = tagged.where((c("frame_type") == HEADERS) & c("end_headers"))
    split = tagged.where("block_start IS NOT NULL").where((c("frame_type") == CONTINUATION) | ~c("end_headers"))
    block = [*STREAM, "dir", "block_start"]
    # What comes for a block after the frame that completed it belongs to nothing.
    applied = split.where("end_headers").groupBy(*block).agg(F.min("seq").alias("applied_seq"))
    members = durable(split.join(applied, block).where("seq <= applied_seq"), "blocks")
    at_end = c("seq") == c("applied_seq")
    ended = members.groupBy(*block).agg(
        F.max("applied_seq").alias("seq"), F.max(F.when(at_end, c("ts_ns"))).alias("ts_ns"),
        F.max(F.when(at_end, c("tls"))).alias("tls"), F.max(F.when(at_end, c("ends"))).alias("ends"),
        F.max_by("status", F.when(c("status").isNotNull(), c("seq"))).alias("status"),
    )
    columns = [*STREAM, "seq", "ts_ns", "dir", "tls", "block_start", "ends", "status"]
    return whole.select(*columns).unionAll(ended.select(*columns)), members


# States of a stream id: no stream; and one with no status yet and no end of
# the response, a status but no end, an end but no status.
ABSENT, OPEN, STATUS_ONLY, END_ONLY = range(4)
_OF = {ABSENT: (False, False), OPEN: (False, False), STATUS_ONLY: (True, False), END_ONLY: (False, True)}
_AS = {has: state for state, has in _OF.items() if state != ABSENT}


def transition(creates: bool, status: int | None, ends: bool) -> int:
    """The code of an event. A stream with a good status and an ended response
    is complete, which ends the round; a bad status takes a good one back."""
    code = 0
    for state, (has_status, has_end) in _OF.items():
        follows, complete = state, False
        if creates or state != ABSENT:
            has = (has_status if status is None else bool(status), has_end or ends)
            complete = has == (True, True)
            follows = ABSENT if complete else _AS[has]
        code |= follows << (2 * state) | complete << (8 + state)
    return code


def _transition(is_block: Column) -> Column:
    c = F.col
    incoming, ends = c("dir") == "in", F.coalesce(c("ends"), F.lit(False))
    code = F.when(is_block & ~incoming, transition(True, None, False))
    for status in (None, 0, 1):
        here = c("status").isNull() if status is None else c("status") == status
        for end in (False, True):
            code = code.when(is_block & incoming & here & (ends == end), transition(True, status, end))
    return code.when(~is_block & incoming & ends, transition(False, None, True)).otherwise(Machine.STAY)


def stream_events(tagged: DataFrame, blocks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Completed header blocks and DATA frames of live streams, with the
    ``round`` of their stream id; ``state`` is the one after the event,
    ``completes`` tells that it completed the stream, ``sent`` and ``received``
    count the stream id's bytes up to it."""
    c = F.col
    nothing = F.lit(None)
    events = durable(
        blocks.withColumn("size", nothing.cast("bigint")).unionByName(
            tagged.where(c("frame_type") == DATA).select(*STREAM, "seq", "ts_ns", "dir", "tls", "ends", "size").withColumns({
                "block_start": nothing.cast("bigint"), "status": nothing.cast("int"),
            })
        ), "events")
    code = _transition(c("block_start").isNotNull())
    stepped = scan(events, STREAM, "seq", {
        "state": Machine(code), "earlier": Machine(code, before=True),
        "sent": Sum(F.when(c("dir") == "out", c("size"))), "received": Sum(F.when(c("dir") == "in", c("size"))),
    }, partitions)
    # Data for a stream id that stands for no stream is not kept.
    return stepped.where((c("earlier") != ABSENT) | c("block_start").isNotNull()).select(
        *STREAM, c("earlier_round").alias("round"), "seq", "ts_ns", "dir", "tls", "block_start", "size", "state", "sent", "received",
        (c("state_round") > c("earlier_round")).alias("completes"),
    )


def stream_spans(events: DataFrame, closes: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per stream that yields a trace: when it began, and when it was
    complete or its connection closed; a close completes every stream that has a status."""
    c = F.col
    spans = durable(events.groupBy(*ROUND).agg(
        F.min(F.struct("seq", "ts_ns", "tls")).alias("born"),
        F.max(F.when(c("completes"), c("ts_ns"))).alias("last_ns"),
        F.max_by("state", "seq").alias("state"),
        F.sum(F.when(c("dir") == "out", c("size"))).alias("request_bytes"),
        F.sum(F.when(c("dir") == "in", c("size"))).alias("response_bytes"),
        F.min(F.when(c("dir") == "out", c("sent") - c("size"))).alias("sent_before"),
        F.min(F.when(c("dir") == "in", c("received") - c("size"))).alias("received_before"),
    ), "streams")
    open_ = spans.where((c("state") == STATUS_ONLY) & c("last_ns").isNull()).drop("last_ns")
    nothing = F.lit(None).cast("bigint")
    # From behind: what follows a stream's birth next is the close that ends it.
    births = open_.select("conn_id", (c("born.seq") * -1).alias("back"), *ROUND[1:], nothing.alias("close_ns"))
    ends = closes.select("conn_id", (c("seq") * -1).alias("back"), *[F.lit(None).cast(births.schema[n].dataType).alias(n) for n in ROUND[1:]], c("ts_ns").alias("close_ns"))
    behind = scan(births.unionAll(ends), ["conn_id"], "back", {"last_ns": Last(c("close_ns"))}, partitions)
    closed = open_.join(behind.where("round IS NOT NULL AND last_ns IS NOT NULL").select(*ROUND, "last_ns"), ROUND)
    done = spans.where("last_ns IS NOT NULL").unionByName(closed)
    return done.withColumns({"born_seq": c("born.seq"), "born_ns": c("born.ts_ns"), "tls": c("born.tls")}).drop("born", "state")


def stream_headers(frames: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """(stream, request, response) header maps, pseudo-headers included.

    Every name keeps its last value. The last value is found by an aggregate
    that combines map-side, so a stream with endless header frames is no
    single task's problem.
    """
    c = F.col
    owners = events.where("block_start IS NOT NULL").select(*ROUND, "dir", c("seq").alias("applied_seq"), "block_start")
    whole = owners.where("applied_seq = block_start").withColumn("seq", c("block_start"))
    parts = members.select("conn_id", "dir", "block_start", "applied_seq", "seq")
    split = owners.where("applied_seq <> block_start").join(parts, ["conn_id", "dir", "block_start", "applied_seq"])
    used = whole.unionByName(split.select(*whole.columns))
    fields = used.join(
        frames.where(c("frame_type").isin(HEADERS, CONTINUATION)).select("conn_id", "seq", "headers"), ["conn_id", "seq"]
    ).select(*ROUND, "dir", "applied_seq", "seq", F.posexplode("headers").alias("position", "header"))
    latest = fields.groupBy(*ROUND, "dir", c("header.name").alias("name")).agg(
        F.max_by("header.value", F.struct("applied_seq", "seq", "position")).alias("value")
    )
    pair = F.struct("name", "value")
    return latest.groupBy(*ROUND).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(c("dir") == "out", pair)))).alias("request"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(c("dir") == "in", pair)))).alias("response"),
    )


@dataclass(frozen=True)
class Dealing:
    """The tasks that payloads are dealt to, None for the session's number, and whether they are packed for it."""

    partitions: int | None = None
    long: bool = False


def data_bytes(frames: DataFrame, data: DataFrame, way: Dealing) -> DataFrame:
    """DATA events with their ``bytes``, joined on their unique key; of long ones, packed with their size in ``full``."""
    offset, size = data_range(F.col("payload"))
    piece = F.substring(F.col("payload"), offset + 1, size).alias("bytes")
    payloads = frames.where((F.col("frame_type") == DATA) & (size > 0)).select("conn_id", "seq", piece)
    payloads = packed(payloads, "bytes") if way.long else payloads
    payloads = payloads.repartition(way.partitions, "conn_id", "seq") if way.partitions else payloads
    # The narrow side is the one kept in memory, so that payloads are not sorted for the join.
    return payloads.join(data.hint("shuffle_hash"), ["conn_id", "seq"])


def body_pieces(frames: DataFrame, events: DataFrame, spans: DataFrame, longest: int, way: Dealing = Dealing()) -> DataFrame:  # noqa: B008
    """(stream, side, place, bytes): DATA between birth and completion, of bodies up to ``longest`` bytes."""
    c = F.col
    fits = lambda way, name: (c("dir") == way) & (c(name) <= longest)
    sizes = spans.select(*ROUND, "request_bytes", "response_bytes")
    kept = events.where("size > 0").select(*ROUND, "seq", "dir").join(sizes, ROUND).where(fits("out", "request_bytes") | fits("in", "response_bytes"))
    side = F.when(c("dir") == "out", 0).otherwise(1)
    found = data_bytes(frames, kept.select(*ROUND, "seq", side.alias("side")), way)
    return found.select(*ROUND, "side", c("seq").alias("place"), "bytes", *[n for n in ("full",) if n in found.columns])


def stream_bodies(frames: DataFrame, events: DataFrame, spans: DataFrame, longest: int) -> DataFrame:
    """(stream, request_body, response_body) of the streams that have one, up to ``longest`` bytes a body."""
    found = put_together(spans.select(*ROUND), body_pieces(frames, events, spans, longest), ROUND, SIDES)
    return found.where("request_body IS NOT NULL OR response_body IS NOT NULL")


def _plain(headers: Column) -> Column:
    return F.map_filter(headers, lambda name, _: ~F.startswith(name, F.lit(":")))


def _ids() -> tuple[Column, Column]:
    return trace_ids(*[F.col(name).cast("string") for name in (*STREAM, "born_seq")])


def stream_traces(streams: DataFrame) -> DataFrame:
    """Trace rows of finished streams."""
    c = F.col
    trace_id, span_id = _ids()
    scheme = F.coalesce(c("request")[":scheme"], F.when(c("tls"), F.lit("https")).otherwise(F.lit("http")))
    sizes = [
        (F.when(c(f"{side}_bytes") > 0, c(f"{side}_bytes")) if f"{side}_bytes" in streams.columns
         else F.octet_length(present(c(f"{side}_body"))).cast("bigint")).alias(f"{side}_body_bytes")
        for side in ("request", "response")
    ]
    return with_storage_columns(streams.select(
        span_id.alias("span_id"), trace_id.alias("trace_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.coalesce(c("request")[":method"], F.lit("GET")).alias("method"),
        F.concat(
            scheme, F.lit("://"), F.coalesce(c("request")[":authority"], F.lit("")),
            F.coalesce(c("request")[":path"], F.lit("/")),
        ).alias("url"),
        _plain(c("request")).alias("request_headers"),
        present(c("request_body")).alias("request_body"),
        c("response")[":status"].try_cast("int").alias("status_code"),
        _plain(c("response")).alias("response_headers"),
        present(c("response_body")).alias("response_body"),
        *sizes,
        c("born_ns").alias("ts_ns"),
        F.greatest(c("last_ns") - c("born_ns"), F.lit(0)).alias("duration_ns"),
        F.lit(None).cast("string").alias("source_addr"), F.lit(None).cast("string").alias("dest_addr"),
        F.lit("HTTP/2").alias("protocol_version"),
        c("conn_id").alias("capture_id"),
    ))


def _streams(frames: DataFrame, partitions: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans, events and the frames of split header blocks."""
    return _dealt_streams(frames, partitions)[:3]


def _dealt_streams(frames: DataFrame, partitions: int | None) -> tuple[DataFrame, DataFrame, DataFrame, Dealing]:
    """:func:`_streams`, and how their payloads are dealt."""
    narrow = durable(narrow_frames(frames), "narrow-frames")
    rows, data, size = narrow.agg(F.count("*"), F.count("size"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if partitions is None:
        partitions = tasks_for(narrow.sparkSession, rows, size)
    tagged = tag_frames(narrow, partitions)
    blocks, members = header_blocks(tagged)
    events = stream_events(tagged, blocks, partitions)
    spans = stream_spans(events, narrow.where("dir = 'close'"), partitions)
    return spans, events, members, Dealing(partitions, 0 < data * PACKED_BYTES <= size)


def http2_exchanges(frames: DataFrame, partitions: int | None = None, longest: int = BUFFER_LIMIT) -> DataFrame:
    """Traces of all streams that were answered in full, or had a status when
    the connection closed.

    A body is put together up to ``longest`` bytes. A longer one is null, with
    its size in the row and its bytes in ``http2_body_parts``.
    """
    spans, events, members, way = _dealt_streams(frames, partitions)
    headers = stream_headers(frames, events, members)
    pieces = body_pieces(frames, events, spans, longest, way)
    return stream_traces(put_together(spans.join(headers, ROUND), pieces, ROUND, SIDES, way.partitions))


def http2_body_parts(frames: DataFrame, partitions: int | None = None) -> DataFrame:
    """``span_id, side, part, at, bytes``: the bodies of all streams of any
    size, in the order of ``part``; ``at`` counts the bytes of a body before."""
    c = F.col
    spans, events, _, way = _dealt_streams(frames, partitions)
    _, span_id = _ids()
    before = spans.select(*ROUND, span_id.alias("span_id"), "sent_before", "received_before")
    data = events.where("size > 0").join(before, ROUND)
    at = F.when(c("dir") == "out", c("sent") - c("size") - c("sent_before")).otherwise(c("received") - c("size") - c("received_before"))
    side = F.when(c("dir") == "out", F.lit("request")).otherwise(F.lit("response"))
    placed = data.select("span_id", side.alias("side"), "conn_id", "seq", at.alias("at"))
    found = data_bytes(frames, placed, way)
    found = unpacked(found, "bytes") if way.long else found
    return found.select("span_id", "side", c("seq").alias("part"), "at", "bytes")
