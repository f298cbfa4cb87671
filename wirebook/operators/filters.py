"""The trace filter: every set field must match, unset fields match everything."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirebook.params import StatusRange, parse_method, parse_time_ns, parse_trace_id

_DAY_NS = 86_400_000_000_000


def method_in(methods: list[str], method: Column) -> Column:
    return method.isin(list(methods)) if methods else F.lit(True)


def status_between(status: StatusRange, code: Column) -> Column:
    return code.between(status.low, status.high)


def url_contains(pattern: str, url: Column, ignore_case: bool = True) -> Column:
    """Substring test; ``%`` and ``_`` in the pattern mean themselves."""
    if ignore_case:
        return F.contains(F.lower(url), F.lower(F.lit(pattern)))
    return F.contains(url, F.lit(pattern))


def failed(code: Column) -> Column:
    return code >= 400


def day_of(ns: int) -> dt.date:
    """The UTC day; days outside of the calendar read as its first or last."""
    first = dt.date(1970, 1, 1)
    days = min(max(ns // _DAY_NS, (dt.date.min - first).days), (dt.date.max - first).days)
    return first + dt.timedelta(days=days)


def _bigint(ns: int) -> int:
    return min(max(ns, -(1 << 63)), (1 << 63) - 1)


@dataclass(frozen=True)
class TraceQuery:
    """A stored query. ``limit`` 0 means the store's default page. ``after`` is
    the (ts_ns, span_id) of the last row of the page before."""

    methods: tuple[str, ...] = ()
    status: StatusRange | None = None
    url_contains: str | None = None
    since_ns: int | None = None
    until_ns: int | None = None
    trace_id: str | None = None
    limit: int = 0
    offset: int = 0
    after: tuple[int, str] | None = None

    def __post_init__(self):
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset must not be negative")

    @classmethod
    def parse(
        cls,
        methods: list[str] | None = None,
        status: str | None = None,
        url_contains: str | None = None,
        since: str | None = None,
        until: str | None = None,
        trace_id: str | None = None,
        limit: int = 0,
        offset: int = 0,
        now_ns: int | None = None,
    ) -> "TraceQuery":
        """From user input; bad input raises ValueError."""
        return cls(
            methods=tuple(parse_method(m) for m in methods or ()),
            status=StatusRange.parse(status) if status is not None else None,
            url_contains=url_contains,
            since_ns=parse_time_ns(since, now_ns) if since is not None else None,
            until_ns=parse_time_ns(until, now_ns) if until is not None else None,
            trace_id=parse_trace_id(trace_id) if trace_id is not None else None,
            limit=limit,
            offset=offset,
        )

    def with_page(self, limit: int, offset: int = 0) -> "TraceQuery":
        return replace(self, limit=limit, offset=offset)

    def predicate(self, has_dt: bool = True, newest: bool = False) -> Column:
        """The filter as a column. Time bounds also become bounds on the
        partition column, which the optimizer cannot derive from ``ts_ns``.
        ``newest`` is the order that ``after`` refers to."""
        parts = []
        if self.methods:
            parts.append(method_in(list(self.methods), F.col("method")))
        if self.status is not None:
            parts.append(status_between(self.status, F.col("status_code")))
        if self.url_contains is not None:
            parts.append(url_contains(self.url_contains, F.col("url")))
        if self.since_ns is not None:
            parts.append(F.col("ts_ns") >= F.lit(_bigint(self.since_ns)))
            if has_dt:
                parts.append(F.col("dt") >= F.lit(day_of(self.since_ns)))
        if self.until_ns is not None:
            parts.append(F.col("ts_ns") <= F.lit(_bigint(self.until_ns)))
            if has_dt:
                parts.append(F.col("dt") <= F.lit(day_of(self.until_ns)))
        if self.trace_id is not None:
            parts.append(F.col("trace_id") == self.trace_id)
        if self.after is not None:
            ts_ns, span_id = self.after
            if self.trace_id is not None and not newest:
                parts.append(F.col("span_id") > span_id)
            else:
                parts.append((F.col("ts_ns") < ts_ns) | ((F.col("ts_ns") == ts_ns) & (F.col("span_id") < span_id)))
                if has_dt:
                    parts.append(F.col("dt") <= F.lit(day_of(ts_ns)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))
