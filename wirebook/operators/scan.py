"""Running values over long, skewed groups, several in one pass.

A window over a key puts a whole group into one task, and one group may hold a
third of all rows. Here rows are dealt out by ranges of (keys, order), so that
every task gets an equal share however dense a group's order values are. A task
goes through its sorted rows once, batch by batch. Only its first group can have
begun in a task before: of each task one narrow row tells what its last group
amounts to, these rows are put together in order, and what a first group takes
over is combined with its rows. Every value is an associative operation, so a
task's part need not know what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.session import durable, release, ship

#: No value; less than any other.
NONE = np.iinfo(np.int64).min

Parts = tuple[np.ndarray, ...]


class Running:
    """One running value. ``inputs`` are BIGINT columns, ``parts`` the numbers that one element consists of.

    ``before`` leaves the row itself out.
    """

    parts = 1
    identity: tuple[int, ...] = (NONE,)

    def __init__(self, *inputs: Column, before: bool = False):
        self.inputs = [i.cast("bigint") for i in inputs]
        self.before = before

    def worker(self) -> Running:
        """The operation without its columns, which stay with the driver."""
        bare = object.__new__(type(self))
        bare.before = self.before
        return bare

    def elements(self, values: list[np.ndarray]) -> Parts:
        return (values[0],)

    def combine(self, left: Parts, right: Parts) -> Parts:
        raise NotImplementedError

    def results(self, name: str, here: list[Column], carried: list[Column]) -> list[Column]:
        raise NotImplementedError


class Sum(Running):
    """Null counts as nothing; 0 where there is nothing."""

    identity = (0,)

    def elements(self, values):
        return (np.where(values[0] == NONE, 0, values[0]),)

    def combine(self, left, right):
        return (left[0] + right[0],)

    def results(self, name, here, carried):
        return [(F.coalesce(carried[0], F.lit(0)) + here[0]).alias(name)]


class Max(Running):
    def combine(self, left, right):
        return (np.maximum(left[0], right[0]),)

    def results(self, name, here, carried):
        return [F.greatest(carried[0], here[0]).alias(name)]


class Last(Running):
    """The last value that is not null."""

    def combine(self, left, right):
        return (np.where(right[0] == NONE, left[0], right[0]),)

    def results(self, name, here, carried):
        return [F.coalesce(here[0], carried[0]).alias(name)]


class FirstSince(Running):
    """The first value after the last reset (a row where the second column is 1), if there is one."""

    parts = 2
    identity = (NONE, 0)

    def elements(self, values):
        reset = (values[1] == 1).astype(np.int64)
        return np.where(reset == 1, NONE, values[0]), reset

    def combine(self, left, right):
        earlier = np.where(left[0] == NONE, right[0], left[0])
        return np.where(right[1] == 1, right[0], earlier), left[1] | right[1]

    def results(self, name, here, carried):
        return [F.when(here[1] == 1, here[0]).otherwise(F.coalesce(carried[0], here[0])).alias(name)]


class SumSince(Running):
    """The sum from the last reset (a row where the second column is 1) on, that row included."""

    parts = 2
    identity = (0, 0)

    def elements(self, values):
        return np.where(values[0] == NONE, 0, values[0]), (values[1] == 1).astype(np.int64)

    def combine(self, left, right):
        return np.where(right[1] == 1, right[0], left[0] + right[0]), left[1] | right[1]

    def results(self, name, here, carried):
        return [F.when(here[1] == 1, here[0]).otherwise(F.coalesce(carried[0], F.lit(0)) + here[0]).alias(name)]


class Machine(Running):
    """A machine of four states, 0 to 3, beginning in state 0. Gives its state and how many rounds it ended.

    The column is a transition code: bits 2s and 2s + 1 hold the state that
    follows state s, bit 8 + s whether that ends a round. Null changes nothing.
    An element is such a function of all four states, so that a task's part is
    known before it is known which state it begins in.
    """

    parts = 5
    STAY = 0 | 1 << 2 | 2 << 4 | 3 << 6
    identity = (STAY, 0, 0, 0, 0)

    def elements(self, values):
        code = np.where(values[0] == NONE, self.STAY, values[0])
        return code & 0xFF, *((code >> (8 + s)) & 1 for s in range(4))

    def combine(self, left, right):
        follows, ended = np.zeros_like(left[0]), []
        for s in range(4):
            middle = (left[0] >> (2 * s)) & 3
            follows |= ((right[0] >> (2 * middle)) & 3) << (2 * s)
            ended.append(left[1 + s] + np.choose(middle, right[1:]))
        return follows, *ended

    def results(self, name, here, carried):
        begin = F.coalesce(carried[0].bitwiseAND(F.lit(3)), F.lit(0)).cast("int")
        state = F.when(begin == 0, here[0]).when(begin == 1, F.shiftright(here[0], 2)).when(begin == 2, F.shiftright(here[0], 4)).otherwise(F.shiftright(here[0], 6))
        rounds = F.coalesce(carried[1], F.lit(0)) + F.get(F.array(*here[1:]), begin)
        return [state.bitwiseAND(F.lit(3)).cast("int").alias(name), rounds.alias(f"{name}_round")]


def prefix(parts: Parts, begins: np.ndarray, combine) -> Parts:
    """Every row's elements from its group's begin on, combined; in as many steps as the longest group's logarithm."""
    place = np.arange(len(begins)) - begins
    longest, reach = int(place.max(initial=0)), 1
    while reach <= longest:
        at = np.flatnonzero(place >= reach)
        step = combine(tuple(p[at - reach] for p in parts), tuple(p[at] for p in parts))
        parts = tuple(p.copy() for p in parts)
        for p, new in zip(parts, step, strict=True):
            p[at] = new
        reach *= 2
    return parts


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(int(NONE)) if column.null_count else column)


def _column(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=numbers == NONE)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row's key differs from the row's before it."""
    new = np.zeros(len(columns[0]), bool)
    for column in columns:
        codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _pass(operations: list[Running], keys: list[int], inputs: list[list[int]], kept: list[int], names: list[str]):
    """Go through a task's sorted rows once; its last rows tell of its first and its last group."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        open_key, first_key, only, held = None, None, True, [op.identity for op in operations]
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_columns = [batch.column(k) for k in keys]
            new = changes(key_columns)
            begin_key = tuple(c[0].as_py() for c in key_columns)
            continues = open_key is not None and begin_key == open_key
            first_key = begin_key if first_key is None else first_key
            begins = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            ours = begins == 0  # rows of the batch's first group
            out = []
            for n, op in enumerate(operations):
                own = op.elements([_numbers(batch.column(i)) for i in inputs[n]])
                own = prefix(tuple(np.array(p, np.int64) for p in own), begins, op.combine)
                if continues:
                    took = op.combine(tuple(np.full(ours.sum(), h, np.int64) for h in held[n]), tuple(p[ours] for p in own))
                    for p, t in zip(own, took, strict=True):
                        p[ours] = t
                shown = own
                if op.before:
                    shown = tuple(np.concatenate([[h if continues else e], p[:-1]]) for p, h, e in zip(own, held[n], op.identity, strict=True))
                    for p, e in zip(shown, op.identity, strict=True):
                        p[new] = e
                held[n] = tuple(int(p[-1]) for p in own)
                out += [_column(p) for p in shown]
            in_first = ours & bool(only and (open_key is None or continues))
            only = bool(only and in_first.all())
            open_key = tuple(c[-1].as_py() for c in key_columns)
            rows = pa.RecordBatch.from_arrays([
                *[batch.column(k) for k in kept], *out, pa.array(np.where(in_first, task, -1).astype(np.int32)),
                pa.array(np.zeros(len(new), np.int8)), pa.nulls(len(new), pa.bool_()),
            ], names)
            schema = rows.schema
            yield rows
        if schema is not None:
            ends = [dict(zip((names[kept.index(k)] for k in keys), key, strict=True)) for key in (first_key, open_key)]
            values = {name: None if v == NONE else v for name, v in zip(names[len(kept) : -3], (v for h in held for v in h), strict=True)}
            yield pa.RecordBatch.from_pylist([{**ends[0], "_task": task, "_kind": 1}, {**ends[1], **values, "_task": task, "_kind": 2, "_only": only}], schema)
        release()

    return go


def _carried(ends: list, keys: list[str], operations: list[Running], parts: list[list[str]]) -> list[tuple]:
    """What each task's first group takes over from the tasks before it, where there is anything."""
    of_task: dict[int, dict] = {}
    for r in ends:
        own = of_task.setdefault(r["_task"], {})
        if r["_kind"] == 1:
            own["first"] = tuple(r[k] for k in keys)
        else:
            own["last"], own["only"] = tuple(r[k] for k in keys), r["_only"]
            own["held"] = [tuple(np.array([NONE if r[p] is None else r[p]]) for p in names) for names in parts]
    found, open_key, held = [], None, None
    for task in sorted(of_task):
        own = of_task[task]
        continues = open_key is not None and own["first"] == open_key
        if continues:
            found.append((task, *(None if v[0] == NONE else int(v[0]) for h in held for v in h)))
        if continues and own["only"]:
            held = [op.combine(a, b) for op, a, b in zip(operations, held, own["held"], strict=True)]
        else:
            open_key, held = own["last"], own["held"]
    return found


def scan(df: DataFrame, keys: list[str], order: str, values: dict[str, Running], partitions: int | None = None) -> DataFrame:
    """Add running values per ``keys`` in the order of ``order``, which no two rows of a key share.

    ``df`` should be narrow, and written already: it is read twice, once for
    the ranges. One range shuffle serves all values. ``partitions`` is the
    number of ranges; by default the session's, joined where they are small.
    """
    ship(df.sparkSession)
    operations = [v.worker() for v in values.values()]
    inputs = [[f"_in_{name}_{i}" for i in range(len(v.inputs))] for name, v in values.items()]
    parts = [[f"_part_{name}_{i}" for i in range(v.parts)] for name, v in values.items()]
    fed = df.select("*", *[c.alias(n) for v, names in zip(values.values(), inputs, strict=True) for c, n in zip(v.inputs, names, strict=True)])
    dealt = fed.repartitionByRange(partitions, *keys, order) if partitions else fed.repartitionByRange(*keys, order)
    ordered = dealt.sortWithinPartitions(*keys, order)
    columns, place = fed.columns, {c: i for i, c in enumerate(fed.columns)}
    names = [*df.columns, *[p for names in parts for p in names], "_task", "_kind", "_only"]
    run = _pass(operations, [place[k] for k in keys], [[place[n] for n in own] for own in inputs], [place[c] for c in df.columns], names)
    assert columns[: len(df.columns)] == df.columns
    ddl = ", ".join([
        *[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{p}` bigint" for own in parts for p in own],
        "_task int", "_kind tinyint", "_only boolean",
    ])
    local = durable(ordered.mapInArrow(run, ddl), "scan")
    # Two rows for each task.
    ends = local.where("_kind > 0").select(*keys, *[p for own in parts for p in own], "_task", "_kind", "_only").collect()
    carried = _carried(ends, keys, operations, parts)
    rows = local.where("_kind = 0")
    if carried:
        # At most one row for each task.
        taken = df.sparkSession.createDataFrame(carried, ", ".join(["_task int", *[f"`_over{p}` bigint" for own in parts for p in own]]))
        rows = rows.join(F.broadcast(taken), "_task", "left")
    results = []
    for (name, value), own in zip(values.items(), parts, strict=True):
        over = [F.col(f"_over{p}") if carried else F.lit(None).cast("bigint") for p in own]
        results += value.results(name, [F.col(p) for p in own], over)
    return rows.select(*df.columns, *results)
