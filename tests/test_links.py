"""Causes of spans against a plain search over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from wirebook.operators.links import causal_parents

DDL = "trace_id string, span_id string, ts_ns bigint, duration_ns bigint, parent_span_id string, _end string"


def plain(rows):
    """Every row's parent, by looking at all spans of its trace."""
    found = []
    for trace, span, start, duration, *_ in rows:
        best = None
        if None not in (trace, span, start):
            end = start + (duration or 0)
            for other_trace, other, s, d, *_ in rows:
                if other_trace != trace or None in (other, s) or other == span:
                    continue
                e = s + (d or 0)
                if s <= start and e >= end and ((s, e) != (start, end) or other < span):
                    best = max(best or (s, -e, other), (s, -e, other))
        found.append((trace, span, best and best[2]))
    return sorted(found, key=str)


def told(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("longest", [3, 40, 2000])
def test_random_spans(spark, seed, longest):
    """One trace with most of the spans, over many tasks, beside small ones; ids use all 64 bits."""
    draw = random.Random(seed * 7919 + longest)
    rows = []
    for k in range(400):
        trace = "t" if draw.random() < 0.7 else f"s{draw.randrange(6)}"
        rows.append((trace, f"{draw.getrandbits(64):016x}", draw.randrange(600), draw.choice([None, draw.randrange(longest)]), "old", "x"))
    rows.append(("t", "8000000000000000", 0, 5000, None, None))  # encloses all of its trace
    rows += rows[:5]  # repeated
    rows += [(None, "0000000000000001", 1, 1, None, None), ("t", None, 1, 1, None, None), ("t", "0000000000000002", None, 1, None, None)]
    draw.shuffle(rows)
    assert told(causal_parents(spark.createDataFrame(rows, DDL), partitions=11)) == plain(rows)


@pytest.mark.parametrize("shape", ["nested", "beside", "alike", "falling"])
def test_extreme_shapes(spark, shape):
    spans = {
        "nested": lambda k: (k, 2 * (300 - k)), "beside": lambda k: (10 * k, 9), "alike": lambda k: (5, 5),
        "falling": lambda k: (k, 10_000 - 7 * k),
    }[shape]
    rows = [("t", f"{k:016x}", *spans(k), None, None) for k in range(300)]
    assert told(causal_parents(spark.createDataFrame(rows, DDL), partitions=8)) == plain(rows)


def test_no_spans(spark):
    assert causal_parents(spark.createDataFrame([], DDL)).count() == 0


def test_no_window_and_no_collect_over_a_trace(spark):
    frame = causal_parents(spark.range(1000).select(
        F.lit("t").alias("trace_id"), F.lpad(F.hex("id"), 16, "0").alias("span_id"), F.col("id").alias("ts_ns"), F.lit(3).alias("duration_ns")), partitions=5)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
