"""Shared parts of the stateful processors.

A processor sees one connection's rows of a micro-batch in any order, so it
sorts them; the source must deliver micro-batches in order. Connections that
fall silent are dropped after an idle time, so that state stays bounded.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirebook.session import ROCKSDB

IDLE_MS = 3_600_000

# Processors travel to the executors as they are; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["wirebook"])


class ConnectionProcessor(StatefulProcessor):
    """Keeps one picklable value per connection, with a time to live."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cell = handle.getValueState("connection", "content BINARY", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.cell.get()[0]) if self.cell.exists() else self.fresh()
        batch = pd.concat(list(rows)).sort_values("seq")
        found = []
        for row in batch.itertuples(index=False):
            found.extend(self.step(state, row))
        if self.is_empty(state):
            self.cell.clear()
        else:
            self.cell.update((pickle.dumps(state),))
        if found:
            out = pd.DataFrame(found)
            out.insert(0, "conn_id", key[0])
            yield out

    def close(self) -> None:
        pass

    def fresh(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, row: Any) -> list[dict]:
        """Take in one row; return finished records."""
        raise NotImplementedError

    def is_empty(self, state: dict) -> bool:
        raise NotImplementedError


def per_connection(rows: DataFrame, processor: ConnectionProcessor, ddl: str) -> DataFrame:
    provider = rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return rows.groupBy("conn_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=ddl, outputMode="append", timeMode="ProcessingTime",
    )
