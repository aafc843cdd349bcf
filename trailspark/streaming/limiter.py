"""Rate limits with windows that the first hit opens: a batch replay, and the same rule as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, at double, hits long, allowed boolean, blocked_until double"


class Window:
    """State of one key: when its window ends, its hits, until when it is blocked."""

    def __init__(self, ends: float = 0.0, hits: int = 0, blocked: float = 0.0):
        self.ends, self.hits, self.blocked = ends, hits, blocked

    def hit(self, at: float, ttl: float, limit: int, block: float) -> tuple[int, bool, float]:
        if at < self.blocked:
            return self.hits, False, self.blocked
        if at >= self.ends:
            self.ends, self.hits, self.blocked = at + ttl, 0, 0.0
        self.hits += 1
        if self.hits > limit:
            self.blocked = at + block
            return self.hits, False, self.blocked
        return self.hits, True, 0.0


def replay(events: DataFrame, ttl: float, limit: int, block: float) -> DataFrame:
    """(key, at, hits, allowed, blocked_until) of each event (key, at seconds, seq), in order.

    Rows of a key stream through one task in order and only the window's state is held, so a hot key costs time but no memory.
    """
    n = events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = events.select("key", "at", "seq").repartition(int(n), "key").sortWithinPartitions("key", "at", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, w = None, Window()
        for pdf in frames:
            out = []
            for k, at in zip(pdf["key"], pdf["at"], strict=True):
                if k != key:
                    key, w = k, Window()
                out.append((k, at, *w.hit(at, ttl, limit, block)))
            yield pd.DataFrame(out, columns=["key", "at", "hits", "allowed", "blocked_until"])

    return placed.mapInPandas(run, OUT)


def stream(events: DataFrame, ttl: float, limit: int, block: float) -> DataFrame:
    """The same rule on a stream; a key's state goes when its window and block are over."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = Window(*state.get) if state.exists else Window()
        for pdf in frames:
            pdf = pdf.sort_values(["at", "seq"])
            yield pd.DataFrame([(key[0], at, *w.hit(at, ttl, limit, block)) for at in pdf["at"]], columns=["key", "at", "hits", "allowed", "blocked_until"])
        state.update((w.ends, w.hits, w.blocked))

    return events.groupBy("key").applyInPandasWithState(run, OUT, "ends double, hits long, blocked double", "append", GroupStateTimeout.NoTimeout)


def login_limit(events: DataFrame, limit: int = 10, ttl: float = 900.0) -> DataFrame:
    """(key, at, seq, reset) of sign-in attempts: hits in the window that the first one opened, which a reset closes; over the limit isn't allowed."""
    n = events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = events.select("key", "at", "seq", "reset").repartition(int(n), "key").sortWithinPartitions("key", "at", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ends, hits = None, 0.0, 0
        for pdf in frames:
            out = []
            for k, at, reset in zip(pdf["key"], pdf["at"], pdf["reset"], strict=True):
                if k != key or at >= ends:
                    key, ends, hits = k, at + ttl, 0
                if reset:
                    ends, hits = 0.0, 0
                else:
                    hits += 1
                out.append((k, at, hits, hits <= limit))
            yield pd.DataFrame(out, columns=["key", "at", "hits", "allowed"])

    return placed.mapInPandas(run, "key string, at double, hits long, allowed boolean")
