"""The per-session burst rule, in replay over a table and as a streaming operator with state.

A qualifying event counts; a gap of more than `gap` seconds since the last one starts the count anew. At `least` events, unless
the last denial is less than `quiet` seconds ago, the event is denied and the count starts anew. A reset event sets the
count to 0 and leaves the time of the last event as it is.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Burst:
    gap: float = 600.0
    quiet: float = 120.0
    least: int = 3

    def step(self, state: tuple[int, float, float], when: float, kind: str) -> tuple[tuple[int, float, float], bool]:
        """(count, last_seen, last_deny) after an event at `when`, and whether it is denied. kind: "count" or "reset"."""
        count, seen, deny = state
        if kind == "reset":
            return (0, seen, deny), False
        count = 1 if when - seen > self.gap else count + 1
        if count >= self.least and when - deny >= self.quiet:
            return (0, when, when), True
        return (count, when, deny), False


FRESH = (0, float("-inf"), float("-inf"))


def sane(state: tuple, now: float, slack: float = 60.0) -> tuple[int, float, float]:
    """A stored state, or a fresh one if a field is malformed: no whole count of 0 or more, or a time that is not past."""
    try:
        count, seen, deny = int(state[0]), float(state[1]), float(state[2])
    except (TypeError, ValueError, IndexError):
        return FRESH
    ok = count >= 0 and all(t == float("-inf") or 0 <= t <= now + slack for t in (seen, deny))
    return (count, seen, deny) if ok else FRESH


def replay(events: DataFrame, rule: Burst, session: str, when: str, order: list[str], kind: str) -> DataFrame:
    """events with denied and count after each, in order (when, order) of a session. kind null leaves state as it is.

    Events stream through a task sorted by session and time, so a session of any length needs the memory of one state.
    """
    columns = events.columns
    prepared = events.withColumn("__at", F.unix_micros(F.col(when).cast("timestamp")) / 1e6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), FRESH
        for batch in batches:
            denied, counts = [], []
            for s, t, k in zip(batch[session], batch["__at"], batch[kind]):
                if s != at and not (pd.isna(s) and pd.isna(at)):
                    at, state = s, FRESH
                no = False
                if k in ("count", "reset"):
                    state, no = rule.step(state, t, k)
                denied.append(no)
                counts.append(state[0])
            yield batch[columns].assign(denied=denied, burst=counts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", denied boolean, burst int"
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prepared.repartition(parts, session).sortWithinPartitions(session, when, *order).mapInPandas(run, schema)


def stream(events: DataFrame, rule: Burst, session: str, when: str, kind: str, ttl_hours: float = 24.0) -> DataFrame:
    """The same over a stream: one row (session, at, denied, burst) an event, in order within a batch; idle state goes after the TTL."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        held = sane(state.get, float(rows["at"].max())) if state.exists else FRESH
        out = []
        for t, k in zip(rows["at"], rows["kind"]):
            held, no = rule.step(held, t, k)
            out.append((key[0], t, no, held[0]))
        state.update(held)
        state.setTimeoutDuration(int(ttl_hours * 3600 * 1000))
        yield pd.DataFrame(out, columns=["session", "at", "denied", "burst"])

    own = events.where(F.col(kind).isin("count", "reset")).select(F.col(session).cast("string").alias("session"), (F.unix_micros(F.col(when).cast("timestamp")) / 1e6).alias("at"), F.col(kind).alias("kind"))
    return own.groupBy("session").applyInPandasWithState(run, "session string, at double, denied boolean, burst int", "count int, last_seen double, last_deny double", "append", GroupStateTimeout.ProcessingTimeTimeout)
