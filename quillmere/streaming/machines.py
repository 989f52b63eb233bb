"""State machines over a key's events in time order: rate limits, alert cooldowns, circuit breakers.

Each is a step (state, event) -> (state, result), pure Python and small. One
batch form (events sorted within partitions, streamed with one key's state held)
and one streaming form (``transformWithState``) run any of them, so
both give the same results. A key's events are folded in order, however
many, with only the state in memory.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmere.shared import whole_row


@dataclass(frozen=True)
class Machine:
    """``start`` makes a state, ``step`` takes (state, seconds, ok) and gives (state, result).

    ``memory``: seconds without events after which a state is as good as a new one; None where it never is.
    """

    start: Callable[[], list]
    step: Callable[[list, float, bool], tuple[list, str]]
    memory: float | None = None


def rate_limit(most: int = 60, window: float = 60.0, block: float = 0.0) -> Machine:
    """allowed or refused; refused ones do not count. With ``block`` a key is shut out that long once refused. [WIN2, WIN3]"""

    def step(state: list, now: float, _: bool) -> tuple[list, str]:
        until, *times = state
        if block and now < until:
            return state, "refused"
        times = [t for t in times if t > now - window]
        if len(times) >= most:
            return [now + block, *times], "refused"
        return [until, *times, now], "allowed"

    return Machine(lambda: [0.0], step, window + block)


def cooldown(seconds: float = 300.0) -> Machine:
    """sent or held back, by the time since the last one sent; a forced event (ok) is sent and changes nothing. [WIN5]"""

    def step(state: list, now: float, force: bool) -> tuple[list, str]:
        if force:
            return state, "sent"
        if state and now - state[0] < seconds:
            return state, "held"
        return [now], "sent"

    return Machine(list, step, seconds)


def circuit_breaker(failures: int = 5, recovery: float = 60.0) -> Machine:
    """closed, open, half_open at each call, or refused while open. Successes while closed do not reset the count. [WIN10]"""

    def step(state: list, now: float, ok: bool) -> tuple[list, str]:
        name, count, since = ("closed", "open", "half_open")[int(state[0])], state[1], state[2]
        if name == "open":
            if now - since < recovery:
                return state, "refused"
            name = "half_open"
        if ok:
            return ([0.0, 0.0, 0.0], "closed") if name == "half_open" else (state, "closed")
        count += 1
        if count >= failures or name == "half_open":
            return [1.0, count, now], "open"
        return [0.0, count, now], "closed"

    return Machine(lambda: [0.0, 0.0, 0.0], step)


def cache_entry(ttl: float = 24 * 3600.0) -> Machine:
    """hit or miss of requests for a key: a miss fills the cache, and the entry lives for the ttl from then on, hits or not. [AGG15, DT3, STM6]"""

    def step(state: list, now: float, _: bool) -> tuple[list, str]:
        if state and now <= state[0] + ttl:
            return state, "hit"
        return [now], "miss"

    return Machine(list, step, ttl)


def adaptive_timeout(start: int = 30, low: int = 10, high: int = 60) -> Machine:
    """The timeout after each outcome: 2 less after each 5 successes in a row, 5 more after each 2 failures in a row. [WIN9, STM10]"""

    def step(state: list, _: float, ok: bool) -> tuple[list, str]:
        timeout, good, bad = state
        good, bad = (good + 1, 0) if ok else (0, bad + 1)
        if good >= 5:
            timeout, good = max(low, timeout - 2), 0
        elif bad >= 2:
            timeout, bad = min(high, timeout + 5), 0
        return [timeout, good, bad], str(int(timeout))

    return Machine(lambda: [float(start), 0.0, 0.0], step)


def run_rows(events: DataFrame, key: str, machine: Machine, ts: str = "ts", ok: Column | None = None, event_id: str = "event_id") -> DataFrame:
    """Every row of ``events``, all its columns, with the machine's ``result``. Rows of equal time go by event_id; rows without a key are one key's.

    Null times come first, as time 0.
    """
    row, at = whole_row(events), F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6, F.lit(0.0))
    outcome = F.coalesce((F.col("ok") if ok is None else ok).cast("boolean"), F.lit(False))
    rows = events.select(F.col(key).cast("string").alias("_key"), at.alias("_at"), F.col(event_id).alias("_id"), outcome.alias("_ok"), row.alias("_row"))
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_at", "_id").select("_key", "_at", "_ok", "_row")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            results = []
            for name, at, ok in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != now:
                    now, state = name, machine.start()
                state, result = machine.step(state, at, ok)
                results.append(result)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(results, pa.string())], names=["_row", "result"])

    kinds = StructType([StructField("_row", ordered.schema["_row"].dataType), StructField("result", StringType())])
    found = ordered.mapInArrow(fold, kinds)
    return found.select(*[F.col("_row")[c].alias(c) for c in events.columns], "result")


def run_batch(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """(event_id, key, result) of events (event_id, ts, key, ok)."""
    found = run_rows(events.select("event_id", F.col(key).alias("_name"), "ts", "ok"), "_name", machine)
    return found.select("event_id", F.col("_name").cast("string").alias("key"), "result")


#: How late a row may come after later ones before it is left out, where states are cleaned up.
LATE = "48 hours"


def run_stream(events: DataFrame, key: str, machine: Machine, clean_up: bool = False, late: str = LATE) -> DataFrame:
    """The same over a stream, whose batches come in the order of time. Needs the RocksDB state store. [STM4, STM5, STM10, WIN4]

    With ``clean_up`` a key's state goes by a timer in event time, when the watermark (``late`` behind the latest event) is past the key's last event by more than
    the machine remembers; it stays where the machine never forgets. Rows behind the watermark are left out then, and only then. A batch's events of one
    key are held together to be sorted.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    forget = None if not clean_up or machine.memory is None else int(machine.memory * 1000) + 1

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "values array<double>, timer long")

        # Rows, not pandas: most keys have a few events in a batch, for which a frame costs far more than the fold. Each call of the state is a message to
        # the JVM, so the state is asked for once and written where it has changed.
        def handleInputRows(self, key: Any, rows: Iterator[Row], timer: Any) -> Iterator[Row]:  # noqa: N802
            batch = sorted(((r.at, r.event_id is not None, r.event_id, bool(r.ok)) for r in rows), key=lambda r: r[:3])
            before = self.state.get()
            held, due = (list(before[0]), before[1]) if before else (machine.start(), None)
            for at, _, event_id, ok in batch:
                held, result = machine.step(held, at, ok)
                yield Row(event_id=event_id, key=key[0], result=result)
            if forget is not None:
                if due is not None:
                    self.handle.deleteTimer(int(due))
                due = int(batch[-1][0] * 1000) + forget
                self.handle.registerTimer(due)
            after = ([float(x) for x in held], due)
            if before is None or after != (list(before[0]), before[1]):
                self.state.update(after)

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
            self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    timed = events if forget is None else events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    stamp = [] if forget is None else ["ts"]
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(0.0))
    rows = timed.select("event_id", F.col(key).cast("string").alias("key"), at.alias("at"), F.col("ok").cast("boolean").alias("ok"), *stamp)
    return rows.groupBy("key").transformWithState(
        statefulProcessor=Fold(), outputStructType="event_id long, key string, result string", outputMode="Append", timeMode="None" if forget is None else "EventTime"
    )


def run_cache(requests: DataFrame, cache: str, key: str, capacity: int, ttl: float = 24 * 3600.0) -> DataFrame:
    """(event_id, result) of a stream of requests (event_id, ts) to caches of ``capacity`` entries: hit, or miss, or evicting where the miss cost another entry its place. [STM6, WIN11]

    An entry lives ``ttl`` seconds from its filling; a hit makes it the last used, and the one used longest ago goes first (ties: the smaller key). Entries
    past their time go before any other. One cache is one key of the stream, so its entries, ``capacity`` at most, are its state: a map from
    key to filling and last use, written as far as it changes. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Cache(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.entries = handle.getMapState("entries", "key string", "filled double, used double")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
            batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
            before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
            held, results = dict(before), []
            for name, at in zip(batch["key"], batch["at"], strict=True):
                held, result = cache_step(held, name, at, capacity, ttl)
                results.append(result)
            for k in before.keys() - held.keys():
                self.entries.removeKey((k,))
            for k, v in held.items():
                if before.get(k) != v:
                    self.entries.updateValue((k,), v)
            yield pd.DataFrame({"event_id": batch["event_id"], "result": results})

        def close(self) -> None:
            pass

    rows = requests.select("event_id", F.coalesce(F.col(cache).cast("string"), F.lit("")).alias("cache"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("cache").transformWithStateInPandas(statefulProcessor=Cache(), outputStructType="event_id long, result string", outputMode="Append", timeMode="None")


def cache_step(held: dict[str, tuple[float, float]], name: str, at: float, capacity: int, ttl: float) -> tuple[dict[str, tuple[float, float]], str]:
    """The entries (filled, used) after a request, which may be changed in place, and what it was."""
    if name in held and at <= held[name][0] + ttl:
        held[name] = (held[name][0], at)
        return held, "hit"
    held.pop(name, None)
    if len(held) >= capacity:
        held = {k: v for k, v in held.items() if at <= v[0] + ttl}
    result = "miss"
    if len(held) >= capacity:
        held.pop(min(held, key=lambda k: (held[k][1], k)))
        result = "evicting"
    held[name] = (at, at)
    return held, result


# The worker that starts a stream's processor on the driver's side knows nothing of files that were added to the session, so what is here goes to it whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
