"""The client chain -- cache, breaker, rate limit, call, cost, cache -- as one machine: folded in batch, or live with named states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import packed
from .folds import fold
from .machines import Breaker, Bucket

OUTCOME = "served string, limited boolean, wait double, state string, spent bigint"
EVENT = ["at", "key", "need", "ok", "blank"]
SLICE = 1 << 16  # calls that are Python objects at once
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}


@dataclass(frozen=True)
class Client:
    """Event: (seconds, cache key, tokens, whether the call succeeds, whether its reply is blank).

    Outcome: what served it (cache, model, failed, refused), whether the rate limit was exceeded, the wait, the breaker's
    state after, tokens spent. An answer that is cached for no longer than ttl_s is served at once. An open breaker refuses.
    A call waits for the limit up to timeout_s and goes ahead anyway after that. Blank replies are not cached.
    """

    breaker: Breaker = field(default_factory=Breaker)
    bucket: Bucket = field(default_factory=Bucket)
    ttl_s: float = 3_600
    timeout_s: float = 30

    def start(self) -> tuple:
        return ({}, self.breaker.start(), self.bucket.start())

    def step(self, state: tuple, event: tuple) -> tuple[tuple, tuple]:
        cache, breaker, bucket = state  # the cache is any mapping; it is changed in place
        now, key, need, ok, blank = event
        written = cache.get(key)
        if written is not None and now - written <= self.ttl_s:
            return state, ("cache", False, 0.0, breaker[0], 0)
        breaker, (allowed, name) = self.breaker.step(breaker, (now, ok))
        if not allowed:
            return (cache, breaker, bucket), ("refused", False, 0.0, name, 0)
        bucket, (free, wait) = self.bucket.step(bucket, (now, need))
        limited = not free and wait > self.timeout_s
        if not free and not limited:
            bucket, _ = self.bucket.step(bucket, (now + wait, need))
        waited = 0.0 if free or limited else wait
        if ok and not blank:
            cache[key] = now
        return (cache, breaker, bucket), ("model" if ok else "failed", limited, waited, name, int(need) if ok else 0)


def chained(calls: DataFrame, client: Client, provider: str = "provider", order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """Adds the outcomes to calls (provider, at, key, need, ok, blank), in order."""
    return fold(calls, provider, list(order), client, EVENT, OUTCOME)


class _Map:
    """A map state as a mapping: a key is read at most once, and what was written goes to the state in one go at the end."""

    def __init__(self, state, empty: bool) -> None:
        self.state, self.empty, self.read, self.written = state, empty, {}, {}

    def get(self, key):
        if key in self.written:
            return self.written[key]
        if key not in self.read:
            self.read[key] = self.state.getValue((key,))[0] if not self.empty and self.state.containsKey((key,)) else None
        return self.read[key]

    def __setitem__(self, key, value) -> None:
        self.written[key] = float(value)

    def save(self, useless) -> list[float]:
        """What is saved: useless values only in place of others."""
        saved = {key: value for key, value in self.written.items() if self.read.get(key) is not None or not useless(value)}
        for key, value in saved.items():
            self.state.updateValue((key,), (value,))
        return list(saved.values())


def _values(column: pa.ChunkedArray) -> list:
    """As pandas has them: a missing number is NaN."""
    if column.null_count and (pa.types.is_floating(column.type) or pa.types.is_integer(column.type)):
        column = pc.fill_null(column.cast(pa.float64()), float("nan"))
    return column.to_pylist()


class _Live(StatefulProcessor):
    """Cache, breaker and bucket are states of their own; a timer takes expired answers out of the cache.

    Each call of a state is a message to the JVM and back, so a trigger reads and writes a state once, not once an event.
    A provider with anything cached has one timer, at the first expiry (or, if a late row wrote an older answer, after it).
    Rows are blobs of calls; `time` is the calls' column with the watermark. With the watermark's delay, what no call after
    this trigger can meet (the watermark will have passed its expiry, as it follows the latest call) is not written.
    """

    def __init__(self, client: Client, order: list[str], time: str, delay_ms: int | None = None) -> None:
        self.client, self.order, self.time, self.delay_ms = client, order, time, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cache = handle.getMapState("cache", "key string", "written double")
        self.breaker = handle.getValueState("breaker", "state string, failed int, probes int, good int, opened double")
        self.bucket = handle.getValueState("bucket", "requests double, tokens double, last double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        calls = self._on_time(packed.table(r["rows"] for r in rows), timerValues.getCurrentWatermarkInMs())  # one provider's of one trigger
        if not calls.num_rows:
            return
        calls = calls.take(pc.sort_indices(calls, [(c, "ascending") for c in self.order]))
        known = self.breaker.exists()  # the three states are written together
        cache, (_, breaker, bucket) = _Map(self.cache, not known), self.client.start()
        state = (cache, tuple(self.breaker.get()), tuple(self.bucket.get())) if known else (cache, breaker, bucket)
        for at in range(0, calls.num_rows, SLICE):
            part, out = calls.slice(at, SLICE), []
            for event in zip(*(_values(part[c]) for c in EVENT), strict=True):
                state, result = self.client.step(state, event)
                out.append(result)
            for (column, kind), values in zip((c.split() for c in OUTCOME.split(", ")), zip(*out, strict=True), strict=True):
                part = part.append_column(column, pa.array(values, _ARROW[kind]))
            for blob in packed.blobs(part):
                yield Row(rows=blob)
        latest = pc.max(calls[self.time].cast(pa.int64())).as_py()
        passed = None if self.delay_ms is None or latest is None else latest // 1000 - self.delay_ms
        timed = known and bool(cache.written) and self.cache.exists()
        saved = cache.save(lambda written: passed is not None and self._expiry(written) <= passed)
        if saved and not timed:
            self.handle.registerTimer(self._expiry(min(saved)))
        name, *counts, opened = state[1]
        self.breaker.update((name, *map(int, counts), None if opened is None else float(opened)))
        self.bucket.update(tuple(None if x is None else float(x) for x in state[2]))

    def _on_time(self, calls: pa.Table, watermark: int) -> pa.Table:
        """Without what is later than the watermark; before the first there is none."""
        late = pc.less_equal(calls[self.time].cast(pa.int64()), watermark * 1000)
        return calls.filter(pc.invert(pc.fill_null(late, False))) if watermark > 0 else calls

    def _expiry(self, written: float) -> int:
        return int((written + self.client.ttl_s) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        expiry = {k[0]: self._expiry(v[0]) for k, v in self.cache.iterator()}
        rest = {k: at for k, at in expiry.items() if at > fired and at >= now}
        if rest:
            for k in expiry.keys() - rest.keys():
                self.cache.removeKey((k,))
            self.handle.registerTimer(min(rest.values()))
        elif expiry:
            self.cache.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Expiry(StatefulProcessor):
    """A timer for each key, moved by every activity; a key whose timer fires is given out and forgotten."""

    def __init__(self, ttl_s: float, key: str) -> None:
        self.ttl_s, self.key = ttl_s, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = max(pdf["at"].max() for pdf in rows)
        if self.last.exists():
            before = self.last.get()[0]
            if before >= latest:
                return iter(())
            self.handle.deleteTimer(int((before + self.ttl_s) * 1000))
        self.last.update((float(latest),))
        self.handle.registerTimer(int((latest + self.ttl_s) * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({self.key: [key[0]], "last_activity": [at]})

    def close(self) -> None:
        pass


def _states_by_rocks(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_chain(stream: DataFrame, client: Client, provider: str = "provider", order: tuple[str, ...] = ("at", "id"), only_watermark: bool = False) -> DataFrame:
    """The same over a stream with a watermark: state is kept by provider; rows of a trigger are taken in order, without
    those that the watermark has passed. only_watermark: the query has no other, so that it can't stay behind this one."""
    _states_by_rocks(stream)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", " + OUTCOME
    time, delay_ms = next((f.name, f.metadata["spark.watermarkDelayMs"]) for f in stream.schema if "spark.watermarkDelayMs" in f.metadata)
    calls = packed.pack(stream, provider).groupBy(provider)
    processor = _Live(client, list(order), time, delay_ms if only_watermark else None)
    return packed.unpack(calls.transformWithState(processor, "rows binary", "Append", "EventTime"), schema)


def expiring(stream: DataFrame, ttl_s: float, key: str = "session_id") -> DataFrame:
    """key, last_activity of keys whose last activity (at, seconds) is ttl_s before the watermark: the sessions to delete."""
    _states_by_rocks(stream)
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(_Expiry(ttl_s, key), f"`{key}` {kind}, last_activity double", "Append", "EventTime")
