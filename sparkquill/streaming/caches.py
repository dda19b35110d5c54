"""Caches as machines: least recently used, with time to live, and reuse distances."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lru:
    """The `capacity` keys used last, each for `ttl_s` after it was written. Event: (seconds, key). Outcome: (hit, evicted key).

    A read that misses, or finds an expired value, writes anew.
    """

    capacity: int = 1_000
    ttl_s: float | None = None

    def start(self) -> list:
        return []  # [key, written at], the least recently used first

    def step(self, state: list, event: tuple) -> tuple[list, tuple]:
        now, key = event
        at = next((i for i, (k, _) in enumerate(state) if k == key), None)
        if at is not None:
            written = state[at][1]
            fresh = self.ttl_s is None or now - written <= self.ttl_s
            return [*state[:at], *state[at + 1 :], [key, written if fresh else now]], (fresh, None)
        out = state[0][0] if len(state) >= self.capacity else None
        return [*(state[1:] if out is not None else state), [key, now]], (False, out)


@dataclass(frozen=True)
class Reuse:
    """How many other keys were used since the key's last use (None at its first). Event: (key,).

    A cache of c keys, least recently used out first, hits exactly where the distance is below c: one pass answers for
    every capacity. The last uses of all keys are kept in order, so a distance is a search in that order.
    """

    def start(self) -> tuple:
        return ({}, [], [0])

    def step(self, state: tuple, event: tuple) -> tuple[tuple, tuple]:
        last, order, clock = state
        before = last.get(event[0])
        distance = None
        if before is not None:
            at = bisect_right(order, before)
            distance = len(order) - at
            del order[at - 1]
        last[event[0]] = clock[0]
        order.append(clock[0])
        clock[0] += 1
        return state, (distance,)


def hit_rates(distances: DataFrame, capacities: list[int], group: str) -> DataFrame:
    """group, capacity, hits, lookups. distances: group, distance (null: first use)."""
    hits = [F.count_if(F.col("distance") < c).alias(str(c)) for c in capacities]
    wide = distances.groupBy(group).agg(F.count("*").alias("lookups"), *hits)
    return wide.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("capacity"), F.col(str(c)).alias("hits")) for c in capacities])).alias("x"), "lookups").select(group, "x.capacity", "x.hits", "lookups")
