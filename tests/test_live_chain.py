"""The live chain: what it asks of its states, which rows it takes, and rows packed by key."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquill.streaming import client, folds, packed, windows
from sparkquill.streaming.machines import Breaker, Bucket

CHAIN = client.Client(Breaker(2, 4000, 3, 2), Bucket(0.01, 60, 3), ttl_s=9000, timeout_s=20)
CALL = "id long, provider string, ts timestamp, at double, key string, need double, ok boolean, blank boolean"


class _States:
    """Value states, a map state and timers of one key in memory, with the number of calls."""

    def __init__(self) -> None:
        self.calls, self.of, self.cached, self.timers = 0, {}, {}, set()

    def _counted(self, **calls):
        def one(f):
            def call(*a):
                self.calls += 1
                return f(*a)

            return call

        return SimpleNamespace(**{name: one(f) for name, f in calls.items()})

    def getValueState(self, name, _):  # noqa: N802
        return self._counted(exists=lambda: name in self.of, get=lambda: self.of[name], update=lambda x: self.of.__setitem__(name, x))

    def getMapState(self, *_):  # noqa: N802
        c = self.cached
        return self._counted(exists=lambda: bool(c), containsKey=c.__contains__, getValue=c.__getitem__, updateValue=c.__setitem__, removeKey=c.pop, clear=c.clear, iterator=lambda: iter(list(c.items())))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        assert at not in self.timers
        self.timers.add(at)

    def fire(self, processor, watermark):
        while due := sorted(t for t in self.timers if t < watermark):
            list(processor.handleExpiredTimer(("p",), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: due[0])))
            self.timers.discard(due[0])


def _rows(events):
    names = ["id", "ts", *client.EVENT]
    made = pa.table({n: c for n, c in zip(names, zip(*[(i, int(e[0] * 1e6), *e) for i, e in enumerate(events)]))})
    made = made.set_column(1, "ts", made["ts"].cast(pa.timestamp("us", tz="UTC")))
    return iter([{"rows": x} for x in packed.blobs(made)])


@pytest.mark.parametrize("delay_ms", [None, 3_600_000])
def test_states_are_asked_once_a_trigger_and_a_provider_has_one_timer(delay_ms, monkeypatch):
    monkeypatch.setattr(client, "SLICE", 70)
    some, states, plain, watermark = random.Random(3), _States(), CHAIN.start(), 0
    processor = client._Live(CHAIN, ["at", "id"], "ts", delay_ms)
    processor.init(states)
    at, served = 1_000.0, set()
    for _ in range(12):
        events = [(at := at + some.random() * 900, some.choice("abc"), 5.0, some.random() < 0.9, some.random() < 0.1) for _ in range(300)]
        want, before, kept = [], states.calls, set(states.cached)
        for event in events:
            plain, out = CHAIN.step(plain, event)
            want.append(out)
        got = packed.table(r["rows"] for r in processor.handleInputRows(("p",), _rows(events), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)))
        assert list(zip(*(got[c].to_pylist() for c in ("served", "limited", "wait", "state", "spent")))) == want
        assert states.calls - before <= 5 + 1 + 1 + 3 * 3  # two values, the cache and a timer; three keys are looked for, read and written
        assert len(states.timers) == bool(states.cached)
        served |= {w[0] for w in want}
        watermark = int((at - 3600) * 1000)
        if delay_ms:  # nothing was written that the watermark has passed, unless it was there before
            assert all(w + CHAIN.ttl_s >= watermark / 1000 - 0.001 or k in kept for k, (w,) in states.cached.items())
        states.fire(processor, watermark)
        assert len(states.timers) == bool(states.cached) and all(w + CHAIN.ttl_s >= watermark / 1000 - 0.001 for (w,) in states.cached.values())
    assert served == {"cache", "model", "failed", "refused"}
    states.fire(processor, int((at + CHAIN.ttl_s) * 1000) + 10)
    assert not states.cached and not states.timers


def _calls(spark, rows):
    d = spark.createDataFrame(rows, "id long, provider string, at double, key string, need double, ok boolean, blank boolean")
    return d.select("id", "provider", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "at", "key", "need", "ok", "blank")


def test_first_run_takes_all_rows_and_later_ones_drop_what_the_watermark_has_passed(spark, tmp_path):
    """Rows of before 1970 were taken for late ones where there was no watermark yet."""
    h = 3600.0
    first = [(1, "a", 10 * h, "k", 1.0, True, False), (2, None, 9 * h, "k", None, False, False), (3, "a", -5.0, None, 2.0, True, False), (4, "c", 0.0, "k", 2.0, None, False)]
    second = [(5, "a", 9 * h, "k", 1.0, True, False), (6, "a", 9 * h + 0.5, "k", 1.0, True, False), (7, "a", 14 * h, "k", 1.0, True, None), (8, None, 9.5 * h, "q", 1.0, True, False)]
    folder = f"file://{tmp_path}/in"
    for rows, taken in ((first, {1, 2, 3, 4}), (second, {1, 2, 3, 4, 6, 7, 8})):  # 5 is as old as the watermark
        calls = _calls(spark, rows)
        calls.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(calls.schema).parquet(folder).withWatermark("ts", "1 hour")
        got = windows.run_to_end(client.live_chain(stream, CHAIN), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        want = client.chained(calls, CHAIN).where(F.col("id") < 5)
        assert got.columns == want.columns and sorted(r["id"] for r in got.collect()) == sorted(taken)
        if rows is first:
            assert sorted(map(repr, got.drop("need").collect())) == sorted(map(repr, want.drop("need").collect()))


@pytest.mark.parametrize("held", [packed.HELD, 5_000])
def test_packed_rows_come_back_whole(spark, monkeypatch, held):
    monkeypatch.setattr(packed, "HELD", held)
    d = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 50))) as k", "if(id % 5 = 0, null, id + 9007199254740993) as n", "cast(id / 7 as decimal(30,9)) as d",
        "timestamp_micros(id * 1000001) as ts", "array(id, null) as a", "if(id = 1, repeat('long', 20000), cast(id as string)) as s", "date_add(date'1900-01-01', cast(id as int)) as day",
    )
    packs = packed.pack(d, "k")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)
    assert sorted(map(repr, packed.unpack(packs, schema).collect())) == sorted(map(repr, d.collect()))
    assert packs.where("k is null").count() and packs.where("k = 'hot'").count() > 1
    assert packed.unpack(packed.pack(d.where("false"), "k"), schema).count() == 0


def test_triggers_by_file_give_the_rows_of_one_fold(spark, sf, tmp_path):
    e = windows.events(spark.read.parquet(f"{sf}/events.parquet"))
    i = F.col("event_id")
    calls = e.select(i.alias("id"), (F.col("user_id") % 3).alias("provider"), "ts", folds.seconds("ts").alias("at"), F.col("event_type").alias("key"), (i % 90).cast("double").alias("need"), (i % 3 > 0).alias("ok"), (i % 7 == 0).alias("blank"))
    cuts = calls.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = calls if low is None else calls.where(F.col("ts") > low)
        (part if high is None else part.where(F.col("ts") <= high)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").withWatermark("ts", "1 hour")
    rows = windows.run_to_end(client.live_chain(stream, CHAIN, only_watermark=True), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, client.chained(calls, CHAIN).collect()))
