"""Caches, the client chain and the sweep: batch against plain Python, streams against batch."""

from __future__ import annotations

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from sparkquill.functions import sections as S
from sparkquill.sources import trajectory_log
from sparkquill.streaming import caches, client, folds, notices, windows
from sparkquill.streaming.machines import Breaker, Bucket


@pytest.mark.parametrize("capacity", [1, 3, 7])
def test_recency_and_reuse_distances_agree(capacity):
    some = random.Random(capacity)
    lru, reuse, plain = caches.Lru(capacity), caches.Reuse(), OrderedDict()
    a, b = lru.start(), reuse.start()
    for t in range(2000):
        key = some.choice("abcdefghij"[: some.randint(1, 10)])
        a, (hit, evicted) = lru.step(a, (float(t), key))
        b, (distance,) = reuse.step(b, (key,))
        out = None
        want = key in plain
        plain[key] = 1
        plain.move_to_end(key)
        if len(plain) > capacity:
            out = plain.popitem(last=False)[0]
        assert (hit, evicted) == (want, out) and hit == (distance is not None and distance < capacity)


def test_time_to_live_counts_from_the_write():
    lru = caches.Lru(2, ttl_s=10)
    state, hits = lru.start(), []
    for now in (0, 5, 10, 11, 20, 30.5):
        state, (hit, _) = lru.step(state, (now, "k"))
        hits.append(hit)
    assert hits == [False, True, True, False, True, False]


def test_client_waits_refuses_and_never_keeps_blank_replies():
    chain = client.Client(Breaker(failures=1, open_s=100), Bucket(rpm=60, tpm=60_000, burst=1), ttl_s=50, timeout_s=30)
    state, got = chain.start(), []
    for event in [(0, "a", 1, True, False), (0.5, "a", 1, True, False), (0.5, "b", 1, True, True), (1.6, "b", 1, True, False), (5, "c", 1, False, False), (6, "d", 1, True, False), (7, "a", 1, True, False), (60, "a", 1, True, False)]:
        state, out = chain.step(state, event)
        got.append(out[0])
        if event[1] == "b" and event[0] == 0.5:
            assert out[2] == 0.5 and not out[1]  # waited for the bucket
    assert got == ["model", "cache", "model", "model", "failed", "refused", "cache", "refused"]


def test_live_chain_and_sweep_go_on_after_a_restart(spark, sf, tmp_path):
    """Two runs over a folder that grows give the rows of one batch fold; the cache, breaker and bucket carry over."""
    e = windows.events(spark.read.parquet(f"{sf}/events.parquet"))
    i = F.col("event_id")
    calls = e.select(i.alias("id"), (F.col("user_id") % 3).alias("provider"), "ts", folds.seconds("ts").alias("at"), F.col("event_type").alias("key"), (i % 90).cast("double").alias("need"), (i % 3 > 0).alias("ok"), (i % 7 == 0).alias("blank"))
    chain = client.Client(Breaker(2, 4000, 3, 2), Bucket(0.01, 60, 3), ttl_s=9000, timeout_s=20)
    middle = calls.agg(F.percentile_approx("ts", 0.5)).first()[0]
    folder = f"file://{tmp_path}/in"
    schema = calls.schema
    for part in (F.col("ts") <= middle, F.col("ts") > middle):
        calls.where(part).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "1 hour")
        rows = windows.run_to_end(client.live_chain(stream, chain), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
        sessions = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "1 hour").select(F.col("provider").alias("session_id"), "ts", "at")
        swept = windows.run_to_end(client.expiring(sessions, 3600), f"file://{tmp_path}/swept", f"file://{tmp_path}/sweeping")
    want = client.chained(calls, chain)
    assert sorted(map(repr, rows.drop("ts").collect())) == sorted(map(repr, want.drop("ts").collect()))
    assert {r["served"] for r in rows.collect()} == {"cache", "model", "failed", "refused"}
    assert swept.groupBy("session_id", "last_activity").count().where("count > 1").count() == 0


# --------------------------------------------------------------------------------------- sections, log


def _of(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("c")).first()["c"]


def test_sections_of_odd_texts(spark):
    parts = lambda t: [(s["title"], s["body"]) for s in _of(spark, t, S.markdown_sections(F.col("t")))]
    assert parts("") == [("", "")] and parts("a\nb") == [("", "a\nb")]
    assert parts("# One\n## Two\nx\n # Three ") == [("## Two", "x"), ("# Three", "")]
    assert parts("pre\n#no\n###### Six\n####### seven") == [("", "pre\n#no"), ("###### Six", "####### seven")]
    at = lambda t, *h: [(s["title"], s["body"]) for s in _of(spark, t, S.sections_at(F.col("t"), F.array(*map(F.lit, h))))]
    assert at("xAyBz", "A", "B") == [("", "x"), ("A", "y"), ("B", "z")]
    assert at("xByAz", "A", "B") == [("", "xBy"), ("A", "z")]  # B lies before what A has taken
    assert at("none", "A") == [("", "none")] and at("", "A") == []


def test_pages_and_long_sections(spark):
    got = spark.createDataFrame([(["one", "", "x" * 30 + "\n\n" + "y" * 30],)], "p array<string>").select(S.page_chunks(F.col("p"), 40, 0).alias("c")).first()["c"]
    assert [(c["page"], c["content"]) for c in got] == [(1, "one"), (3, "x" * 30), (3, "y" * 30)]
    long = _of(spark, "# A\n" + "a" * 50 + "\n# B\nb", S.markdown_chunks(F.col("t"), 20, 4))
    assert [(c["title"], c["content"]) for c in long] == [("# A", "# A\n" + "a" * 50), ("# B", "aa\n\n# B\nb")]


def test_log_keeps_bad_lines_apart_and_reads_one_folder(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    steps = spark.range(40).selectExpr("timestamp_micros(id * 1000001) as timestamp", "'CODE_GENERATED' as step_type", "concat('s', id % 10) as session_id", "map('i', cast(id as string)) as data")
    trajectory_log.append(steps, path, 4)
    trajectory_log.end_sessions(spark.createDataFrame([("s1", {"answer": "x"}), ("s2", None)], "session_id string, data map<string,string>").selectExpr("session_id", "current_timestamp() as timestamp", "data"), path, 4)
    bad = next((tmp_path / "log").glob("folder=*"))
    (bad / "more.json").write_text('{"step_type": \n\n   \n')
    all_steps = trajectory_log.read(spark, path, folders=4)
    assert all_steps.where("line is null").count() == 41 and [r["line"] for r in all_steps.where("line is not null").collect()] == ['{"step_type": ']
    mine = trajectory_log.read(spark, path, ["s1"], 4)
    assert mine.count() == 5 and mine.where("step_type = 'FINAL_ANSWER'").first()["data"] == {"answer": "x"}
    assert "folder" in mine._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    assert {r["timestamp"].microsecond for r in mine.where("step_type <> 'FINAL_ANSWER'").collect()} == {1, 11, 21, 31}


# --------------------------------------------------------------------------------------------- notices


def test_a_restart_in_the_middle_gives_no_message_twice(spark, tmp_path, monkeypatch):
    rows = spark.range(30).selectExpr("concat('s', id % 3) as session_id", "if(id % 2 = 0, 'ERROR', 'odd') as kind", "timestamp_seconds(id) as ts", "map('i', cast(id as string)) as data")
    for part in range(3):
        rows.where(f"cast(data['i'] as int) % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    real, seen = notices.messages, []

    def fails_once(batch):
        seen.append(1)
        if len(seen) == 2:
            real(batch).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=1")  # written, but not committed
            raise RuntimeError("lost")
        return real(batch)

    monkeypatch.setattr(notices, "messages", fails_once)
    with pytest.raises(Exception, match="lost"):
        notices.deliver(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    notices.deliver(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = notices.delivered(spark, f"{tmp_path}/out")
    assert got.count() == got.select("message").distinct().count() == 30
    assert {(r["type"], r["n"]) for r in got.groupBy("type").agg(F.count("*").alias("n")).collect()} == {("error", 15), ("unknown", 15)}
