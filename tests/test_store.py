"""Creating, touching, counting sessions; exports of trajectories: defaults, nulls, unknown ids, empty tables, escaping."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkquill.operators import sessions as S
from sparkquill.operators import trajectories as T


def now():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def test_a_session_takes_defaults_where_nothing_is_given(spark):
    bare = spark.createDataFrame([(1,)], "session_id long")
    row = S.created(bare, now()).first()
    assert row["title"] == "Session 2024-01-02 03:04" and row["status"] == "active" and row["metadata"] == {} and row["parent_session_id"] is None
    assert (row["expires_at"] - row["created_at"]).total_seconds() == 72 * 3600
    assert [row[k] for k in S.SETTINGS] == list(S.SETTINGS.values())
    full = spark.createDataFrame([(2, "mine", {"a": "b"}, 1, False, "x"), (3, None, None, None, None, None)], "session_id long, title string, metadata map<string,string>, parent_session_id long, enable_citations boolean, note string")
    one, two = S.created(full, now(), ttl_hours=1).orderBy("session_id").collect()
    assert (one["title"], one["metadata"], one["parent_session_id"], one["enable_citations"], one["note"]) == ("mine", {"a": "b"}, 1, False, "x")
    assert two["enable_citations"] is True and two["note"] is None
    assert S.created(bare.limit(0), now()).count() == 0


def test_only_known_sessions_are_touched_and_once(spark):
    sessions = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2020, 1, 1)), (None, datetime(2020, 1, 1))], "session_id long, last_activity timestamp")
    used = spark.createDataFrame([(1,), (1,), (9,), (None,)], "session_id long")
    got = S.touched(sessions, used, now()).collect()
    assert sorted((r["session_id"] or 0, r["last_activity"].year) for r in got) == [(0, 2020), (1, 2024), (2, 2020)]
    assert sorted(r["last_activity"].year for r in S.touched(sessions, used.limit(0), now()).collect()) == [2020] * 3


def test_context_with_and_without_summaries(spark):
    rows = [(1, 1, "user", "a", 1, None), (1, 2, "system", "b", 2, "summary"), (1, 3, "user", "c", 3, "text")]
    m = spark.createDataFrame(rows, "session_id long, id long, role string, content string, created_at long, message_type string")
    said = lambda df: [(r["content"], r["place"]) for r in df.orderBy("place").collect()]
    assert said(S.context_messages(m)) == [("a", 1), ("b", 2), ("c", 3)]
    assert said(S.context_messages(m, summaries=False)) == [("a", 1), ("c", 2)]
    assert {r["session_id"]: r["messages"] for r in S.message_counts(spark.createDataFrame([(1,), (1,), (5,)], "session_id long"), m).collect()} == {1: 3, 5: 0}


@pytest.fixture(scope="module")
def steps(spark):
    t = datetime(2024, 1, 1)
    rows = [("r<1>", "a&b", 1, t, "ROOT_LLM_START", 10, 1), ("r<1>", "a&b-sub-1", 2, t.replace(second=2), "SUB_LLM_SPAWN", 5, None), ("r<1>", "a&b-sub-1", 3, t.replace(second=5), "SUB_LLM_COMPLETE", None, 7)]
    return spark.createDataFrame(rows, "root string, session_id string, seq long, ts timestamp, step_type string, tokens_in long, tokens_out long")


def test_a_bundle_is_whole_json(steps):
    (row,) = T.json_bundles(steps).collect()
    got = json.loads(row["json"])
    assert set(got) == {"export_metadata", "tree", "timeline", "costs", "statistics"} and got["export_metadata"]["session_id"] == "r<1>"
    assert [n["session_id"] for n in got["tree"]["nodes"]] == ["a&b", "a&b-sub-1"] and got["tree"]["nodes"][1]["ms"] == 3000
    assert [x["place"] for x in got["timeline"]] == [1, 2] and got["statistics"]["steps"] == 3
    assert T.json_bundles(steps.limit(0)).count() == 0 and T.html_reports(steps.limit(0)).count() == 0


def test_a_report_escapes_what_it_shows(steps):
    (row,) = T.html_reports(steps).collect()
    assert "r&lt;1&gt;" in row["html"] and "a&amp;b-sub-1" in row["html"] and "r<1>" not in row["html"] and row["html"].endswith("</html>")
    assert "<td>SUB_LLM_COMPLETE</td><td>1</td><td></td><td>7</td>" in row["html"]


def test_exits_of_unknown_sessions_leave_no_line(steps):
    asked = steps.where("seq = 3").select("root", "session_id", "ts").unionByName(steps.where("seq = 3").select("root", F.lit("other").alias("session_id"), "ts"))
    (row,) = T.exit_log(steps, asked).collect()
    assert (row["session_id"], row["depth"], row["seconds"]) == ("a&b-sub-1", 1, 3.0)


def test_cache_entries_by_session(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, "a", t(1), "set", 1), (1, "a", t(2), "get", 2), (1, "a", t(3), "set", 3), (1, "a", t(4), "get", 4), (1, "a", t(4), "get", 5), (1, "b", t(5), "set", 6), (1, "c", t(1), "get", 7), (2, "a", t(1), "set", 8), (2, "a", t(2), "invalidate", 9)]
    ops = spark.createDataFrame(rows, "session_id long, key string, ts timestamp, op string, id long")
    from sparkquill.operators import calls as C

    got = {r["session_id"]: tuple(r)[1:] for r in C.session_cache_stats(ops).collect()}
    assert got == {1: (2, 0, 1.0, t(3), t(5)), 2: (0, 0, 0.0, None, None)}
    late = {r["session_id"]: tuple(r)[1:] for r in C.session_cache_stats(ops, F.lit("2024-01-01 00:00:14").cast("timestamp"), 10).collect()}
    assert late[1] == (1, 1, 0.0, t(5), t(5))
    assert C.session_cache_stats(ops.limit(0)).count() == 0


def test_display_forms(spark):
    rows = [(None, 0.0, 0, "SUB_LLM_SPAWN"), (999.0, 0.0099, 999, "ROOT_LLM_START"), (1000.0, 0.01, 1234567, "RECURSION_LIMIT_HIT"), (59_949.0, 1.5, 1000, "FINAL_ANSWER"), (125_300.0, 0.001, 12, "UNHEARD_OF")]
    df = spark.createDataFrame(rows, "ms double, usd double, n long, kind string")
    got = [tuple(r) for r in df.select(T.elapsed_text(F.col("ms")), T.cost_text(F.col("usd")), T.tokens_text(F.col("n")), T.step_label(F.col("kind")), T.step_color(F.col("kind"))).collect()]
    assert got == [
        ("N/A", "$0.00¢", "0", "Sub-LLM Spawn", "#22c55e"),
        ("999ms", "$0.99¢", "999", "Root LLM Start", "#3b82f6"),
        ("1.0s", "$0.0100", "1,234,567", "Recursion Limit Hit", "#f97316"),
        ("59.9s", "$1.5000", "1,000", "Final Answer", "#6b7280"),
        ("2m 5.3s", "$0.10¢", "12", "Unheard Of", "#9ca3af"),
    ]
