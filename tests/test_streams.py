from datetime import datetime, timedelta

from lectern.operators.feedback import current_feedback
from lectern.streaming.dwell import (
    close_sessions, stream_dwell_sessions, with_marks, write_sessions,
)
from lectern.streaming.feedback import FeedbackState, follow_feedback

T0 = datetime(2024, 1, 1, 12)
PULSES = "user_id string, paper_id long, ts timestamp"
LOG = "event_id long, user_id string, paper_id long, action string, ts timestamp"


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    def land(name, rows):
        data = [(u, p, T0 + timedelta(seconds=s)) for u, p, s in rows]
        spark.createDataFrame(data, PULSES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(PULSES).parquet(str(tmp_path / "in"))
        write_sessions(
            stream_dwell_sessions(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")
        ).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["user_id"], r["paper_id"], r["seconds"], r["pulses"]) for r in rows)

    land("a", [("u", 1, 0), ("u", 1, 20), ("v", 1, 600)])
    assert run() == [("u", 1, 50.0, 2)]  # v is still open
    land("b", [("v", 1, 615), ("w", 9, 3000), ("u", 1, 1)])  # the last one is late
    assert run() == [("u", 1, 50.0, 2), ("v", 1, 45.0, 2)]


def test_a_closing_mark_closes_all_sessions(spark, tmp_path):
    rows = [("u", 1, 0), ("u", 1, 20), ("v", 1, 600), ("u", 2, 610), (None, 3, 615)]
    data = [(u, p, T0 + timedelta(seconds=s)) for u, p, s in rows]
    source = spark.createDataFrame(data, PULSES)
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    marks = str(tmp_path / "marks")

    def run():
        stream = with_marks(spark.readStream.schema(PULSES).parquet(str(tmp_path / "in")), marks)
        write_sessions(
            stream_dwell_sessions(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")
        ).awaitTermination()
        found = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["user_id"], r["paper_id"], r["seconds"], r["pulses"]) for r in found)

    assert run() == [("u", 1, 50.0, 2)]
    close_sessions(source, marks)
    whole = [("u", 1, 50.0, 2), ("u", 2, 30.0, 1), ("v", 1, 30.0, 1)]
    assert run() == whole
    close_sessions(source.limit(0), marks)  # nothing to close, no mark
    assert run() == whole


def changes(spark, rows):
    data = [(n, u, p, a, T0 + timedelta(seconds=s)) for n, u, p, a, s in rows]
    return spark.createDataFrame(data, LOG)


def pairs(df):
    return {(r["user_id"], r["paper_id"]): r["action"] for r in df.collect()}


def test_feedback_stream_equals_batch(spark, tmp_path):
    batches = [
        [(1, "u", 1, "like", 0), (2, "u", 2, "like", 1), (3, "v", 1, "save", 2)],
        [(4, "u", 1, "none", 9), (5, "v", 1, "like", 3)],
        [(0, "u", 1, "dislike", 5), (6, "u", 2, "dislike", 4)],  # the first one is an old change
    ]
    state = None
    for n, rows in enumerate(batches):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        state = FeedbackState(spark, str(tmp_path / "state"), stream.schema, merge_every=2)
        follow_feedback(stream, state, str(tmp_path / "checkpoint")).awaitTermination()
    everything = changes(spark, [row for rows in batches for row in rows])
    assert pairs(state.current()) == pairs(current_feedback(everything))
    assert pairs(state.current()) == {("v", 1): "like", ("u", 2): "dislike"}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    first = changes(spark, [(1, "u", 1, "like", 0)])
    second = changes(spark, [(2, "u", 1, "dislike", 1), (3, "v", 1, "like", 1)])
    state = FeedbackState(spark, str(tmp_path / "s"), first.schema, merge_every=2)
    assert state.current().count() == 0
    state.apply(first, 0)
    for _ in range(3):
        state.apply(second, 1)
        assert pairs(state.current()) == {("u", 1): "dislike", ("v", 1): "like"}
    assert state._complete("base") == [1]


def test_old_folders_are_removed(spark, tmp_path):
    state = FeedbackState(spark, str(tmp_path / "s"), changes(spark, [(0, "u", 0, "like", 0)]).schema, merge_every=2)
    for n in range(7):
        state.apply(changes(spark, [(n, "u", n, "like", n)]), n)
    assert state._complete("base") == [3, 5] and state._complete("batch") == [4, 5, 6]
    assert pairs(state.current()) == {("u", n): "like" for n in range(7)}
