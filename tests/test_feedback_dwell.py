from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import dwell, feedback

T0 = datetime(2024, 1, 1, 12, 0, 0)


def log(spark, rows):
    data = [(n, u, p, a, T0 + timedelta(seconds=s)) for n, (u, p, a, s) in enumerate(rows)]
    return spark.createDataFrame(
        data, "event_id long, user_id string, paper_id long, action string, ts timestamp_ntz"
    )


def test_last_change_wins_and_none_removes(spark):
    changes = log(spark, [
        ("u", 1, "like", 0), ("u", 1, "dislike", 5), ("u", 2, "like", 0), ("u", 2, "none", 9),
        ("v", 1, "like", 3), ("v", 1, "save", 3),
    ])
    got = {(r["user_id"], r["paper_id"]): r["action"] for r in feedback.current_feedback(changes).collect()}
    assert got == {("u", 1): "dislike", ("v", 1): "save"}
    twice = feedback.current_feedback(changes.union(changes))
    assert {(r["user_id"], r["paper_id"]): r["action"] for r in twice.collect()} == got


def test_liked_collection_keeps_unliked(spark):
    changes = log(spark, [("u", 1, "like", 0), ("u", 1, "none", 5), ("v", 2, "like", 1), ("w", 3, "save", 1)])
    have = spark.createDataFrame([("c9", "v", "Liked Papers")], "id string, user_id string, name string")
    created = feedback.liked_collections(changes, have)
    assert [r["user_id"] for r in created.collect()] == ["u"]
    every = have.unionByName(created.select("id", "user_id", "name"))
    members = spark.createDataFrame([("c9", 2)], "collection_id string, paper_id long")
    added = feedback.liked_collection_papers(changes, every, members).collect()
    assert [r["paper_id"] for r in added] == [1]


def test_read_floor_and_cap(spark):
    visits = spark.createDataFrame([(9,), (10,), (301,)], "dwell_seconds int")
    assert sorted(r[0] for r in feedback.reads_to_append(visits).collect()) == [10, 300]


def test_recent_reads_lets_the_oldest_go(spark):
    reads = spark.range(201).select(
        "id", F.lit("u").alias("user_id"), F.col("id").alias("paper_id"),
        F.timestamp_seconds("id").alias("clicked_at"),
    )
    kept = feedback.recent_reads(reads, 200)
    assert feedback.recent_reads(reads).count() == 201
    assert kept.count() == 200
    assert kept.where("paper_id = 0").count() == 0


def pulses(spark, rows):
    data = [(u, p, T0 + timedelta(seconds=s)) for u, p, s in rows]
    return spark.createDataFrame(data, "user_id string, paper_id long, ts timestamp_ntz")


def test_dwell_totals_over_slices(spark):
    seconds = [0, 20, 600, 3599, 3600, 3605, 9000]
    # gaps 20, 30, 30, 1, 5, 30 and the idle end 30
    rows = pulses(spark, [("u", 1, s) for s in seconds] + [("u", 2, 0), ("v", 1, 10)])
    for slice_seconds in (7, 60, 3600, 10**6):
        got = {
            (r["user_id"], r["paper_id"]): r["seconds"]
            for r in dwell.dwell_totals(rows, slice_seconds=slice_seconds).collect()
        }
        assert got == {("u", 1): 146.0, ("u", 2): 30.0, ("v", 1): 30.0}


def test_dwell_rows_kept(spark):
    rows = pulses(spark, [("u", 1, s) for s in range(0, 400, 5)] + [("u", 2, 0)])
    got = {r["paper_id"]: r["dwell_seconds"] for r in dwell.dwell_from_pulses(rows).collect()}
    assert got == {1: 300, 2: 30}


def test_sessions_agree_with_totals(spark):
    rows = pulses(spark, [("u", 1, s) for s in (0, 20, 600, 610)] + [("v", 1, 0), ("v", 1, 600)])
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = dwell.dwell_sessions(timed).collect()
    found = sorted((r["user_id"], r["seconds"]) for r in sessions)
    assert found == [("u", 40.0), ("u", 50.0), ("v", 30.0), ("v", 30.0)]
    totals = {r["user_id"]: r["seconds"] for r in dwell.dwell_totals(rows).collect()}
    assert totals == {"u": 90.0, "v": 60.0}
