import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import admin, insights
from lectern.sources import calendars

AS_OF = "2024-01-30 12:00:00"
NOW = datetime(2024, 1, 30, 12)


def profiles(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, institution string, keywords array<string>")


def papers(spark, rows):
    return spark.createDataFrame(
        rows, "id long, title string, journal string, pub_date date, study_type string, "
        "clinical_relevance int, fetched_at timestamp_ntz, keywords array<string>, "
        "mesh_terms array<string>, authors array<string>",
    )


def paper(n, fetched=NOW, journal="J", kind="rct", keywords=(), mesh=(), authors=()):
    return (n, f"t{n}", journal, None, kind, 0, fetched, list(keywords), list(mesh), list(authors))


def votes(spark, rows):
    return spark.createDataFrame(
        rows, "user_id string, paper_id long, action string, created_at timestamp_ntz"
    )


def reads(spark, rows):
    return spark.createDataFrame(
        rows, "user_id string, paper_id long, dwell_seconds int, clicked_at timestamp_ntz"
    )


def test_stats_boundaries(spark):
    week = NOW - timedelta(days=7)
    row = admin.overall_stats(
        profiles(spark, [("u", "U", "", []), ("v", "V", "", [])]),
        papers(spark, [paper(1, week), paper(2, week + timedelta(seconds=1))]),
        votes(spark, [("u", 1, "like", NOW), ("u", 2, "dislike", NOW), ("v", 1, "save", NOW)]),
        reads(spark, [("u", 1, 0, week), ("v", 1, 0, NOW), ("v", 2, 0, NOW)]),
        AS_OF,
    ).first()
    assert row.asDict() == {
        "total_users": 2, "total_papers": 2, "papers_7d": 1, "total_feedbacks": 3, "total_likes": 1,
        "total_dislikes": 1, "total_reads": 3, "avg_dwell_seconds": 0, "active_users_7d": 1, "like_rate": 33,
    }


def test_stats_of_empty_tables(spark):
    row = admin.overall_stats(
        profiles(spark, []), papers(spark, []), votes(spark, []), reads(spark, []), AS_OF
    ).first()
    assert set(row.asDict().values()) == {0}


def test_average_dwell_rounds_half_up(spark):
    rows = [("u", 1, 1, NOW), ("u", 1, 2, NOW), ("u", 1, 0, NOW)]
    row = admin.overall_stats(
        profiles(spark, []), papers(spark, []), votes(spark, []), reads(spark, rows), AS_OF
    ).first()
    assert row["avg_dwell_seconds"] == 2


def test_daily_activity_has_every_day(spark):
    daily = admin.daily_activity(
        papers(spark, [paper(1)]),
        votes(spark, [("u", 1, "like", NOW), ("v", 1, "like", NOW), ("v", 2, "dislike", NOW - timedelta(days=30))]),
        reads(spark, [("u", 1, 5, NOW), ("u", 2, 5, NOW), ("u", 2, 5, NOW - timedelta(days=31))]),
        AS_OF,
    )
    rows = {r["day"]: r for r in admin.activity_bars(daily).collect()}
    assert len(rows) == 31 and min(rows) == date(2023, 12, 31)
    today = rows[date(2024, 1, 30)]
    assert (today["active_users"], today["likes"], today["new_papers"]) == (1, 2, 1)
    assert (today["bar_height"], today["like_part"]) == (100.0, 100.0)
    assert rows[date(2023, 12, 31)]["dislikes"] == 1 and rows[date(2023, 12, 31)]["active_users"] == 0
    assert (rows[date(2024, 1, 5)]["bar_height"], rows[date(2024, 1, 5)]["like_part"]) == (2.0, 0.0)
    assert sum(r["likes"] for r in rows.values()) == 2


def test_top_lists(spark):
    table = papers(spark, [paper(1), paper(2, journal=None), paper(3, journal="K")])
    likes = votes(spark, [("u", 2, "like", NOW), ("v", 2, "like", NOW), ("u", 1, "like", NOW), ("u", 3, "like", NOW)])
    assert [(r["id"], r["like_count"]) for r in admin.top_papers(likes, table, 2).collect()] == [(2, 2), (1, 1)]
    people = profiles(spark, [("u", "", "", ["a", "a"]), ("v", "", "", ["b", "A"]), ("w", "", "", None)])
    assert [tuple(r) for r in admin.popular_keywords(people).collect()] == [("a", 2), ("A", 1), ("b", 1)]
    assert {r["journal"] for r in admin.journal_distribution(table, AS_OF).collect()} == {"J", "K"}


def test_engagement_keeps_idle_profiles_last(spark):
    people = profiles(spark, [("a", "A", "", []), ("b", "B", "", []), ("c", "C", "", [])])
    got = admin.user_engagement(
        people, votes(spark, [("c", 1, "like", NOW)]),
        reads(spark, [("b", 1, 5, NOW - timedelta(days=2)), ("c", 1, 5, NOW), ("c", 2, 5, NOW)]),
    ).collect()
    assert [(r["id"], r["likes"], r["reads"]) for r in got] == [("c", 1, 2), ("b", 0, 1), ("a", 0, 0)]
    assert got[2]["last_active"] is None


def test_json(spark):
    table = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "n int, s string")
    text = admin.json_array(table, [F.desc("n")], 2).first()["json"]
    assert json.loads(text) == [{"n": 3}, {"n": 2, "s": "b"}]
    assert admin.json_array(table.limit(0), [F.desc("n")], 2).first()["json"] is None
    assert json.loads(admin.json_rows(table.where("n = 1")).first()["json"]) == {"n": 1, "s": "a"}


def test_topics(spark):
    keywords = ["ab", "abc", "x" * 39, "y" * 40, "Humans", "PSA"]
    table = papers(spark, [paper(1, keywords=keywords, mesh=["psa", "Mice"]), paper(2, keywords=["psa"])])
    got = insights.reader_topics(
        votes(spark, [("u", 1, "like", NOW), ("u", 2, "dislike", NOW)]),
        reads(spark, [("u", 1, 5, NOW), ("u", 1, 5, NOW)]), table,
    ).collect()
    assert {r["term"]: (r["n"], r["rank"]) for r in got} == {
        "psa": (2, 1), "abc": (1, 2), "mice": (1, 3), "x" * 39: (1, 4),
    }
    assert sum(r["share"] for r in got) == pytest.approx(1.0)


@pytest.mark.parametrize(
    "days_ago, streak", [([0, 1], 2), ([1, 2], 0), ([0, 1, 3], 2), ([0, 0, 1, 1, 2], 3), (list(range(400)), 365)]
)
def test_streak(spark, days_ago, streak):
    rows = [("u", n, 5, NOW - timedelta(days=d)) for n, d in enumerate(days_ago)]
    assert insights.reading_streak(reads(spark, rows), AS_OF).first()["streak"] == streak


def test_totals_and_heatmap(spark):
    seen = reads(spark, [("u", 1, 5, NOW), ("u", 1, 5, NOW), ("u", 2, 5, NOW - timedelta(days=90)), ("v", 3, 5, NOW - timedelta(days=91))])
    liked = votes(spark, [("u", 2, "like", NOW), ("w", 9, "like", NOW)])
    got = {r["user_id"]: (r["total"], r["liked"], r["streak"]) for r in insights.reader_totals(liked, seen, AS_OF).collect()}
    assert got == {"u": (2, 1, 1), "v": (1, 0, 0), "w": (1, 1, 0)}
    cells = insights.reader_heatmap(seen, AS_OF, 13).collect()
    assert len(cells) == 2 * 91
    busy = {(r["user_id"], r["week"], r["slot"]): (r["n"], r["bucket"]) for r in cells if r["n"]}
    assert busy == {("u", 12, 6): (2, 2), ("u", 0, 0): (1, 1)}


def test_calendars(spark):
    assert calendars.day_calendar(spark, AS_OF).count() == 31
    cells = calendars.heat_calendar(spark, AS_OF, 26).collect()
    assert len(cells) == 182 and max(r["day"] for r in cells) == date(2024, 1, 30)
    months = sorted(insights.heatmap_months(spark, AS_OF, 13).collect(), key=lambda r: r["start"])
    assert [(r["label"], r["start"], r["span"]) for r in months] == [
        ("Nov", 0, 4), ("Dec", 4, 4), ("Jan", 8, 5),
    ]


def test_summary_and_interests(spark):
    table = papers(spark, [
        paper(1, journal="K", kind="rct", keywords=["PSA", "stone"], authors=["A", "B"]),
        paper(2, journal="K", kind=None, keywords=["psa"], authors=["B"]),
        paper(3, journal="", kind="rct", keywords=["psa"]),
    ])
    liked = votes(spark, [("u", n, "like", NOW) for n in (1, 2, 3)] + [("v", 3, "like", NOW)])
    none = reads(spark, [])
    lines = {r["user_id"]: r["summary"] for r in insights.reader_summary(liked, none, table).collect()}
    assert lines == {
        "u": "Your reading is centered on psa and stone. 67% are Clinical Trial. Most read: K (2)."
    }
    got = {r["user_id"]: r for r in insights.learned_interests(liked, table).collect()}
    assert got["u"]["authors"] == ["B", "A"]
    assert got["u"]["keywords"] == ["psa", "stone"]
    assert got["u"]["journals"] == ["K"]
    assert got["v"]["authors"] == [] and got["v"]["keywords"] == ["psa"]
