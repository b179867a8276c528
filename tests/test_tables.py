import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import alerts, audit, digest, enrich, maintain, search_index
from lectern.operators.counters import RunCounters
from lectern.sources import tables

T0 = datetime(2024, 1, 1)


def test_patch_keeps_fields_not_given(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, s string, t string")
    patch = spark.createDataFrame([(1, None, "z"), (9, "q", "q")], "id int, s string, t string")
    got = sorted(tuple(r) for r in maintain.patched(base, patch, "id", ["s", "t"]).collect())
    assert got == [(1, "a", "z"), (2, "b", "y")]


def test_profile_updates_take_the_last_of_each_field(spark):
    base = spark.createDataFrame([("u", "n", ["old"]), ("v", "m", [])], "id string, name string, keywords array<string>")
    log = spark.createDataFrame(
        [("u", "first", [" b ", "a", "b", " "], T0, 1), ("u", "second", None, T0 + timedelta(1), 2),
         ("u", None, None, T0 + timedelta(2), 3)],
        "id string, name string, keywords array<string>, ts timestamp_ntz, event_id long",
    )
    got = {r["id"]: (r["name"], r["keywords"]) for r in maintain.profile_updates(base, log).collect()}
    assert got == {"u": ("second", ["b", "a"]), "v": ("m", [])}


def test_soft_delete(spark):
    base = spark.createDataFrame(
        [("u", "n", ["k"], ["j"], True), ("v", "m", ["k"], [], True)],
        "id string, name string, keywords array<string>, preferred_journals array<string>, email_digest boolean",
    )
    gone = spark.createDataFrame([("u",)], "id string")
    got = {r["id"]: tuple(r)[1:] for r in maintain.soft_deleted(base, gone).collect()}
    assert got == {"u": ("[DELETED]", [], [], False), "v": ("m", ["k"], [], True)}


def test_cascades(spark):
    given = {
        "profiles": spark.createDataFrame([("u",), ("v",)], "id string"),
        "feedbacks": spark.createDataFrame([("u", 1), ("v", 1), ("v", 2)], "user_id string, paper_id long"),
        "collections": spark.createDataFrame([("c1", "u"), ("c2", "v")], "id string, user_id string"),
        "collection_papers": spark.createDataFrame([("c1", 1), ("c2", 1)], "collection_id string, paper_id long"),
    }
    kept = maintain.cascade_user_delete(given, spark.createDataFrame([("u",)], "id string"))
    assert {n: t.count() for n, t in kept.items()} == {
        "profiles": 1, "feedbacks": 2, "collections": 1, "collection_papers": 1,
    }
    kept = maintain.cascade_paper_delete(given, spark.createDataFrame([(1,)], "id long"))
    assert kept["feedbacks"].count() == 1 and kept["collection_papers"].count() == 0
    rest, members = maintain.cascade_collection_delete(
        given["collections"], given["collection_papers"], spark.createDataFrame([("c2",)], "id string")
    )
    assert [r["id"] for r in rest.collect()] == ["c1"] and members.count() == 1


def test_cascade_walks_the_whole_graph(spark):
    """A reader's collection goes with the reader, and its members with the collection."""
    given = {
        "alerts": spark.createDataFrame([(1, "u"), (2, "v")], "id long, user_id string"),
        "collection_papers": spark.createDataFrame(
            [("c1", 1), ("c2", 1), ("c2", 2), ("c3", 2)], "collection_id string, paper_id long"
        ),
        "collections": spark.createDataFrame(
            [("c1", "u"), ("c2", "v"), ("c3", "v")], "id string, user_id string"
        ),
        "papers": spark.createDataFrame([(1,), (2,)], "id long"),
        "recommendations": spark.createDataFrame([("u", 2), ("v", 1), ("v", 2)], "user_id string, paper_id long"),
        "own": spark.createDataFrame([(1,)], "x long"),
    }
    kept = maintain.cascade_delete(
        given,
        {
            "profiles": spark.createDataFrame([("u",)], "id string"),
            "papers": spark.createDataFrame([(1,)], "id long"),
            "collections": spark.createDataFrame([("c3",)], "id string"),
        },
    )
    rows = {name: sorted(map(tuple, t.collect())) for name, t in kept.items()}
    assert rows == {
        "alerts": [(2, "v")], "collection_papers": [("c2", 2)], "collections": [("c2", "v")],
        "papers": [(2,)], "recommendations": [("v", 2)], "own": [(1,)],
    }
    assert list(kept) == list(given)


def test_patch_writes_only_touched_folders(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(200).selectExpr("id", "concat('p', id) AS pmid", "'t' AS title")
    tables.append_rows(rows, root, "papers")
    files = lambda: {str(f) for f in (tmp_path / "papers").rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([(7, "rct"), (9, None), (999, "rct")], "id long, study_type string")
    tables.patch_rows(changes, root, "papers", ["study_type"])
    after = tables.read_table(spark, root, "papers")
    assert after.count() == 200 and "_part" not in after.columns
    assert [r["id"] for r in after.where("study_type IS NOT NULL").collect()] == [7]
    assert 1 <= len({f.split("/papers/")[1].split("/")[0] for f in before - files()}) <= 3
    bad = changes.selectExpr("id", "CAST(raise_error('lost') AS STRING) AS study_type")
    held = files()
    with pytest.raises(Exception):
        tables.patch_rows(bad, root, "papers", ["study_type"])
    assert files() == held  # a failure leaves the table as it was


def test_replace_days(spark, tmp_path):
    path = str(tmp_path / "recs")
    schema = "user_id string, paper_id long, rec_date date"
    day = lambda rows: spark.createDataFrame(rows, "user_id string, paper_id long, d string").selectExpr(
        "user_id", "paper_id", "CAST(d AS DATE) AS rec_date"
    )
    read = lambda: {(r[0], str(r[2])) for r in spark.read.schema(schema).parquet(path).collect()}
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    maintain.replace_days(day([("u", 1, days[0]), ("v", 2, days[1]), ("w", 1, days[2])]), path, days)
    # the first gets others, the second none, the third is not named and stays
    maintain.replace_days(day([("x", 1, days[0]), ("y", 1, days[2])]), path, days[:2])
    assert read() == {("x", days[0]), ("w", days[2])}


def test_lists_kept_as_text(spark):
    rows = [(1, '["a", "b c"]'), (2, "a, b c ,"), (3, None), (4, ""), (5, "[]"), (6, '["x", 2]')]
    got = tables.normalised(spark.createDataFrame(rows, "id int, k string"), "k")
    assert {r["id"]: r["k"] for r in got.collect()} == {
        1: ["a", "b c"], 2: [], 3: [], 4: [], 5: [], 6: ["x", "2"],
    }


def test_counters_count_what_flows_by(spark):
    counters = RunCounters()
    rows = counters.count(spark.range(10), "all").where("id > 3")
    counters.count(rows, "some").write.format("noop").mode("overwrite").save()
    assert counters.values() == {"all": 10, "some": 6}
    assert counters.report(spark).first().asDict() == {"all": 10, "some": 6}


def test_default_profiles(spark):
    users = spark.createDataFrame(
        [("a", '{"name": "Ann"}'), ("b", "{}"), ("c", None), ("d", "bad"), ("e", "{}")],
        "id string, raw_user_meta_data string",
    )
    have = spark.createDataFrame([("e",)], "id string")
    got = {r["id"]: (r["name"], r["email_digest"]) for r in maintain.default_profiles(users, have).collect()}
    assert got == {"a": ("Ann", True), "b": ("", True), "c": ("", True), "d": ("", True)}


def test_onboarding(spark):
    people = spark.createDataFrame([("u", ["BPH", "own", "bph"]), ("v", None)], "id string, keywords array<string>")
    assert sorted(r["keyword"] for r in maintain.custom_keywords(people).collect()) == ["bph", "own"]
    chosen = {r["keyword"]: r["category"] for r in maintain.catalogue_choices(people).collect()}
    assert chosen == {"BPH": "Functional & Female", "own": None, "bph": None}


def test_pages_and_lookup(spark):
    table = spark.range(10).select("id", F.when(F.col("id") == 4, None).otherwise(F.col("id")).alias("t"))
    assert [r["id"] for r in tables.newest_page(table, "t", 3).collect()] == [4, 9, 8]
    assert [r["id"] for r in tables.newest_page(table, "t", 3, page=1).collect()] == [7, 6, 5]
    assert tables.one_row(table.union(table), "id", 3).count() == 2


def test_stored_schemas_round_trip(spark, tmp_path):
    for name, schema in tables.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
        assert tables.read_table(spark, str(tmp_path), name).count() == 0
    assert tables.read_table(spark, str(tmp_path), "papers", ["id"]).columns == ["id"]


def test_audit(spark):
    papers = spark.createDataFrame(
        [(1, "a", "t"), (2, "a", "t"), (3, None, "t"), (4, "d", None)], "id long, pmid string, title string"
    )
    people = spark.createDataFrame([("u", "daily"), ("v", "hourly")], "id string, digest_frequency string")
    votes = spark.createDataFrame(
        [("u", 1, "like"), ("u", 1, "save"), ("u", 99, "like"), ("x", 1, "none")],
        "user_id string, paper_id long, action string",
    )
    watch = spark.createDataFrame([(1, "v", "topic", "k"), (2, "v", "author", None)],
                                  "id long, user_id string, alert_type string, value string")
    got = {(r["table_name"], r["rule"], r["key"], r["n"]) for r in
           audit.constraint_audit(
               {"papers": papers, "profiles": people, "feedbacks": votes, "alerts": watch}
           ).collect()}
    assert got == {
        ("papers", "unique(pmid)", "a", 2), ("papers", "not_null(pmid)", "3", 1),
        ("papers", "not_null(title)", "4", 1), ("profiles", "domain(digest_frequency)", "v", 1),
        ("feedbacks", "unique(user_id,paper_id)", "u/1", 2), ("feedbacks", "reference(paper_id)", "99", 1),
        ("feedbacks", "reference(user_id)", "x", 1), ("feedbacks", "domain(action)", "1", 1),
        ("alerts", "domain(alert_type)", "1", 1), ("alerts", "not_null(value)", "2", 1),
    }


def body(*parts):
    return json.dumps({"candidates": [{"content": {"parts": list(parts)}}]})


def test_responses(spark):
    whole = json.dumps({"summary_ko": "a\nb\nc", "structured": {"study_design": "RCT"}, "clinical_relevance": 4,
                        "qa": [{"q": "q", "a": "a"}]})
    odd = json.dumps({"summary_ko": "s", "structured": {"study_design": "x"}, "clinical_relevance": "high", "qa": [{"q": "q"}]})
    few = json.dumps({"summary_ko": "only", "structured": {}, "clinical_relevance": "3", "qa": []})
    rows = [
        ("fenced", body({"text": f"```json\n{whole}\n```"})),
        ("thought", body({"text": whole}, {"text": "hm", "thought": True})),
        ("only thought", body({"text": "first", "thought": True}, {"text": " last ", "thought": True})),
        ("plain", body({"text": "just text"})),
        ("odd", body({"text": odd})),
        ("few", body({"text": few})),
        ("list", body({"text": "[1]"})),
        ("none", json.dumps({"candidates": []})),
        ("broken", "{"),
    ]
    responses = spark.createDataFrame(rows, "pmid string, body string")
    got = {r["pmid"]: r for r in enrich.parsed_responses(responses).collect()}
    assert set(got) == {"fenced", "thought", "only thought", "plain", "odd", "few", "list"}
    for key in ("fenced", "thought"):
        row = got[key]
        assert (row["summary_ko"], row["clinical_relevance"], row["malformed"]) == ("a\nb\nc", 4, False)
        assert row["structured_data"]["study_design"] == "RCT" and row["qa_data"][0]["q"] == "q"
    assert got["only thought"]["summary_ko"] == "last"
    assert (got["plain"]["summary_ko"], got["plain"]["malformed"]) == ("just text", True)
    assert got["odd"]["summary_ko"] == odd and got["odd"]["qa_data"] is None
    assert got["odd"]["clinical_relevance"] is None and got["odd"]["structured_data"]["study_design"] == "x"
    assert (got["few"]["clinical_relevance"], got["few"]["structured_data"], got["few"]["qa_data"]) == (3, None, None)
    assert got["list"]["summary_ko"] == "[1]"


def test_enrichment_candidates(spark):
    schema = ("id long, pmid string, title string, abstract string, summary_ko string, "
              "qa_data array<struct<q: string, a: string>>, clinical_relevance int, fetched_at timestamp_ntz")
    qa = [("q", "a")]
    rows = [
        (1, "1", "t", "a", "x\ny\nz", qa, 3, T0), (2, "2", "t", "a", "x\n \ny", qa, 3, T0),
        (3, "3", "t", "a", "x\ny\nz", [], 3, T0), (4, "4", "t", "a", "x\ny\nz", qa, 0, T0),
        (5, "5", "t", "a", None, qa, 3, T0), (6, "6", "t", "", None, qa, 3, T0),
        (7, "7", "", "a", "x\ny\nz", None, 3, T0 - timedelta(1)),
    ]
    table = spark.createDataFrame(rows, schema)
    assert sorted(r["id"] for r in enrich.enrichment_candidates(table).collect()) == [2, 3, 4, 5, 7]
    assert enrich.enrichment_candidates(table, 4).count() == 4
    prompts = {r["id"]: r["prompt"] for r in enrich.enrichment_requests(table, "T {title} A {abstract}!", 2).collect()}
    assert prompts[7] == "T Untitled A a!" and prompts[6] == "T t A No!"


def test_search_postings(spark):
    table = spark.createDataFrame([(1, "The PSA of the", "a psa stone, psa")], "id long, title string, abstract string")
    got = {(r["term"], r["weight"]): r["positions"] for r in search_index.search_postings(table).collect()}
    # the last indexed title word is at 2, so abstract positions start after it
    assert got == {("psa", "A"): [2], ("psa", "B"): [4, 6], ("stone", "B"): [5]}


def test_digest(spark):
    picks = spark.createDataFrame(
        [("u", 1, 2.0, (["a", "b", "c", "d"],), date(2024, 1, 21)), ("u", 2, 5.0, ([],), date(2024, 1, 21)),
         ("v", 1, 1.0, ([],), date(2024, 1, 21)), ("w", 1, 1.0, ([],), date(2024, 1, 20)),
         ("x", 1, 1.0, ([],), date(2024, 1, 21))],
        "user_id string, paper_id long, score double, r struct<l: array<string>>, rec_date date",
    ).withColumn(
        "reasons", F.struct(F.transform("r.l", lambda x: F.struct(F.lit("k").alias("type"), x.alias("label"))).alias("reasons"))
    )
    people = spark.createDataFrame(
        [("u", "", True, "u@x"), ("v", "V", True, None), ("w", "W", True, "w@x"), ("x", "X", False, "x@x")],
        "id string, name string, email_digest boolean, digest_address string",
    )
    papers = spark.createDataFrame(
        [(1, "11", None, "J", date(2024, 1, 1), ["A", "B", "C", "D"]), (2, "12", "T2", "J", None, None)],
        "id long, pmid string, title string, journal string, pub_date date, authors array<string>",
    )
    evening = "2024-01-20 20:00:00"  # the 21st in KST
    payload = digest.digest_payload(picks, papers, people, evening)
    rows = payload.collect()
    assert [r["user_id"] for r in rows] == ["u"]
    assert (rows[0]["greeting"], rows[0]["subject"]) == ("there", "Your daily picks - January 21")
    items = rows[0]["items"]
    assert [(i["rank"], i["paper_id"]) for i in items] == [(1, 2), (2, 1)]
    assert (items[1]["title"], items[1]["authors"], items[1]["why"]) == ("Untitled", "A, B, C et al.", "a | b | c")
    report = digest.digest_report(people, payload).first()
    assert tuple(report) == (3, 1, 1, 1)


def test_picks_and_progress(spark):
    day = date(2024, 1, 1)
    picks = spark.createDataFrame(
        [("u", 1, 1.0, day), ("u", 2, 3.0, day), ("v", 1, 1.0, day), ("u", 1, 9.0, date(2024, 1, 2))],
        "user_id string, paper_id long, score double, rec_date date",
    )
    papers = spark.createDataFrame(
        [(1, "a", "t", "j", None, 4), (2, "b", "t", "j", None, None)],
        "id long, pmid string, title string, journal string, pub_date date, clinical_relevance int",
    )
    votes = spark.createDataFrame([("u", 1, "like"), ("v", 1, "save"), ("x", 2, "like")],
                                  "user_id string, paper_id long, action string")
    shown = digest.picks_for_date(picks, papers, votes, F.lit(day))
    got = {(r["user_id"], r["position"]): (r["paper_id"], r["feedback_action"], r["relevance"]) for r in shown.collect()}
    assert got == {("u", 1): (2, None, None), ("u", 2): (1, "like", "High Relevance"), ("v", 1): (1, "save", "High Relevance")}
    progress = {r["user_id"]: tuple(r)[1:] for r in digest.feedback_progress(shown).collect()}
    assert progress == {"u": (2, 1, False), "v": (1, 1, True)}


def test_alerts(spark):
    watch = spark.createDataFrame(
        [(1, "u", "keyword", "PSA", True), (2, "u", "author", "kim", True), (3, "u", "journal", "urology", True),
         (4, "u", "keyword", "psa", False), (5, "v", "keyword", "psa", True), (6, "v", "author", "psa", True)],
        "id long, user_id string, alert_type string, value string, is_active boolean",
    )
    papers = spark.createDataFrame(
        [(1, "On psa", "x", ["Kim A"], "BJU"), (2, "t", "the PSA", ["Lee"], "European Urology"), (3, "t", "x", None, None)],
        "id long, title string, abstract string, authors array<string>, journal string",
    )
    got = {(r["alert_id"], r["paper_id"]) for r in alerts.alert_matches(watch, papers).collect()}
    assert got == {(1, 1), (1, 2), (5, 1), (5, 2), (2, 1), (3, 2)}


def test_lists(spark):
    wanted = spark.createDataFrame([(1, "  "), (2, " a "), (3, "b")], "id int, value string")
    added = maintain.list_entries(wanted, "value")
    assert sorted(tuple(r) for r in added.collect()) == [(2, "a"), (3, "b")]
    gone = spark.createDataFrame([(3,)], "id int")
    assert [r["id"] for r in maintain.without_entries(added, gone, ["id"]).collect()] == [2]
