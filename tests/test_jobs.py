"""The daily chain over stored tables."""

import json

from lectern import jobs
from lectern.sources.tables import SCHEMAS, append_rows, read_table

AS_OF = "2024-01-30 20:00:00"  # the 31st in KST


def article(pmid, journal, title, mesh, day):
    return (
        f"<PubmedArticle><PMID>{pmid}</PMID><Journal><Title>{journal}</Title></Journal>"
        f"<ArticleTitle>{title}</ArticleTitle><AbstractText>{'word ' * 30}psa</AbstractText>"
        f"<Author><LastName>Kim</LastName></Author><PubDate><Year>2024</Year><Month>Jan</Month>"
        f"<Day>{day}</Day></PubDate><MeshHeading><DescriptorName>{mesh}</DescriptorName></MeshHeading>"
        f"<Keyword>stone</Keyword></PubmedArticle>"
    )


def test_daily_chain(spark, tmp_path):
    root = str(tmp_path / "tables")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    append_rows(spark.createDataFrame([("u", "Ann", ["PSA"], True, "u@x")],
                "id string, name string, keywords array<string>, email_digest boolean, digest_address string"),
                root, "profiles")
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>" + "".join([
        article(1, "Urology", "About mice", "Mice", 29),
        article(2, "Urology", "Laparoscopy", "Laparoscopy", 28),
        article(3, "Urology", "Old", "Mice", 2),
        article(4, "Lancet", "Off topic", "Mice", 29),
        article(5, "Urology", "Reply to x", "Mice", 29),
    ]) + "</PubmedArticleSet>")
    assert sorted(r["pmid"] for r in jobs.ingest_articles(spark, root, f"{tmp_path}/a.xml", AS_OF).collect()) == ["1", "2"]
    assert jobs.ingest_articles(spark, root, f"{tmp_path}/a.xml", AS_OF).count() == 0
    summary = {r["study_type"]: r["n"] for r in jobs.reclassify(spark, root, f"{tmp_path}/a.xml").collect()}
    assert summary == {"basic_research": 1, "surgical": 1}
    stored = {r["pmid"]: r for r in read_table(spark, root, "papers").collect()}
    assert stored["2"]["study_type"] == "surgical" and stored["2"]["topic_tags"] == ["laparoscopic"]
    assert stored["1"]["keywords"] == ["stone"] and stored["1"]["id"] == 1

    for _ in range(2):  # a second run replaces the first
        assert jobs.recommend_day(spark, root, AS_OF) == "2024-01-31"
    picks = read_table(spark, root, "recommendations").collect()
    assert sorted(r["paper_id"] for r in picks) == [1, 2]
    assert all(r["reasons"]["matched_terms"] == ["PSA"] and r["is_read"] is False for r in picks)

    jobs.write_digests(spark, root, AS_OF, str(tmp_path / "digests"))
    lines = [json.loads(line) for f in (tmp_path / "digests").glob("*.json") for line in f.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["greeting"] == "Ann"
    assert [i["rank"] for i in lines[0]["items"]] == [1, 2]
    assert lines[0]["items"][0]["why"].startswith("PSA")
