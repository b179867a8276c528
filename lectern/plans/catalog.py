"""All queries: name -> (spark, folder of the given tables) -> DataFrame.

Each one runs an operator over whole tables. Lists are printed as text, so that engines can
be compared on plain columns.
"""

import uuid
from functools import reduce, wraps

from pyspark.sql import DataFrame, functions as F

from lectern.functions import dates, text
from lectern.operators import (
    admin, alerts, audit, classify, digest, dwell, enrich, feedback, ingest, insights,
    maintain, pool, recommend, scoring, search_index, signals,
)
from lectern.operators.colikes import peer_scores
from lectern.operators.counters import RunCounters
from lectern.operators.shelves import reader_wishes
from lectern.plans.given import AS_OF, Given
from lectern.session import shared_folder, staged
from lectern.sources import articles, calendars, tables, vocab
from lectern.streaming.dwell import (
    close_sessions, stream_dwell_sessions, with_marks, write_sessions,
)
from lectern.streaming.feedback import FeedbackState, follow_feedback

QUERIES: dict = {}


def query(function):
    @wraps(function)
    def run(spark, sf_dir) -> DataFrame:
        return function(Given(spark, sf_dir))

    QUERIES[function.__name__] = run
    return run


#: The product looks at so many newest reads of a reader.
READS_CONSIDERED = 200


def _run_id() -> str:
    return uuid.uuid4().hex


def joined(column, separator="; "):
    return F.array_join(column, separator)


def six_digits(column):
    return F.floor(column * 1e6 + F.lit(0.5)) / F.lit(1e6)


# --- article XML ------------------------------------------------------------------------


def _escaped(column):
    clean = F.regexp_replace(column, r"[\x00-\x08\x0b-\x1f]", "")
    amp = F.replace(clean, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def article_xml(documents: DataFrame) -> DataFrame:
    """Documents printed as article records, with inline markup and odd dates."""
    first = _escaped(F.regexp_extract("text", r"^[^.\n]*", 0))
    parts = [
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\"> "),
        F.col("doc_id"),
        F.lit(" </PMID><Article><Journal><JournalIssue><PubDate>"),
        F.expr("""CASE doc_id % 5 WHEN 0 THEN '<Year>2023</Year><Month>Mar</Month>'
          WHEN 1 THEN '<Year>2024</Year><Month>02</Month><Day>31</Day>'
          WHEN 2 THEN '<MedlineDate>Winter</MedlineDate>'
          WHEN 3 THEN concat('<Year>2022</Year><Month>7</Month><Day>', doc_id % 28 + 1, '</Day>')
          ELSE '<Year>2021</Year><Month>Spring</Month><Day>9</Day>' END"""),
        F.lit("</PubDate></JournalIssue><Title>"), F.col("source"),
        F.lit("</Title></Journal><ArticleTitle>"), first,
        F.lit(" <i>in <b>"), F.col("lang"), F.lit("</b></i> study</ArticleTitle><Abstract>"),
        F.lit("<AbstractText Label=\"MAIN\">"), _escaped(F.col("text")),
        F.lit("</AbstractText><AbstractText/><AbstractText>H<sub>2</sub>O &amp; more"),
        F.lit("</AbstractText></Abstract><AuthorList><Author ValidYN=\"Y\"><LastName>"),
        F.col("source"), F.lit("</LastName><ForeName>"), F.col("lang"),
        F.lit("</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author>"),
        F.lit("<Author><LastName>Solo</LastName></Author></AuthorList>"),
        F.lit("<PublicationTypeList><PublicationType UI=\"D1\">Journal Article"),
        F.lit("</PublicationType><PublicationType/></PublicationTypeList></Article>"),
        F.lit("<MeshHeadingList><MeshHeading><DescriptorName UI=\"D2\">Prostate"),
        F.lit("</DescriptorName><QualifierName>x</QualifierName></MeshHeading></MeshHeadingList>"),
        F.lit("<KeywordList><Keyword MajorTopicYN=\"N\">kw "), F.col("lang"),
        F.lit("</Keyword><Keyword>PSA <i>level</i></Keyword><Keyword><i>y</i>z</Keyword>"),
        F.lit("</KeywordList></MedlineCitation><PubmedData><ArticleIdList>"),
        F.lit("<ArticleId IdType=\"pubmed\">1</ArticleId><ArticleId IdType=\"doi\">10.1/"),
        F.col("doc_id"),
        F.lit("</ArticleId><ArticleId IdType=\"doi\">other</ArticleId></ArticleIdList>"),
        F.lit("</PubmedData></PubmedArticle>"),
    ]
    return documents.select(F.concat(*[p.cast("string") for p in parts]).alias("xml"))


def _printed(parsed: DataFrame) -> DataFrame:
    lists = ("authors", "mesh_terms", "keywords", "pub_types")
    return parsed.select(
        *[joined(F.col(c)).alias(c) if c in lists else F.col(c) for c in parsed.columns]
    )


@query
def article_parse(g):
    return _printed(articles.parse_articles(article_xml(g.documents)))


@query
def article_scan(g):
    """The same records written as files first, and scanned record by record."""
    folder = f"{shared_folder(g.spark)}/articles-{_run_id()}"
    article_xml(g.documents).write.text(folder)
    return _printed(articles.read_articles(g.spark, folder))


@query
def article_metadata(g):
    parsed = articles.parse_articles(article_xml(g.documents))
    return _printed(articles.article_metadata(parsed))


# --- ingest and classification ------------------------------------------------------------


def _new_articles(g, counters=None):
    columns = ["id", "pmid", "title", "abstract", "journal", "pub_date", "pub_types"]
    own = g.papers.select(*columns)
    listed_twice = own.unionByName(own.withColumn("journal", F.lit("Lancet")))
    found = ingest.found_by_search(listed_twice, AS_OF, days=365)
    stored = g.table("labels").select(F.col("doc_id").cast("string").alias("pmid"))
    return ingest.new_articles(found, stored, counters).select(
        "pmid", "journal", "search_order", "paper_type", "study_type", "pub_date"
    )


@query
def ingest_new_papers(g):
    return _new_articles(g)


@query
def recent_pool(g):
    return pool.pool_order(pool.recent_pool(g.papers, AS_OF))


@query
def paper_type(g):
    return g.papers.select(
        "id", classify.paper_type(F.col("title"), F.col("pub_types")).alias("paper_type")
    )


@query
def study_type_rules(g):
    kind = classify.study_type_by_rules(F.col("title"), F.col("abstract"), F.col("pub_types"))
    return g.papers.select("id", kind.alias("study_type"))


@query
def study_type_dictionary(g):
    kind = classify.study_type_by_dictionary(
        F.col("mesh_terms"), F.col("pub_types"), F.col("title"), F.col("abstract")
    )
    return g.papers.select("id", kind.alias("study_type"))


@query
def topic_tags(g):
    return g.papers.select("id", joined(classify.topic_tags(F.col("mesh_terms"))).alias("tags"))


def _reclassified(g):
    known = g.table("labels").select(F.col("doc_id").cast("string").alias("pmid"))
    fresh = g.papers.select("pmid", "mesh_terms", "pub_types", "abstract").join(known, "pmid")
    return classify.reclassified(classify.unclassified(g.papers), fresh)


@query
def unclassified_page(g):
    page = tables.newest_page(classify.unclassified(g.papers), "fetched_at", 300)
    return page.select("id", "pmid", "fetched_at")


@query
def unclassified_second_page(g):
    page = tables.newest_page(classify.unclassified(g.papers), "fetched_at", 20, 1)
    return page.select("id", "pmid", "fetched_at")


@query
def classify_backlog(g):
    stored = g.papers.select(
        "id", "study_type", "mesh_terms", F.lit(None).cast("array<string>").alias("topic_tags")
    )
    return classify.with_classification(stored, _reclassified(g)).select(
        "id", "study_type",
        joined(F.col("mesh_terms")).alias("mesh_terms"),
        joined(F.col("topic_tags")).alias("topic_tags"),
    )


@query
def patch_by_id(g):
    """The backlog classified in the stored papers table, and the table read back."""
    root = f"{shared_folder(g.spark)}/tables-{_run_id()}"
    tables.append_rows(g.papers.drop("summary_ko", "qa_data"), root, "papers")
    fields = ["study_type", "topic_tags", "mesh_terms"]
    tables.patch_rows(staged(_reclassified(g), "changes"), root, "papers", fields)
    return tables.read_table(g.spark, root, "papers").select(
        "id", "study_type",
        joined(F.col("mesh_terms")).alias("mesh_terms"),
        joined(F.col("topic_tags")).alias("topic_tags"),
    )


@query
def classification_summary(g):
    return classify.classification_summary(_reclassified(g))


@query
def search_vector(g):
    return search_index.search_postings(g.papers).select(
        "paper_id", "term", "weight", joined(F.col("positions").cast("array<string>"), " ").alias("positions")
    )


# --- feedback, reads, collections ------------------------------------------------------------


def _log_with_undo(g):
    action = F.when(F.col("action") == "save", "none").otherwise(F.col("action"))
    return g.feedback_log.withColumn("action", action)


@query
def feedback_current(g):
    return feedback.current_feedback(_log_with_undo(g))


@query
def feedback_stream(g):
    """The event folder followed as a stream; the state ends as in feedback_current."""
    schema = g.table("events").schema
    stream = g.spark.readStream.schema(schema).parquet(f"{g.sf_dir}/event[s].parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    changes = stream.where(F.col("event_type").isin("purchase", "error", "signup")).select(
        "event_id", "user_id", k.alias("paper_id"), "ts",
        F.expr("""CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike'
                  ELSE 'none' END""").alias("action"),
    )
    run = f"{shared_folder(g.spark)}/feedback-{_run_id()}"
    state = FeedbackState(g.spark, f"{run}/state", changes.schema)
    follow_feedback(changes, state, f"{run}/checkpoint").awaitTermination()
    return state.current()


def _collections(g):
    """Readers in debt have their collection of liked papers already."""
    name = F.lit(vocab.LIKED_COLLECTION_NAME)
    return g.readers.where("c_acctbal < 0").select(
        feedback.collection_key(F.col("id"), name).alias("id"),
        F.col("id").alias("user_id"),
        name.alias("name"),
    )


def _members(g):
    early = g.feedback_log.where("action = 'like' AND ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    key = feedback.collection_key(F.col("user_id"), F.lit(vocab.LIKED_COLLECTION_NAME))
    own = _collections(g).select(F.col("id").alias("collection_id"))
    members = early.select(key.alias("collection_id"), "paper_id").distinct()
    return members.join(own, "collection_id", "left_semi")


@query
def liked_collections_created(g):
    return feedback.liked_collections(g.feedback_log, _collections(g))


@query
def liked_collection(g):
    created = feedback.liked_collections(g.feedback_log, _collections(g))
    every = _collections(g).unionByName(created.select("id", "user_id", "name"))
    return feedback.liked_collection_papers(g.feedback_log, every, _members(g))


def _own_collections(g):
    """One collection per reader and kind of event, made with the first such event."""
    return g.events.groupBy("user_id", "event_type").agg(
        F.min("ts").alias("created_at")
    ).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("id"),
        "user_id",
        F.col("event_type").alias("name"),
        "created_at",
    )


def _own_members(g):
    return g.events.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("collection_id"),
        "paper_id",
    ).distinct()


@query
def collection_papers(g):
    return maintain.collection_listing(_own_collections(g), _own_members(g), g.papers).select(
        "collection_id", "user_id", "name", "created_at", "paper_id", "pmid", "title", "pub_date"
    )


@query
def members_of_user(g):
    return maintain.members_of_user(_own_members(g), _own_collections(g), 7)


@query
def read_append(g):
    visits = g.events.where("event_type IN ('view', 'click')").select(
        F.col("event_id").alias("id"), "user_id", "paper_id",
        F.floor("value").cast("int").alias("dwell_seconds"),
    )
    return feedback.reads_to_append(visits).withColumn("dwelt", F.col("dwell_seconds") >= 30)


@query
def recent_reads(g):
    return feedback.recent_reads(g.read_history, READS_CONSIDERED)


@query
def seen_papers(g):
    return feedback.seen_papers(g.feedbacks, g.read_history)


@query
def dwell_batch(g):
    pulses = g.events.select("user_id", "paper_id", "ts")
    return dwell.dwell_from_pulses(pulses, idle=7200, floor=10, cap=20000)


@query
def dwell_stream(g):
    """The event folder as a pulse stream with a two-hour idle time, closed at its end."""
    schema = g.table("events").schema
    stream = g.spark.readStream.schema(schema).parquet(f"{g.sf_dir}/event[s].parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    pulses = stream.select("user_id", (k % 5).alias("paper_id"), "ts")
    run = f"{shared_folder(g.spark)}/dwell-{_run_id()}"
    sessions = stream_dwell_sessions(with_marks(pulses, f"{run}/marks"), idle=7200)
    write_sessions(sessions, f"{run}/sessions", f"{run}/checkpoint").awaitTermination()
    close_sessions(g.table("events"), f"{run}/marks", idle=7200)
    write_sessions(sessions, f"{run}/sessions", f"{run}/checkpoint").awaitTermination()
    stored = g.spark.read.schema(sessions.schema).parquet(f"{run}/sessions")
    ntz = lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return stored.select(
        "user_id", "paper_id", ntz("started").alias("started"), ntz("ended").alias("ended"),
        "pulses", "seconds",
    )


# --- profiles and maintenance --------------------------------------------------------------------


@query
def profile_lookup(g):
    return tables.one_row(g.readers, "id", 7).select("id", "name", "institution")


@query
def profile_changes(g):
    log = g.events.where("event_type = 'signup'").select(
        F.col("user_id").alias("id"), "ts", "event_id",
        F.expr("CASE WHEN event_id % 2 = 0 THEN concat('name ', event_id) END").alias("name"),
        F.expr("CASE WHEN value > 50 THEN concat('site ', event_id % 9) END").alias("institution"),
        F.expr(
            """CASE WHEN event_id % 3 = 0
               THEN array(' psa ', concat('t', event_id % 7), 'psa', '  ', 't1') END"""
        ).alias("keywords"),
    )
    before = g.readers.select(
        "id", "name", "institution", F.array(F.lit("old")).alias("keywords")
    )
    return maintain.profile_updates(before, log).withColumn(
        "keywords", joined(F.col("keywords"))
    )


def _in_debt(g):
    return g.readers.where("c_acctbal < 0").select("id")


@query
def soft_delete(g):
    return maintain.soft_deleted(g.profiles, _in_debt(g)).select(
        "id", "name", "institution",
        joined(F.col("keywords")).alias("keywords"),
        joined(F.col("preferred_journals")).alias("preferred_journals"),
        "email_digest",
    )


@query
def default_profiles(g):
    users = g.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.expr("""CASE max(o_orderkey) % 3 WHEN 0 THEN concat('{"name": "r', max(o_orderkey), '"}')
                  WHEN 1 THEN '{}' END""").alias("raw_user_meta_data")
    )
    present = g.events.select(F.col("user_id").alias("id")).distinct()
    return maintain.default_profiles(users, present).select(
        "id", "name", "institution", "email_digest", "digest_frequency", "onboarding_done"
    )


@query
def cascade_delete(g):
    kept = maintain.cascade_user_delete(
        {
            "profiles": g.readers.select("id"),
            "feedbacks": g.feedbacks,
            "read_history": g.read_history,
            "collections": _own_collections(g),
            "collection_papers": _own_members(g),
        },
        _in_debt(g),
    )
    by_user = [
        kept[name].groupBy("user_id").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table_name"), F.col("user_id").cast("string").alias("parent"), "n"
        )
        for name in ("feedbacks", "read_history", "collections")
    ]
    rest = kept["collection_papers"].groupBy("collection_id").agg(F.count("*").alias("n")).select(
        F.lit("collection_papers").alias("table_name"), F.col("collection_id").alias("parent"), "n"
    )
    people = kept["profiles"].select(
        F.lit("profiles").alias("table_name"), F.col("id").cast("string").alias("parent"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return by_user[0].union(by_user[1]).union(by_user[2]).union(rest).union(people)


@query
def cascade_paper_delete(g):
    letters = g.papers.where("paper_type = 'letter'").select("id")
    kept = maintain.cascade_paper_delete(
        {"papers": g.papers.select("id"), "feedbacks": g.feedbacks, "read_history": g.read_history},
        letters,
    )
    return kept["feedbacks"].select("user_id", "paper_id", "action")


def _all_tables(g):
    """The eight tables with the columns that name and join their rows."""
    alerts = _requests(g).withColumn("value", F.when(F.col("id") % 9 > 0, F.col("value")))
    return {
        "papers": g.papers.select("id", "pmid", "title", "paper_type"),
        "profiles": g.readers.select("id"),
        "collections": _own_collections(g),
        "collection_papers": _own_members(g),
        "feedbacks": g.feedbacks,
        "read_history": g.read_history,
        "recommendations": g.recommendations,
        "alerts": alerts,
    }


@query
def cascade_graph(g):
    """Readers in debt, letters and collections of clicks deleted: all that is left, by row."""
    given = _all_tables(g)
    kept = maintain.cascade_delete(
        given,
        {
            "profiles": _in_debt(g),
            "papers": given["papers"].where("paper_type = 'letter'").select("id"),
            "collections": given["collections"].where("name = 'click'").select("id"),
        },
    )
    keys = {
        "papers": ("id", "pmid"), "profiles": ("id", "id"), "collections": ("id", "user_id"),
        "collection_papers": ("collection_id", "paper_id"), "feedbacks": ("user_id", "paper_id"),
        "read_history": ("id", "paper_id"), "recommendations": ("user_id", "paper_id"),
        "alerts": ("id", "user_id"),
    }
    rows = [
        kept[name].select(
            F.lit(name).alias("table_name"), F.col(a).cast("string").alias("first"),
            F.col(b).cast("string").alias("second"),
        )
        for name, (a, b) in keys.items()
    ]
    return reduce(DataFrame.union, rows).groupBy("table_name", "first", "second").agg(
        F.count("*").alias("n")
    )


def _requests(g):
    return g.events.where("event_type = 'click'").select(
        F.col("event_id").alias("id"), "user_id",
        F.expr("CASE event_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'author' ELSE 'journal' END").alias("alert_type"),
        F.expr("CASE event_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN concat(' k', paper_id, ' ') ELSE 'psa' END").alias("value"),
    )


@query
def list_changes(g):
    added = maintain.list_entries(_requests(g), "value")
    removed = g.events.where("event_type = 'click' AND value > 100").select(
        F.col("event_id").alias("id")
    )
    return maintain.without_entries(added, removed, ["id"])


@query
def collection_creates(g):
    wanted = _requests(g).select("id", "user_id", F.col("value").alias("name"))
    return maintain.list_entries(wanted, "name").withColumn(
        "color", F.lit(vocab.DEFAULT_COLLECTION_COLOR)
    )


@query
def constraint_audit(g):
    log = g.table("events").where("event_type IN ('purchase', 'error', 'signup')").select(
        (F.col("user_id") * 11).alias("user_id"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") * 11).alias("paper_id"),
        F.expr("""CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike'
                  ELSE 'none' END""").alias("action"),
    )
    stored = g.papers.select(
        "id", F.expr("CASE WHEN id % 100 = 3 THEN NULL ELSE substr(pmid, 1, 3) END").alias("pmid"),
        "title",
    )
    profiles = g.readers.select(
        "id", F.expr("CASE id % 50 WHEN 1 THEN 'hourly' WHEN 2 THEN NULL ELSE 'daily' END").alias("digest_frequency")
    )
    shift = lambda table: table.withColumn("paper_id", F.col("paper_id") + 20)
    given = _all_tables(g)
    return audit.constraint_audit(
        {
            "papers": stored,
            "profiles": profiles,
            "feedbacks": log,
            "read_history": shift(g.read_history.select("user_id", "paper_id")),
            "recommendations": shift(g.recommendations).withColumn(
                "score", F.when(F.col("score") > 1, F.col("score"))
            ),
            "collections": given["collections"].withColumn("user_id", F.col("user_id") + 2),
            "collection_papers": g.events.select(
                F.concat_ws("/", (F.col("user_id") + 1).cast("string"), "event_type").alias("collection_id"),
                (F.col("paper_id") + 5).alias("paper_id"),
            ),
            "alerts": given["alerts"].withColumn(
                "alert_type", F.when(F.col("id") % 10 == 3, F.lit("topic")).otherwise(F.col("alert_type"))
            ),
        }
    )


@query
def onboarding_gap(g):
    chosen = g.profiles.select(
        "id",
        F.concat(
            "keywords",
            F.expr("""CASE id % 3 WHEN 0 THEN array('BPH', 'AI') WHEN 1 THEN array('genomics')
                      ELSE array('Bph', 'ai') END"""),
        ).alias("keywords"),
    )
    return maintain.custom_keywords(chosen)


@query
def catalogue_choices(g):
    chosen = g.readers.select(
        "id",
        F.expr("""CASE id % 3 WHEN 0 THEN array('BPH', 'AI') WHEN 1 THEN array('genomics')
                  ELSE array('Bph', 'PCNL') END""").alias("keywords"),
    )
    return maintain.catalogue_choices(chosen)


# --- scores and recommendations ---------------------------------------------------------------------


def _pool(g):
    return pool.staged_pool(pool.recent_pool(g.papers, AS_OF))


@query
def content_score(g):
    """Pairs with a keyword match; every other pair has 0."""
    recent = _pool(g)
    facets = signals.profile_facets(g.stored("profiles")).where("facet = 'keyword'")
    postings = signals.keyword_postings(facets, recent)
    pairs = signals.evidence(facets, postings, recent)
    return pairs.select(
        "user_id", "paper_id",
        scoring.content_score(F.col("keyword_tenths")).alias("content"),
    )


@query
def behaviour_score(g):
    """Pairs that agree with a reader's history in something; every other pair has 0."""
    recent = _pool(g)
    visits = feedback.dwelt(feedback.recent_reads(g.read_history))
    facets = staged(signals.history_facets(g.feedbacks, visits, recent), "facets")
    postings = (
        signals.history_postings(recent)
        .union(signals.journal_postings(recent))
        .union(signals.keyword_postings(facets, recent))
    )
    pairs = signals.evidence(facets, postings, recent)
    score = scoring.behaviour_score(
        F.col("liked_terms"), F.col("liked_authors"), F.col("disliked"), F.col("dwell_terms"),
        F.col("dwell_journal"),
    )
    return pairs.select(
        "user_id", "paper_id", "liked_terms", "liked_authors", "disliked", "dwell_terms", "dwell_journal", score.alias("behaviour"),
    )


@query
def collaborative_score(g):
    """Pairs with a like-minded reader; every other pair has 0."""
    targets = pool.recent_pool(g.papers, AS_OF).select(F.col("id").alias("paper_id"))
    likes = insights.likes_of(g.stored("feedbacks"))
    scores = peer_scores(likes, staged(targets, "targets"))
    return scores.select(
        "user_id", "paper_id",
        scoring.collaborative_score(F.col("billionths")).alias("collaborative"),
    )


@query
def temporal_score(g):
    return g.papers.select(
        "id", six_digits(scoring.temporal_score(F.col("pub_date"), AS_OF)).alias("temporal")
    )


@query
def hybrid_score(g):
    """All parts of the score for unseen pairs with evidence of their own."""
    recent = _pool(g)
    targets = pool.recommendable(recent)
    reads = feedback.recent_reads(g.stored("read_history"))
    votes = g.stored("feedbacks")
    facets = recommend.reader_facets(g.stored("profiles"), votes, reads, recent)
    seen = feedback.seen_papers(votes, reads)
    articles = recommend.shelf_articles(targets)
    keywords = recommend.keyword_postings(facets, targets)
    pairs = recommend.evidence_pairs(facets, keywords, votes, seen, targets)
    wishes = reader_wishes(facets, recommend.journals_of(articles))
    scored = scoring.scored(recommend.described(pairs, articles, wishes), AS_OF)
    return scored.select(
        "user_id", "paper_id", "content", "behaviour", "collaborative",
        six_digits(F.col("temporal")).alias("temporal"), "score",
    )


def printed_reasons(column):
    return joined(F.transform(column, lambda r: F.concat(r["type"], F.lit(":"), r["label"])), " | ")


@query
def daily_recommendations(g):
    picks = recommend.daily_recommendations(
        g.stored("profiles"), g.papers, g.stored("feedbacks"), g.stored("read_history"), AS_OF
    )
    return picks.select(
        "user_id", "paper_id", "score", "rank", "rec_date",
        printed_reasons(F.col("reasons.reasons")).alias("reasons"),
        joined(F.col("reasons.matched_terms")).alias("matched"),
    )


@query
def instant_recommendations(g):
    return recommend.instant_recommendations(
        g.stored("profiles"), g.papers, g.stored("feedbacks"), g.stored("read_history"), AS_OF
    )


# --- picks and digest ------------------------------------------------------------------------------------


@query
def picks_for_date(g):
    return digest.picks_for_date(
        g.recommendations, g.papers, g.feedbacks, F.lit("2024-01-30").cast("date")
    ).select(
        "user_id", "paper_id", "position", "score", "pmid", "title", "feedback_action", "relevance"
    )


@query
def feedback_progress(g):
    return digest.feedback_progress(
        digest.picks_for_date(
            g.recommendations, g.papers, g.feedbacks, dates.kst_date(F.lit("2024-01-20 10:00:00").cast("timestamp_ntz"))
        )
    )


DIGEST_TIME = "2024-01-20 10:00:00"


@query
def digest_payload(g):
    payload = digest.digest_payload(g.recommendations, g.papers, g.profiles, DIGEST_TIME)
    return payload.select(
        "user_id", "digest_address", "subject", "greeting", F.explode("items").alias("i")
    ).select("user_id", "digest_address", "subject", "greeting", "i.*")


@query
def digest_report(g):
    payload = digest.digest_payload(g.recommendations, g.papers, g.profiles, DIGEST_TIME)
    return digest.digest_report(g.profiles, payload)


@query
def run_report(g):
    """Counts of one ingest and one recommendation run, taken while their rows were written."""
    counters = RunCounters()
    staged(_new_articles(g, counters), "new-articles")
    recommend.daily_recommendations(
        g.stored("profiles"), g.papers, g.stored("feedbacks"), g.stored("read_history"), AS_OF,
        counters=counters,
    )
    return counters.report(g.spark)


@query
def replace_days(g):
    """Picks of all days stored; then one day gets others, one none, and all are read back."""
    path = f"{shared_folder(g.spark)}/tables-{_run_id()}/recommendations"
    picks = g.recommendations.select("user_id", "paper_id", "score", "rec_date")
    days = [str(r[0]) for r in g.spark.sql(
        "SELECT explode(sequence(DATE'2024-01-01', DATE'2024-02-29', INTERVAL 1 DAY))"
    ).collect()]
    maintain.replace_days(picks, path, days)
    changed = ["2024-01-10", "2024-01-11"]
    others = picks.where("rec_date = DATE'2024-01-12'").withColumn(
        "rec_date", F.lit(changed[0]).cast("date")
    )
    maintain.replace_days(others, path, changed)
    stored = g.spark.read.schema("user_id bigint, paper_id bigint, score double, rec_date date")
    return stored.parquet(path)


# --- usage analytics -----------------------------------------------------------------------------------------


@query
def admin_stats(g):
    return admin.overall_stats(g.readers, g.papers, g.feedbacks, g.read_history, AS_OF)


@query
def admin_daily_activity(g):
    return admin.activity_bars(
        admin.daily_activity(g.papers, g.feedbacks, g.read_history, AS_OF)
    )


@query
def admin_top_papers(g):
    return admin.top_papers(g.feedbacks, g.papers)


@query
def admin_popular_keywords(g):
    return admin.popular_keywords(g.profiles)


@query
def admin_journal_dist(g):
    return admin.journal_distribution(g.papers, AS_OF)


@query
def admin_user_engagement(g):
    return admin.user_engagement(g.readers, g.feedbacks, g.read_history)


@query
def json_result(g):
    top = admin.top_papers(g.feedbacks, g.papers).select("id", "study_type", "like_count")
    return admin.json_array(top, [F.desc("like_count"), F.asc("id")], 20)


@query
def json_engagement_rows(g):
    people = admin.user_engagement(g.readers, g.feedbacks, g.read_history)
    return admin.json_rows(people.select("id", "name", "likes", "dislikes", "reads"))


# --- readers ------------------------------------------------------------------------------------------------------


@query
def reader_topics(g):
    return insights.reader_topics(g.feedbacks, g.read_history, g.papers)


@query
def reader_topics_of_text_lists(g):
    """The same topics where one list is stored as JSON text and the other as an array."""
    papers = g.papers.select("id", "mesh_terms", F.to_json("keywords").alias("keywords"))
    lists = tables.normalised(papers, "keywords", "mesh_terms")
    return insights.reader_topics(g.feedbacks, g.read_history, lists)


@query
def reader_study_types(g):
    top = insights.reader_study_types(g.feedbacks, g.read_history, g.papers)
    return top.withColumn("label", text.label_of(F.col("study_type"), vocab.STUDY_TYPE_LABELS))


@query
def reader_journal(g):
    return insights.reader_journal(g.feedbacks, g.read_history, g.papers)


@query
def reads_per_day(g):
    return insights.reads_per_day(g.read_history)


@query
def reader_heatmap(g):
    return insights.reader_heatmap(g.read_history, AS_OF, 13)


@query
def reader_months(g):
    """Month labels over the weeks of the heatmap, with the reads of each run."""
    months = insights.heatmap_months(g.spark, AS_OF, 26)
    weeks = calendars.heat_calendar(g.spark, AS_OF, 26)
    reads = g.read_history.groupBy(F.to_date("clicked_at").alias("day")).agg(F.count("*").alias("n"))
    per_week = weeks.join(reads, "day", "left").groupBy("week").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    spread = months.withColumn(
        "week", F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("span") - 1).cast("int")))
    )
    return spread.join(per_week, "week").groupBy("label", "start", "span").agg(
        F.sum("n").alias("reads")
    )


@query
def reader_totals(g):
    return insights.reader_totals(g.feedbacks, g.read_history, AS_OF, None)


@query
def reader_totals_of_a_week(g):
    """With a streak of seven days at most, as a badge shows it."""
    return insights.reader_totals(g.feedbacks, g.read_history, AS_OF, 7)


@query
def reader_summary(g):
    return insights.reader_summary(g.feedbacks, g.read_history, g.papers)


@query
def learned_interests(g):
    return insights.learned_interests(g.feedbacks, g.papers).select(
        "user_id",
        *[joined(F.col(c)).alias(c) for c in ("authors", "keywords", "journals")],
    )


# --- enrichment, text, alerts ------------------------------------------------------------------------------------------


@query
def enrichment_candidates(g):
    return enrich.enrichment_candidates(g.papers).select("id", "pmid", "fetched_at")


@query
def enrichment_request(g):
    return enrich.enrichment_requests(enrich.enrichment_candidates(g.papers))


def model_responses(documents: DataFrame) -> DataFrame:
    """Landed responses around the documents' own text."""
    whole = """to_json(named_struct('summary_ko', text, 'structured',
        named_struct('study_design', lang, 'sample_size', CAST(n_chars AS STRING)),
        'clinical_relevance', CAST(doc_id % 6 AS INT),
        'qa', array(named_struct('q', source, 'a', lang))))"""
    odd = """to_json(named_struct('summary_ko', text, 'structured',
        named_struct('study_design', lang), 'clinical_relevance', 'high',
        'qa', array(named_struct('q', source, 'a', lang))))"""
    said = f"""CASE doc_id % 4 WHEN 0 THEN concat('```json', chr(10), {whole}, chr(10), '```')
        WHEN 1 THEN concat('plain ', CAST(doc_id AS STRING), ' ', text, ' end')
        WHEN 2 THEN {odd} ELSE {whole} END"""
    body = f"""to_json(named_struct('candidates', array(named_struct('content', named_struct(
        'parts', array(named_struct('text', 'let me think', 'thought', true),
                       named_struct('text', {said}, 'thought', false)))))))"""
    return documents.select(F.col("doc_id").cast("string").alias("pmid"), F.expr(body).alias("body"))


@query
def enrichment_parse(g):
    parsed = enrich.parsed_responses(model_responses(g.documents))
    return parsed.select(
        "pmid", "summary_ko",
        F.col("structured_data.study_design").alias("study_design"),
        F.col("structured_data.sample_size").alias("sample_size"),
        "clinical_relevance",
        F.col("qa_data")[0]["q"].alias("question"),
        F.col("qa_data")[0]["a"].alias("answer"),
        "malformed",
    )


@query
def enrichment_report(g):
    """Responses have landed for the labelled documents only."""
    labelled = g.table("labels").select("doc_id")
    landed = g.documents.join(labelled, "doc_id", "left_semi")
    parsed = enrich.parsed_responses(model_responses(landed))
    requests = enrich.enrichment_requests(enrich.enrichment_candidates(g.papers))
    return enrich.enrichment_report(requests, parsed)


@query
def paper_text(g):
    title, abstract = F.col("title"), F.col("abstract")
    return g.papers.select(
        "id",
        text.reading_minutes(abstract).alias("minutes"),
        text.highlighted(title, F.col("keywords")).alias("marked"),
        text.author_list(F.col("authors"), 1).alias("first_author"),
        text.author_list(F.col("authors"), 5).alias("authors"),
        text.citation(F.col("authors"), title, F.col("journal"), F.coalesce("pub_date", F.lit("2000-01-01").cast("date")), F.col("pmid")).alias("citation"),
        text.titled_code(F.col("study_type")).alias("titled"),
        text.label_of(F.col("study_type"), vocab.BADGE_LABELS, F.lit("Article")).alias("badge"),
        text.relevance_label(F.col("clinical_relevance")).alias("relevance"),
        text.article_url(F.col("pmid")).alias("url"),
        text.doi_url(F.col("doi")).alias("doi_url"),
    )


@query
def alert_match(g):
    wanted = g.alert_profiles.select(
        "id", F.col("id").alias("user_id"),
        F.expr("CASE id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'author' ELSE 'journal' END").alias("alert_type"),
        F.expr("""CASE id % 3 WHEN 0 THEN coalesce(get(keywords, 0), 'psa') WHEN 1
                  THEN concat('LAB ', CAST(id % 97 AS STRING)) ELSE concat('Urology', CASE WHEN id % 2 = 0
                  THEN ' Focus' ELSE '' END) END""").alias("value"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )
    fresh = g.papers.where(F.col("fetched_at") > dates.days_before(AS_OF, 7))
    return alerts.alert_matches(wanted, fresh).select("alert_id", "alert_type", "value", "paper_id")
