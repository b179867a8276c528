"""The engine's tables as views of the given tables.

The given tables hold no articles, so article columns are derived from `documents`, readers
from `customer` and feedback and reads from `events`. Rule vocabulary the invented prose
lacks is appended by document number. Expressions both engines understand are kept as
text and used by the Spark views here and by the check SQL alike.
"""

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.operators.feedback import current_feedback
from lectern.session import spread_out, staged
from lectern.sources import vocab

AS_OF = "2024-01-30 23:59:59"

#: An article's keywords are all words of its text with so many letters; a reader's are those of
#: one article.
KEYWORD_LETTERS = 10
#: An alert's keyword is the first word of the reader's article with so many letters.
ALERT_LETTERS = 4

JOURNALS = vocab.CORE_JOURNALS + vocab.ONCOLOGY_JOURNALS[:4]

TITLE_ENDING = """CASE doc_id % 29 WHEN 3 THEN ' Reply to the authors' WHEN 5 THEN ': a review'
 WHEN 7 THEN ' Erratum' WHEN 11 THEN ' - Editorial' WHEN 13 THEN ' Research letter: x'
 WHEN 17 THEN ' by machine learning' WHEN 19 THEN ', a randomized study'
 WHEN 23 THEN ' (correspondence)' WHEN 27 THEN ': systematic review' ELSE '' END"""

ABSTRACT_ENDING = """CASE doc_id % 13 WHEN 1 THEN ' A retrospective chart review of prostate cancer.'
 WHEN 3 THEN ' Randomised phase III study of the bladder.'
 WHEN 4 THEN ' Deep learning for renal imaging.'
 WHEN 6 THEN ' An in vitro xenograft study.'
 WHEN 8 THEN ' Population-based incidence, nationwide.'
 WHEN 9 THEN ' Practice guideline and consensus statement.'
 WHEN 11 THEN ' MRI and CT scan of the kidney; a case series.' ELSE '' END"""

PUB_DATE = """CAST(CASE WHEN doc_id % 50 = 7 THEN NULL
 ELSE DATE '2024-01-31' - INTERVAL '1' DAY * CAST(doc_id * 7 % 730 AS INT) END AS DATE)"""

PAPER_TYPE = """CASE doc_id % 10 WHEN 0 THEN 'review' WHEN 1 THEN 'letter'
 WHEN 2 THEN 'editorial' ELSE 'article' END"""

STUDY_TYPE = """CASE doc_id % 6 WHEN 0 THEN 'rct' WHEN 1 THEN 'ai_ml' WHEN 2 THEN 'retrospective'
 WHEN 3 THEN 'biomarker' WHEN 4 THEN 'review' ELSE 'other' END"""

SUMMARY = """CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'one line'
 ELSE concat('first', chr(10), 'second', chr(10), ' ', chr(10), 'third') END"""

# lists are written as {arr}...) because the two dialects name the constructor differently
MESH_TERMS = """CASE doc_id % 12
 WHEN 0 THEN {arr}'Humans', 'Retrospective Studies', 'Prostatic Neoplasms')
 WHEN 1 THEN {arr}'Humans', 'Female', 'Urinary Bladder Neoplasms')
 WHEN 2 THEN {arr}'Mice', 'Prognosis', 'Kidney Neoplasms')
 WHEN 3 THEN {arr}'Prostate-Specific Antigen', 'Aged')
 WHEN 4 THEN {arr}'Kidney Calculi', 'Tomography, X-Ray Computed')
 WHEN 6 THEN {arr}'Machine Learning', 'Prostate')
 WHEN 7 THEN {arr}'Robotic Surgical Procedures', 'Prostatectomy')
 WHEN 8 THEN {arr}'Quality of Life', 'Survival Rate', 'Humans')
 WHEN 10 THEN {arr}'Carcinoma, Renal Cell', 'Immunotherapy')
 WHEN 11 THEN {arr}'Urinary Incontinence', 'Risk Factors') END"""

PUB_TYPES = """CASE doc_id % 9
 WHEN 0 THEN {arr}'Journal Article')
 WHEN 1 THEN {arr}'Journal Article', 'Randomized Controlled Trial')
 WHEN 2 THEN {arr}'Review')
 WHEN 3 THEN {arr}'Editorial')
 WHEN 4 THEN {arr}'Letter', 'Comment')
 WHEN 5 THEN {arr}'Meta-Analysis', 'Systematic Review')
 WHEN 7 THEN {arr}'Case Reports')
 WHEN 8 THEN {arr}'Journal Article', 'Review') END"""

AUTHORS = "{arr}concat(source, ' ', lang), concat('Lab ', CAST(doc_id % 97 AS STRING)))"

STUDY_PREFERENCE = """CASE c_custkey % 4 WHEN 0 THEN {arr}'rct') WHEN 1 THEN {arr}'review', 'ai_ml')
 WHEN 2 THEN {arr}'biomarker') END"""

# every third event goes to one of the first hundred articles, the others to any article
EVENT_PAPER = """CASE WHEN event_id % 3 = 0 THEN k ELSE (k + event_id * 7) % n END"""

FEEDBACK_ACTION = """CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike'
 ELSE 'save' END"""


def _spark(text: str):
    return F.expr(text.replace("{arr}", "array("))


def _long_words(letters: int):
    """The distinct words of `text` with so many letters, in order."""
    words = F.split(F.regexp_replace(F.lower("text"), r"[^a-z \n\t\r]", ""), r"[ \n\t\r]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= letters))


class Given:
    """Lazy views over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A view written as a table first, as the engine's own tables are."""
        return staged(getattr(self, name), name)

    @cached_property
    def documents(self) -> DataFrame:
        return spread_out(self.table("documents"), "doc_id")

    @cached_property
    def n_documents(self):
        return self.table("documents").agg(F.count("*")).scalar()

    @cached_property
    def papers(self) -> DataFrame:
        journal = F.element_at(
            F.array(*[F.lit(j) for j in JOURNALS]),
            F.expr("CAST(substr(source, 4) AS INT) + 1"),
        )
        no_terms = F.array().cast("array<string>")
        return self.documents.select(
            F.col("doc_id").alias("id"),
            F.col("doc_id").cast("string").alias("pmid"),
            F.concat(F.regexp_extract("text", r"^[^.\n]*", 0), _spark(TITLE_ENDING)).alias("title"),
            F.concat("text", _spark(ABSTRACT_ENDING)).alias("abstract"),
            _spark(AUTHORS).alias("authors"),
            journal.alias("journal"),
            _spark(PUB_DATE).alias("pub_date"),
            F.coalesce(_spark(MESH_TERMS), no_terms).alias("mesh_terms"),
            _long_words(KEYWORD_LETTERS).alias("keywords"),
            F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('10.1000/', doc_id) END").alias("doi"),
            _spark(PAPER_TYPE).alias("paper_type"),
            _spark(STUDY_TYPE).alias("study_type"),
            F.coalesce(_spark(PUB_TYPES), no_terms).alias("pub_types"),
            F.expr(
                "TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL '1' DAY * CAST(doc_id % 45 AS INT)"
            ).alias("fetched_at"),
            _spark(SUMMARY).alias("summary_ko"),
            F.expr("CAST(doc_id % 6 AS INT)").alias("clinical_relevance"),
            F.expr(
                "CASE WHEN doc_id % 8 = 2 THEN array() ELSE array(struct('q' AS q, 'a' AS a)) END"
            ).alias("qa_data"),
            "lang",
        )

    @cached_property
    def profiles(self) -> DataFrame:
        return self._profiles(KEYWORD_LETTERS)

    @cached_property
    def alert_profiles(self) -> DataFrame:
        """Profiles with the words that alerts are made of."""
        return self._profiles(ALERT_LETTERS)

    def _profiles(self, letters: int) -> DataFrame:
        liked_by_field = F.col("c_custkey") * 7 % self.n_documents
        customers = self.table("customer").withColumn("source_id", liked_by_field)
        terms = self.documents.select(
            F.col("doc_id").alias("source_id"), _long_words(letters).alias("keywords")
        )
        names = F.array(*[F.lit(j) for j in JOURNALS])
        own = F.element_at(names, F.expr("CAST(c_custkey % 20 AS INT) + 1"))
        none = F.array().cast("array<string>")
        return customers.join(terms, "source_id", "left").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("institution"),
            "keywords",
            F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("urology"), own))
            .when(F.col("c_custkey") % 5 == 1, none)
            .otherwise(F.array(own))
            .alias("preferred_journals"),
            F.coalesce(_spark(STUDY_PREFERENCE), none).alias("preferred_study_types"),
            (F.col("c_custkey") % 3 != 0).alias("email_digest"),
            F.expr(
                "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(c_name, '@example.org') END"
            ).alias("digest_address"),
            "c_acctbal",
        )

    @cached_property
    def readers(self) -> DataFrame:
        """Profiles without the keyword lookup."""
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("institution"),
            "c_acctbal",
        )

    @cached_property
    def events(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
        numbered = self.table("events").select("*", k.alias("k"), self.n_documents.alias("n"))
        return numbered.select(
            "event_id", "ts", "user_id", "event_type", "value",
            _spark(EVENT_PAPER).alias("paper_id"),
        )

    @cached_property
    def feedback_log(self) -> DataFrame:
        votes = self.events.where(F.col("event_type").isin("purchase", "error", "signup"))
        return votes.select(
            "event_id", "user_id", "paper_id", "ts", _spark(FEEDBACK_ACTION).alias("action")
        )

    @cached_property
    def feedbacks(self) -> DataFrame:
        return current_feedback(self.feedback_log)

    @cached_property
    def read_history(self) -> DataFrame:
        visits = self.events.where(F.col("event_type").isin("view", "click"))
        return visits.select(
            F.col("event_id").alias("id"),
            "user_id",
            "paper_id",
            F.expr("CAST(floor(value) AS INT)").alias("dwell_seconds"),
            F.col("ts").alias("clicked_at"),
        )

    @cached_property
    def recommendations(self) -> DataFrame:
        """Stored picks: one per user, article and day, taken from the views."""
        shown = self.events.where(F.col("event_type") == "view")
        label = lambda text: F.struct(F.lit("keyword").alias("type"), text.alias("label"))
        reasons = F.struct(
            F.array(
                label(F.concat(F.lit("user "), F.col("user_id"))),
                label(F.lit("second")), label(F.lit("third")), label(F.lit("fourth")),
            ).alias("reasons")
        )
        return shown.groupBy(
            "user_id", "paper_id", F.to_date("ts").alias("rec_date")
        ).agg(F.max("value").alias("score")).withColumn("reasons", reasons)


# --- the same views for the check SQL -------------------------------------------------


def _duck(text: str) -> str:
    return text.replace("{arr}", "list_value(")


def _list(values) -> str:
    return "list_value(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


CTES = {
    "n_docs": "SELECT count(*) AS n FROM documents",
    "paper_terms": rf"""
  SELECT paper_id, term, row_number() OVER (PARTITION BY paper_id ORDER BY p0) AS ord
  FROM (SELECT paper_id, term, min(pos) AS p0
        FROM (SELECT doc_id AS paper_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term
              FROM (SELECT doc_id, regexp_split_to_array(
                      regexp_replace(lower(text), '[^a-z \n\t\r]', '', 'g'), '[ \n\t\r]+') AS w
                    FROM documents) s0) s1
        WHERE length(term) >= {KEYWORD_LETTERS} GROUP BY paper_id, term) s2""",
    "papers": f"""
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS pmid,
    concat(regexp_extract(text, '^[^.\\n]*'), {TITLE_ENDING}) AS title,
    concat(text, {ABSTRACT_ENDING}) AS abstract,
    {_duck(AUTHORS)} AS authors,
    {_list(JOURNALS)}[CAST(substr(source, 4) AS INT) + 1] AS journal,
    {PUB_DATE} AS pub_date,
    coalesce({_duck(MESH_TERMS)}, CAST([] AS VARCHAR[])) AS mesh_terms,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('10.1000/', doc_id) END AS doi,
    {PAPER_TYPE} AS paper_type,
    {STUDY_TYPE} AS study_type,
    coalesce({_duck(PUB_TYPES)}, CAST([] AS VARCHAR[])) AS pub_types,
    TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' DAY * CAST(doc_id % 45 AS INT) AS fetched_at,
    {SUMMARY} AS summary_ko,
    CAST(doc_id % 6 AS INT) AS clinical_relevance,
    doc_id % 8 <> 2 AS has_qa,
    lang
  FROM documents""",
    "all_terms": """
  SELECT paper_id, lower(term) AS term FROM paper_terms
  UNION SELECT id, lower(unnest(mesh_terms)) FROM papers""",
    "user_keywords": """
  SELECT c.c_custkey AS user_id, t.term, t.ord FROM customer c, n_docs
  JOIN paper_terms t ON t.paper_id = c.c_custkey * 7 % n""",
    "profiles": f"""
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS institution,
    CASE WHEN c_custkey % 5 = 0 THEN list_value('urology', {_list(JOURNALS)}[c_custkey % 20 + 1])
         WHEN c_custkey % 5 = 1 THEN CAST([] AS VARCHAR[])
         ELSE list_value({_list(JOURNALS)}[c_custkey % 20 + 1]) END AS preferred_journals,
    coalesce({_duck(STUDY_PREFERENCE)}, CAST([] AS VARCHAR[])) AS preferred_study_types,
    c_custkey % 3 <> 0 AS email_digest,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(c_name, '@example.org') END AS digest_address,
    c_acctbal
  FROM customer""",
    "ev": f"""
  SELECT event_id, ts, user_id, event_type, value, {EVENT_PAPER} AS paper_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events), n_docs""",
    "feedback_log": f"""
  SELECT event_id, user_id, paper_id, ts, {FEEDBACK_ACTION} AS action
  FROM ev WHERE event_type IN ('purchase', 'error', 'signup')""",
    "feedbacks": """
  SELECT user_id, paper_id, action, ts AS created_at FROM feedback_log
  QUALIFY row_number() OVER (PARTITION BY user_id, paper_id ORDER BY ts DESC, event_id DESC) = 1""",
    "read_history": """
  SELECT event_id AS id, user_id, paper_id,
    CAST(floor(value) AS INT) AS dwell_seconds, ts AS clicked_at
  FROM ev WHERE event_type IN ('view', 'click')""",
    "recommendations": """
  SELECT user_id, paper_id, CAST(ts AS DATE) AS rec_date, max(value) AS score
  FROM ev WHERE event_type = 'view' GROUP BY ALL""",
}


def check_sql(body: str, **own: str) -> str:
    """`body` with the views it names in front of it; `own` adds views of one query."""
    views = {**CTES, **own}
    needed: list[str] = []

    def need(text):
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if views[name] is not text:
                    need(views[name])
                    needed.append(name)

    need(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" + body
