"""Check SQL per query: the same result written for DuckDB over the given tables.

The SQL is written the plain way on purpose (dense pairs, self joins, gaps and islands), so
that it shares no shortcut with the operators.
"""

from lectern.plans.given import ALERT_LETTERS, check_sql
from lectern.operators.enrich import TEMPLATE
from lectern.sources import vocab

CHECKS: dict[str, str] = {}
AS_OF = "TIMESTAMP '2024-01-30 23:59:59'"
TODAY = "DATE '2024-01-30'"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _any(column: str, literals) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(x)})" for x in literals) + ")"


def _case(rules, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {_q(v)}" for c, v in rules) + f" ELSE {default} END"


def _label(column, labels, default) -> str:
    return _case([(f"{column} = {_q(k)}", v) for k, v in labels.items()], default)


def check(name: str, body: str, **own: str) -> None:
    CHECKS[name] = check_sql(body, **own)


# --- article XML ----------------------------------------------------------------------------

_ARTICLE = r"""
SELECT CAST(doc_id AS VARCHAR) AS pmid,
  concat(regexp_extract(text, '^[^.\n]*'), ' in ', lang, ' study') AS title,
  concat(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), ' H2O & more') AS abstract,
  concat(source, ' ', lang, '; Solo') AS authors,
  source AS journal,
  CASE doc_id % 5 WHEN 0 THEN DATE '2023-03-01' WHEN 3 THEN make_date(2022, 7, CAST(doc_id % 28 + 1 AS INT))
    WHEN 4 THEN DATE '2021-01-01' END AS pub_date,
  'Prostate' AS mesh_terms,
  concat('kw ', lang, '; PSA ') AS keywords,
  concat('10.1/', doc_id) AS doi,
  'Journal Article' AS pub_types
FROM documents"""
check("article_parse", _ARTICLE)
check("article_scan", _ARTICLE)
check("article_metadata", f"SELECT pmid, mesh_terms, pub_types, abstract FROM ({_ARTICLE}) a")

# --- ingest and classification ------------------------------------------------------------------

_RULE_TEXT = """
  SELECT id, lower(title) AS low_title, concat(lower(title), ' ', lower(abstract)) AS words,
    lower(array_to_string(pub_types, ' ')) AS types, list_transform(pub_types, lambda t: lower(t)) AS low_types,
    pub_types FROM papers"""

_PAPER_TYPE = _case(
    [
        (_any("low_title", vocab.REVIEW_TITLES), "review"),
        (_any("low_title", vocab.LETTER_TITLES), "letter"),
        (f"list_has_any(low_types, list_value{_in(vocab.LETTER_PUB_TYPES)})", "letter"),
        ("contains(low_title, 'editorial') OR list_contains(pub_types, 'Editorial')", "editorial"),
    ],
    "'article'",
)
_STUDY_RULES = _case(
    [(_any("types", words), kind) for kind, words in vocab.INGEST_PUB_TYPE_RULES]
    + [(_any("words", words), kind) for kind, words in vocab.INGEST_TEXT_RULES]
    + [("contains(types, 'review') OR " + _any("low_title", vocab.INGEST_REVIEW_TITLES), "review")],
    "'other'",
)
check("paper_type", f"SELECT id, {_PAPER_TYPE} AS paper_type FROM rule_text", rule_text=_RULE_TEXT)
check("study_type_rules", f"SELECT id, {_STUDY_RULES} AS study_type FROM rule_text", rule_text=_RULE_TEXT)

_SCOPES = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {_q(name)}, {str(n < len(vocab.CORE_JOURNALS)).lower()})"
    for n, name in enumerate(
        vocab.CORE_JOURNALS + vocab.ONCOLOGY_JOURNALS + vocab.GENERAL_JOURNALS
    )
) + ") v(search_order, journal, everything)"
_LISTED = """
  SELECT id, pmid, title, abstract, journal, pub_date FROM papers
  UNION ALL SELECT id, pmid, title, abstract, 'Lancet', pub_date FROM papers"""
_FOUND = rf"""
  SELECT l.*, s.search_order FROM listed l JOIN scopes s ON s.journal = l.journal
  WHERE pub_date BETWEEN {TODAY} - 365 AND {TODAY}
    AND (everything OR regexp_matches(lower(concat(title, ' ', abstract)),
         '\b({"|".join(vocab.TOPIC_WORDS)})\b'))"""
check(
    "ingest_new_papers",
    f"""
SELECT pmid, journal, search_order, paper_type, study_type, pub_date FROM (
  SELECT f.*, r.* EXCLUDE (id), {_PAPER_TYPE} AS paper_type, {_STUDY_RULES} AS study_type
  FROM found f JOIN rule_text r ON r.id = f.id
  WHERE pmid NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
    AND f.pmid <> '' AND f.title <> '' AND f.abstract <> '') t
WHERE paper_type NOT IN ('letter', 'editorial')
QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY search_order) = 1""",
    rule_text=_RULE_TEXT,
    scopes=_SCOPES,
    listed=_LISTED,
    found=_FOUND,
)

_TERM_KIND = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(k)}, {_q(v)})" for k, v in vocab.STUDY_TYPE_BY_TERM.items()
) + ") v(term, kind)"
_PRIORITY = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {_q(k)})" for n, k in enumerate(vocab.STUDY_TYPE_PRIORITY)
) + ") v(place, kind)"
_TAG_KEYS = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {_q(k)}, {_q(v)})" for n, (k, v) in enumerate(vocab.TAG_BY_TERM_PART.items())
) + ") v(ord, part, tag)"


def _dictionary(source: str) -> dict:
    """Views that classify `source` (id, title, abstract, mesh_terms, pub_types)."""
    texts = " UNION ALL ".join(
        f"SELECT id, {_q(kind)} AS kind FROM described WHERE {_any('words', words)}"
        for kind, words in vocab.STUDY_TYPE_TEXTS.items()
    )
    return {
        "term_kind": _TERM_KIND,
        "priority": _PRIORITY,
        "tag_keys": _TAG_KEYS,
        "described": f"""
  SELECT id, concat(lower(title), ' ', lower(abstract)) AS words, mesh_terms, pub_types
  FROM {source}""",
        "said_terms": """
  SELECT id, lower(unnest(list_concat(mesh_terms, pub_types))) AS term FROM described""",
        "by_term": """
  SELECT id, arg_min(p.kind, p.place) AS kind FROM said_terms
  JOIN term_kind USING (term) JOIN priority p ON p.kind = term_kind.kind GROUP BY id""",
        "by_text": f"""
  SELECT id, arg_min(p.kind, p.place) AS kind FROM ({texts}) t JOIN priority p USING (kind) GROUP BY id""",
        "typed": """
  SELECT d.id, coalesce(by_term.kind, by_text.kind,
    CASE WHEN list_contains(list_transform(d.pub_types, lambda t: lower(t)), 'review') THEN 'review' END,
    'other') AS study_type
  FROM described d LEFT JOIN by_term ON by_term.id = d.id LEFT JOIN by_text ON by_text.id = d.id""",
        "tagged": """
  SELECT d.id, coalesce(string_agg(DISTINCT tag, '; ' ORDER BY tag), '') AS tags
  FROM described d LEFT JOIN (
    SELECT id, term, arg_min(tag, ord) AS tag
    FROM (SELECT id, lower(unnest(mesh_terms)) AS term FROM described) m
    JOIN tag_keys ON contains(term, part) GROUP BY id, term) t ON t.id = d.id
  GROUP BY d.id""",
    }


check("study_type_dictionary", "SELECT id, study_type FROM typed", **_dictionary("papers"))
check("topic_tags", "SELECT id, tags FROM tagged", **_dictionary("papers"))

_BACKLOG = """
  SELECT p.id, p.title, p.mesh_terms, l.doc_id IS NOT NULL AS fresh,
    CASE WHEN l.doc_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE p.pub_types END AS pub_types,
    CASE WHEN l.doc_id IS NULL THEN '' ELSE p.abstract END AS abstract
  FROM papers p LEFT JOIN labels l ON l.doc_id = p.id WHERE p.study_type = 'other'"""
check(
    "classify_backlog",
    """
SELECT p.id, coalesce(typed.study_type, p.study_type) AS study_type,
  array_to_string(p.mesh_terms, '; ') AS mesh_terms, tagged.tags AS topic_tags
FROM papers p LEFT JOIN typed ON typed.id = p.id LEFT JOIN tagged ON tagged.id = p.id""",
    **_dictionary("backlog"),
    backlog=_BACKLOG,
)
CHECKS["patch_by_id"] = CHECKS["classify_backlog"]
check(
    "classification_summary",
    "SELECT study_type, count(*) AS n FROM typed GROUP BY study_type",
    **_dictionary("backlog"),
    backlog=_BACKLOG,
)
check(
    "unclassified_page",
    """SELECT id, pmid, fetched_at FROM papers WHERE study_type IS NULL OR study_type = 'other'
ORDER BY fetched_at DESC NULLS FIRST, id LIMIT 300""",
)
check(
    "unclassified_second_page",
    """SELECT id, pmid, fetched_at FROM papers WHERE study_type IS NULL OR study_type = 'other'
ORDER BY fetched_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20""",
)
check(
    "search_vector",
    f"""
SELECT paper_id, term, weight,
  string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
FROM (
  SELECT w.paper_id, term, weight, pos + CASE WHEN weight = 'B' THEN coalesce(shift, 0) ELSE 0 END AS pos
  FROM words w LEFT JOIN (
    SELECT paper_id, max(pos) AS shift FROM words
    WHERE weight = 'A' AND term NOT IN {_in(vocab.ENGLISH_STOP_WORDS)} GROUP BY paper_id) s
  ON s.paper_id = w.paper_id
  WHERE term NOT IN {_in(vocab.ENGLISH_STOP_WORDS)}) t
GROUP BY paper_id, term, weight""",
    words="""
  SELECT paper_id, weight, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
    SELECT id AS paper_id, 'A' AS weight,
      list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM papers
    UNION ALL SELECT id, 'B',
      list_filter(regexp_split_to_array(lower(abstract), '[^a-z0-9]+'), lambda x: x <> '') FROM papers) t""",
)
check(
    "recent_pool",
    """SELECT id, position, pub_date, fetched_at FROM (
  SELECT *, row_number() OVER (ORDER BY pub_date DESC NULLS FIRST, id) AS position
  FROM papers WHERE fetched_at >= TIMESTAMP '2024-01-01') t""",
)

# --- feedback, reads, collections ---------------------------------------------------------------------

check(
    "feedback_current",
    """
SELECT user_id, paper_id, action, ts AS created_at FROM (
  SELECT * FROM feedback_log
  QUALIFY row_number() OVER (PARTITION BY user_id, paper_id ORDER BY ts DESC, event_id DESC) = 1) t
WHERE action <> 'save'""",
)
check(
    "feedback_stream",
    """
SELECT user_id, paper_id, action, ts AS created_at FROM (
  SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS paper_id, ts,
    CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' ELSE 'none' END AS action
  FROM events WHERE event_type IN ('purchase', 'error', 'signup')
  QUALIFY row_number() OVER (
    PARTITION BY user_id, regexp_extract(props, '([0-9]+)', 1) ORDER BY ts DESC, event_id DESC) = 1) t
WHERE action <> 'none'""",
)
check(
    "liked_collections_created",
    """
SELECT md5(concat(user_id, '/Liked Papers')) AS id, user_id, 'Liked Papers' AS name, '#34C759' AS color
FROM (SELECT DISTINCT user_id FROM feedback_log WHERE action = 'like') u
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
check(
    "liked_collection",
    """
SELECT DISTINCT md5(concat(user_id, '/Liked Papers')) AS collection_id, paper_id
FROM feedback_log f WHERE action = 'like' AND NOT EXISTS (
  SELECT 1 FROM feedback_log e JOIN customer c ON c.c_custkey = e.user_id AND c_acctbal < 0
  WHERE e.action = 'like' AND e.ts < TIMESTAMP '2024-01-10'
    AND e.user_id = f.user_id AND e.paper_id = f.paper_id)""",
)
_COLLECTIONS = """
  SELECT concat(user_id, '/', event_type) AS collection_id, user_id, event_type AS name,
    min(ts) AS created_at FROM ev GROUP BY ALL"""
_MEMBERS = "SELECT DISTINCT concat(user_id, '/', event_type) AS collection_id, paper_id FROM ev"
check(
    "collection_papers",
    """
SELECT c.collection_id, user_id, name, created_at, m.paper_id, pmid, title, pub_date
FROM own_collections c
JOIN own_members m ON m.collection_id = c.collection_id JOIN papers p ON p.id = m.paper_id""",
    own_collections=_COLLECTIONS,
    own_members=_MEMBERS,
)
check(
    "members_of_user",
    """SELECT collection_id, paper_id FROM own_members m WHERE EXISTS (
  SELECT 1 FROM own_collections c WHERE c.collection_id = m.collection_id AND user_id = 7)""",
    own_collections=_COLLECTIONS,
    own_members=_MEMBERS,
)
check(
    "read_append",
    """
SELECT event_id AS id, user_id, paper_id, CAST(least(floor(value), 300) AS INT) AS dwell_seconds,
  floor(value) >= 30 AS dwelt
FROM ev WHERE event_type IN ('view', 'click') AND floor(value) >= 10""",
)
check(
    "recent_reads",
    """SELECT * FROM read_history
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY clicked_at DESC, id DESC) <= 200""",
)
check(
    "seen_papers",
    "SELECT user_id, paper_id FROM feedbacks UNION SELECT user_id, paper_id FROM read_history",
)
check(
    "dwell_batch",
    """
SELECT user_id, paper_id, last_pulse, CAST(least(floor(s + 0.5e0), 20000) AS INT) AS dwell_seconds FROM (
  SELECT user_id, paper_id, max(ts) AS last_pulse, CAST(sum(least(coalesce(
      date_diff('microsecond', ts, nxt), 7200000000), 7200000000)) AS DOUBLE) / 1e6 AS s
  FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id, paper_id ORDER BY ts) AS nxt FROM ev) t
  GROUP BY user_id, paper_id) x
WHERE least(floor(s + 0.5e0), 20000) >= 10""",
)
check(
    "dwell_stream",
    """
SELECT user_id, paper_id, started, ended, pulses,
  CAST(date_diff('microsecond', started, ended) AS DOUBLE) / 1e6 AS seconds FROM (
  SELECT user_id, paper_id, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS pulses
  FROM (SELECT *, sum(CASE WHEN gap < INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (
          PARTITION BY user_id, paper_id ORDER BY ts, event_id) AS run
        FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, paper_id ORDER BY ts, event_id) AS gap
              FROM (SELECT event_id, ts, user_id,
                      CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS paper_id FROM events) e) a) b
  GROUP BY user_id, paper_id, run) s
""",
)

# --- profiles and maintenance -----------------------------------------------------------------------------

check(
    "profile_lookup",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS institution FROM customer WHERE c_custkey = 7",
)
check(
    "profile_changes",
    """
SELECT c_custkey AS id, coalesce(n.name, c_name) AS name,
  coalesce(i.institution, c_mktsegment) AS institution, coalesce(k.keywords, 'old') AS keywords
FROM customer
LEFT JOIN (SELECT user_id, concat('name ', event_id) AS name FROM sign WHERE event_id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) n ON n.user_id = c_custkey
LEFT JOIN (SELECT user_id, concat('site ', event_id % 9) AS institution FROM sign WHERE value > 50
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) i ON i.user_id = c_custkey
LEFT JOIN (SELECT user_id, CASE WHEN event_id % 7 = 1 THEN 'psa; t1'
    ELSE concat('psa; t', event_id % 7, '; t1') END AS keywords FROM sign WHERE event_id % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) k ON k.user_id = c_custkey""",
    sign="SELECT * FROM events WHERE event_type = 'signup'",
)
check(
    "soft_delete",
    """
SELECT p.id, CASE WHEN c_acctbal < 0 THEN '[DELETED]' ELSE name END AS name, institution,
  CASE WHEN c_acctbal < 0 THEN '' ELSE coalesce(k.keywords, '') END AS keywords,
  CASE WHEN c_acctbal < 0 THEN '' ELSE array_to_string(preferred_journals, '; ') END AS preferred_journals,
  CASE WHEN c_acctbal < 0 THEN false ELSE email_digest END AS email_digest
FROM profiles p LEFT JOIN (
  SELECT user_id, string_agg(term, '; ' ORDER BY ord) AS keywords FROM user_keywords GROUP BY user_id) k
ON k.user_id = p.id""",
)
check(
    "default_profiles",
    """
SELECT o_custkey AS id, CASE WHEN m % 3 = 0 THEN concat('r', m) ELSE '' END AS name, '' AS institution,
  true AS email_digest, 'daily' AS digest_frequency, false AS onboarding_done
FROM (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY o_custkey) u
WHERE o_custkey NOT IN (SELECT user_id FROM events)""",
)
check(
    "cascade_delete",
    """
SELECT 'profiles' AS table_name, CAST(c_custkey AS VARCHAR) AS parent, 1::BIGINT AS n FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'feedbacks', CAST(user_id AS VARCHAR), count(*) FROM feedbacks
  WHERE user_id NOT IN (SELECT id FROM gone) GROUP BY user_id
UNION ALL SELECT 'read_history', CAST(user_id AS VARCHAR), count(*) FROM read_history
  WHERE user_id NOT IN (SELECT id FROM gone) GROUP BY user_id
UNION ALL SELECT 'collections', CAST(user_id AS VARCHAR), count(*) FROM own_collections
  WHERE user_id NOT IN (SELECT id FROM gone) GROUP BY user_id
UNION ALL SELECT 'collection_papers', collection_id, count(*) FROM own_members
  WHERE collection_id NOT IN (SELECT collection_id FROM own_collections WHERE user_id IN (SELECT id FROM gone))
  GROUP BY collection_id""",
    gone="SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0",
    own_collections=_COLLECTIONS,
    own_members=_MEMBERS,
)
_ALL_REQUESTS = """
  SELECT event_id AS id, user_id, CASE event_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'author' ELSE 'journal' END AS alert_type,
    CASE event_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN concat(' k', paper_id, ' ') ELSE 'psa' END AS value
  FROM ev WHERE event_type = 'click'"""
check(
    "cascade_graph",
    """
SELECT table_name, first, second, count(*) AS n FROM (
  SELECT 'papers' AS table_name, CAST(id AS VARCHAR) AS first, pmid AS second FROM papers WHERE paper_type <> 'letter'
  UNION ALL SELECT 'profiles', CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'collections', collection_id, CAST(user_id AS VARCHAR) FROM own_collections
    WHERE user_id NOT IN (SELECT id FROM gone) AND name <> 'click'
  UNION ALL SELECT 'collection_papers', m.collection_id, CAST(m.paper_id AS VARCHAR) FROM own_members m
    JOIN own_collections c USING (collection_id)
    WHERE c.user_id NOT IN (SELECT id FROM gone) AND c.name <> 'click' AND m.paper_id NOT IN (SELECT id FROM letters)
  UNION ALL SELECT 'feedbacks', CAST(user_id AS VARCHAR), CAST(paper_id AS VARCHAR) FROM feedbacks
    WHERE user_id NOT IN (SELECT id FROM gone) AND paper_id NOT IN (SELECT id FROM letters)
  UNION ALL SELECT 'read_history', CAST(id AS VARCHAR), CAST(paper_id AS VARCHAR) FROM read_history
    WHERE user_id NOT IN (SELECT id FROM gone) AND paper_id NOT IN (SELECT id FROM letters)
  UNION ALL SELECT 'recommendations', CAST(user_id AS VARCHAR), CAST(paper_id AS VARCHAR) FROM recommendations
    WHERE user_id NOT IN (SELECT id FROM gone) AND paper_id NOT IN (SELECT id FROM letters)
  UNION ALL SELECT 'alerts', CAST(id AS VARCHAR), CAST(user_id AS VARCHAR) FROM requests
    WHERE user_id NOT IN (SELECT id FROM gone)) t
GROUP BY ALL""",
    gone="SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0",
    letters="SELECT id FROM papers WHERE paper_type = 'letter'",
    own_collections=_COLLECTIONS,
    own_members=_MEMBERS,
    requests=_ALL_REQUESTS,
)
check(
    "cascade_paper_delete",
    """SELECT user_id, paper_id, action FROM feedbacks
WHERE paper_id NOT IN (SELECT id FROM papers WHERE paper_type = 'letter')""",
)
_REQUESTS = """
  SELECT event_id AS id, user_id,
    CASE event_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'author' ELSE 'journal' END AS alert_type,
    CASE event_id % 4 WHEN 1 THEN concat('k', paper_id) ELSE 'psa' END AS value, value AS amount
  FROM ev WHERE event_type = 'click' AND event_id % 4 <> 0"""
check(
    "list_changes",
    "SELECT id, user_id, alert_type, value FROM requests WHERE amount <= 100",
    requests=_REQUESTS,
)
check(
    "collection_creates",
    "SELECT id, user_id, value AS name, '#007AFF' AS color FROM requests",
    requests=_REQUESTS,
)
check(
    "constraint_audit",
    """
SELECT * FROM (
  SELECT 'papers' AS table_name, 'unique(pmid)' AS rule, coalesce(pmid, '') AS key, count(*) AS n FROM stored
    GROUP BY pmid HAVING count(*) > 1
  UNION ALL SELECT 'papers', 'not_null(pmid)', CAST(id AS VARCHAR), 1 FROM stored WHERE pmid IS NULL
  UNION ALL SELECT 'feedbacks', 'unique(user_id,paper_id)', concat(user_id, '/', paper_id), count(*) FROM log
    GROUP BY user_id, paper_id HAVING count(*) > 1
  UNION ALL SELECT 'feedbacks', 'reference(paper_id)', CAST(paper_id AS VARCHAR), count(*) FROM log
    WHERE paper_id NOT IN (SELECT id FROM stored) GROUP BY paper_id
  UNION ALL SELECT 'feedbacks', 'reference(user_id)', CAST(user_id AS VARCHAR), count(*) FROM log
    WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
  UNION ALL SELECT 'feedbacks', 'domain(action)', CAST(paper_id AS VARCHAR), 1 FROM log WHERE action = 'none'
  UNION ALL SELECT 'read_history', 'reference(paper_id)', CAST(paper_id AS VARCHAR), count(*)
    FROM (SELECT paper_id + 20 AS paper_id FROM read_history) r
    WHERE paper_id NOT IN (SELECT id FROM stored) GROUP BY paper_id
  UNION ALL SELECT 'read_history', 'reference(user_id)', CAST(user_id AS VARCHAR), count(*) FROM read_history
    WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
  UNION ALL SELECT 'profiles', 'domain(digest_frequency)', CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey % 50 = 1
  UNION ALL SELECT 'recommendations', 'not_null(score)', CAST(paper_id + 20 AS VARCHAR), 1 FROM recommendations WHERE score <= 1
  UNION ALL SELECT 'recommendations', 'reference(paper_id)', CAST(paper_id + 20 AS VARCHAR), count(*) FROM recommendations
    WHERE paper_id + 20 NOT IN (SELECT id FROM stored) GROUP BY paper_id
  UNION ALL SELECT 'recommendations', 'reference(user_id)', CAST(user_id AS VARCHAR), count(*) FROM recommendations
    WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
  UNION ALL SELECT 'collections', 'reference(user_id)', CAST(user_id + 2 AS VARCHAR), count(*) FROM own_collections
    WHERE user_id + 2 NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id
  UNION ALL SELECT 'collection_papers', 'unique(collection_id,paper_id)', concat(user_id + 1, '/', event_type, '/', paper_id + 5), count(*)
    FROM ev GROUP BY user_id, event_type, paper_id HAVING count(*) > 1
  UNION ALL SELECT 'collection_papers', 'reference(collection_id)', concat(user_id + 1, '/', event_type), count(*) FROM ev
    WHERE concat(user_id + 1, '/', event_type) NOT IN (SELECT collection_id FROM own_collections) GROUP BY user_id, event_type
  UNION ALL SELECT 'collection_papers', 'reference(paper_id)', CAST(paper_id + 5 AS VARCHAR), count(*) FROM ev
    WHERE paper_id + 5 NOT IN (SELECT id FROM stored) GROUP BY paper_id
  UNION ALL SELECT 'alerts', 'domain(alert_type)', CAST(id AS VARCHAR), 1 FROM requests WHERE id % 10 = 3
  UNION ALL SELECT 'alerts', 'not_null(value)', CAST(id AS VARCHAR), 1 FROM requests WHERE id % 9 = 0
  UNION ALL SELECT 'alerts', 'reference(user_id)', CAST(user_id AS VARCHAR), count(*) FROM requests
    WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id) t""",
    own_collections=_COLLECTIONS,
    requests=_ALL_REQUESTS,
    stored="""
  SELECT doc_id AS id, CASE WHEN doc_id % 100 = 3 THEN NULL
    ELSE substr(CAST(doc_id AS VARCHAR), 1, 3) END AS pmid FROM documents""",
    log="""
  SELECT user_id * 11 AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 11 AS paper_id,
    CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike' ELSE 'none' END AS action
  FROM events WHERE event_type IN ('purchase', 'error', 'signup')""",
)
_CATALOGUE = "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(k)}, {_q(c)})" for c, ks in vocab.KEYWORD_CATALOGUE.items() for k in ks
) + ") v(keyword, category)"
check(
    "onboarding_gap",
    """
SELECT user_id, keyword FROM (
  SELECT user_id, term AS keyword FROM user_keywords
  UNION ALL SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['BPH', 'AI']
    WHEN 1 THEN ['genomics'] ELSE ['Bph', 'ai'] END) FROM customer) t
WHERE keyword NOT IN (SELECT keyword FROM catalogue)""",
    catalogue=_CATALOGUE,
)
check(
    "catalogue_choices",
    """
SELECT user_id, keyword, category FROM (
  SELECT c_custkey AS user_id, unnest(CASE c_custkey % 3 WHEN 0 THEN ['BPH', 'AI']
    WHEN 1 THEN ['genomics'] ELSE ['Bph', 'PCNL'] END) AS keyword FROM customer) t
LEFT JOIN catalogue USING (keyword)""",
    catalogue=_CATALOGUE,
)

# --- scores and recommendations ----------------------------------------------------------------------------------

_TEMPORAL = f"""CASE WHEN pub_date IS NULL THEN 0.5e0 ELSE least(1e0,
  pow(2e0, -date_diff('day', pub_date, {TODAY}) / 365e0)
  * CASE WHEN date_diff('day', pub_date, {TODAY}) <= 7 THEN 1.5e0 ELSE 1e0 END) END"""
_SCORING = {
    "pool": """
  SELECT *, lower(title) AS low_title, lower(abstract) AS low_abstract, lower(journal) AS low_journal
  FROM (SELECT *, row_number() OVER (ORDER BY pub_date DESC NULLS FIRST, id) AS position
        FROM papers WHERE fetched_at >= TIMESTAMP '2024-01-01') t""",
    "targets": f"""
  SELECT * FROM pool WHERE paper_type NOT IN {_in(vocab.BATCH_SKIPPED_PAPER_TYPES)}
    AND NOT {_any("low_title", vocab.BATCH_SKIPPED_TITLES)} AND length(abstract) >= 100""",
    "pool_terms": "SELECT a.paper_id, a.term FROM all_terms a JOIN pool ON pool.id = a.paper_id",
    "pool_keywords": "SELECT k.paper_id, k.term FROM paper_terms k JOIN pool ON pool.id = k.paper_id",
    "pool_authors": "SELECT id AS paper_id, unnest(authors) AS author FROM pool",
    "kw_points": """
  SELECT kw, paper_id, points FROM (
    SELECT kw, pool.id AS paper_id,
      CASE WHEN t.term IS NOT NULL THEN 30 WHEN contains(low_title, kw) THEN 25
        WHEN (length(low_abstract) - length(replace(low_abstract, kw, ''))) // length(kw) >= 3 THEN 15
        WHEN contains(low_abstract, kw) THEN 3 END AS points
    FROM (SELECT DISTINCT term AS kw FROM user_keywords) u CROSS JOIN pool
    LEFT JOIN pool_terms t ON t.paper_id = pool.id AND t.term = kw) x
  WHERE points IS NOT NULL""",
    "content_part": """
  SELECT user_id, paper_id, least(sum(points), 100) AS hundredths,
    string_agg(term, '; ' ORDER BY ord) AS matched,
    list(term ORDER BY ord) AS matched_list
  FROM user_keywords JOIN kw_points ON kw = term GROUP BY user_id, paper_id""",
    "late_reads": """
  SELECT * FROM read_history""",
    "liked": "SELECT f.user_id, f.paper_id FROM feedbacks f JOIN pool ON pool.id = f.paper_id WHERE action = 'like'",
    "dwelt": """
  SELECT DISTINCT user_id, paper_id FROM late_reads JOIN pool ON pool.id = paper_id WHERE dwell_seconds >= 30""",
    "liked_terms_part": """
  SELECT l.user_id, p.paper_id, count(*) AS n FROM liked l
  JOIN pool_terms t ON t.paper_id = l.paper_id JOIN pool_terms p ON p.term = t.term GROUP BY ALL""",
    "author_part": """
  SELECT user_id, p.paper_id, count(*) AS n, list(p.author ORDER BY p.author) AS authors
  FROM (SELECT DISTINCT l.user_id, a.author FROM liked l JOIN pool_authors a ON a.paper_id = l.paper_id) u
  JOIN pool_authors p ON p.author = u.author GROUP BY ALL""",
    "disliked_part": """
  SELECT user_id, pool.id AS paper_id, count(*) AS n
  FROM (SELECT DISTINCT f.user_id, k.term FROM feedbacks f
        JOIN pool_keywords k ON k.paper_id = f.paper_id WHERE action = 'dislike') u
  JOIN (SELECT DISTINCT d.term, pool.id FROM (SELECT DISTINCT term FROM pool_keywords) d
        JOIN pool ON contains(low_abstract, d.term)
          OR EXISTS (SELECT 1 FROM pool_terms t WHERE t.paper_id = pool.id AND t.term = d.term)) pool
    ON pool.term = u.term
  GROUP BY ALL""",
    "dwell_terms_part": """
  SELECT user_id, p.paper_id, count(*) AS n
  FROM (SELECT DISTINCT d.user_id, k.term FROM dwelt d JOIN pool_keywords k ON k.paper_id = d.paper_id) u
  JOIN pool_terms p ON p.term = u.term GROUP BY ALL""",
    "dwell_journal_part": """
  SELECT DISTINCT d.user_id, p.id AS paper_id FROM dwelt d JOIN pool q ON q.id = d.paper_id
  JOIN pool p ON p.low_journal = q.low_journal WHERE q.low_journal <> ''""",
    "behaviour_part": """
  SELECT user_id, paper_id, coalesce(lt.n, 0) AS liked_terms, coalesce(ap.n, 0) AS n_authors,
    coalesce(ap.authors, CAST([] AS VARCHAR[])) AS authors, coalesce(dp.n, 0) AS disliked,
    coalesce(dt.n, 0) AS dwell_terms, dj.user_id IS NOT NULL AS dwell_journal,
    greatest(0, least(100, least(100, 15 * coalesce(lt.n, 0)) + least(50, 20 * coalesce(ap.n, 0))
      - 40 * coalesce(dp.n, 0) + least(30, 5 * coalesce(dt.n, 0))
      + CASE WHEN dj.user_id IS NULL THEN 0 ELSE 15 END)) / 100e0 AS behaviour
  FROM (SELECT user_id, paper_id FROM liked_terms_part UNION SELECT user_id, paper_id FROM author_part
        UNION SELECT user_id, paper_id FROM disliked_part UNION SELECT user_id, paper_id FROM dwell_terms_part
        UNION SELECT user_id, paper_id FROM dwell_journal_part) a
  LEFT JOIN liked_terms_part lt USING (user_id, paper_id) LEFT JOIN author_part ap USING (user_id, paper_id)
  LEFT JOIN disliked_part dp USING (user_id, paper_id) LEFT JOIN dwell_terms_part dt USING (user_id, paper_id)
  LEFT JOIN dwell_journal_part dj USING (user_id, paper_id)""",
    "likes": "SELECT user_id, paper_id FROM feedbacks WHERE action = 'like'",
    "like_counts": "SELECT user_id, count(*) AS n FROM likes GROUP BY user_id",
    "alike": """
  SELECT u, v, (shared * 2000000000 + (a.n + b.n - shared)) // (2 * (a.n + b.n - shared)) AS sim
  FROM (SELECT x.user_id AS u, y.user_id AS v, count(*) AS shared FROM likes x
        JOIN likes y ON y.paper_id = x.paper_id AND y.user_id <> x.user_id GROUP BY ALL) p
  JOIN like_counts a ON a.user_id = u JOIN like_counts b ON b.user_id = v""",
    "peer_part": """
  SELECT u AS user_id, l.paper_id, least(CAST(sum(sim) AS BIGINT), 1000000000) / 1e9 AS collaborative
  FROM alike JOIN likes l ON l.user_id = v
  WHERE NOT EXISTS (SELECT 1 FROM likes m WHERE m.user_id = u AND m.paper_id = l.paper_id)
  GROUP BY u, l.paper_id""",
    "seen": "SELECT user_id, paper_id FROM feedbacks UNION SELECT user_id, paper_id FROM late_reads",
    "wants_journal": """
  SELECT DISTINCT u.id AS user_id, q.low_journal
  FROM (SELECT id, lower(unnest(preferred_journals)) AS j FROM profiles) u
  JOIN (SELECT DISTINCT lower(journal) AS low_journal FROM papers) q
    ON contains(q.low_journal, j) OR contains(j, q.low_journal)""",
    "scored": f"""
  SELECT p.id AS user_id, t.id AS paper_id, t.position, t.journal, t.paper_type, t.study_type,
    c.matched, c.matched_list, b.authors, b.liked_terms, b.n_authors, b.dwell_terms,
    coalesce(b.dwell_journal, false) AS dwell_journal, w.user_id IS NOT NULL AS wanted_journal,
    list_contains(p.preferred_study_types, t.study_type) AS wanted_type,
    c.user_id IS NOT NULL OR s.user_id IS NOT NULL OR coalesce(b.liked_terms, 0) > 0
      OR coalesce(b.n_authors, 0) > 0 OR coalesce(b.disliked, 0) > 0 OR coalesce(b.dwell_terms, 0) > 0 AS prompted,
    (coalesce(c.hundredths, 0) + CASE WHEN w.user_id IS NULL THEN 0 ELSE 30 END) / 100e0 AS content,
    coalesce(b.behaviour, 0e0) AS behaviour, coalesce(s.collaborative, 0e0) AS collaborative,
    {_TEMPORAL} AS temporal
  FROM profiles p CROSS JOIN targets t
  LEFT JOIN content_part c ON c.user_id = p.id AND c.paper_id = t.id
  LEFT JOIN behaviour_part b ON b.user_id = p.id AND b.paper_id = t.id
  LEFT JOIN peer_part s ON s.user_id = p.id AND s.paper_id = t.id
  LEFT JOIN wants_journal w ON w.user_id = p.id AND w.low_journal = t.low_journal
  WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = p.id AND z.paper_id = t.id)""",
    "final": """
  SELECT *, floor((content * 0.3e0 + behaviour * 0.25e0 + collaborative * 0.25e0 + temporal * 0.2e0)
    * CASE WHEN paper_type = 'review' THEN 1.3e0 ELSE 1e0 END
    * CASE WHEN wanted_type THEN 1.25e0 ELSE 1e0 END * 15e0 * 100 + 0.5e0) / 100e0 AS score FROM scored""",
}
check(
    "content_score",
    "SELECT user_id, paper_id, hundredths / 100e0 AS content FROM content_part",
    **_SCORING,
)
check(
    "behaviour_score",
    """SELECT user_id, paper_id, CAST(liked_terms AS BIGINT) AS liked_terms,
  CAST(n_authors AS BIGINT) AS liked_authors, CAST(disliked AS BIGINT) AS disliked,
  CAST(dwell_terms AS BIGINT) AS dwell_terms, dwell_journal, behaviour FROM behaviour_part""",
    **_SCORING,
)
check(
    "collaborative_score",
    "SELECT s.user_id, s.paper_id, s.collaborative FROM peer_part s JOIN pool ON pool.id = s.paper_id",
    **_SCORING,
)
check(
    "temporal_score",
    f"SELECT id, floor({_TEMPORAL} * 1e6 + 0.5e0) / 1e6 AS temporal FROM papers",
)
check(
    "hybrid_score",
    """SELECT user_id, paper_id, content, behaviour, collaborative,
  floor(temporal * 1e6 + 0.5e0) / 1e6 AS temporal, score FROM final WHERE prompted""",
    **_SCORING,
)
check(
    "daily_recommendations",
    f"""
SELECT user_id, paper_id, score, rank, DATE '2024-01-31' AS rec_date,
  array_to_string(list_slice(list_concat(
    list_transform(list_slice(coalesce(matched_list, CAST([] AS VARCHAR[])), 1, 3), lambda k: concat('keyword:', k)),
    list_filter([
      CASE WHEN liked_terms > 0 THEN 'learned:{vocab.REASON_LEARNED}' END,
      CASE WHEN n_authors > 0 THEN concat('author:', array_to_string(list_slice(authors, 1, 2), ', ')) END,
      CASE WHEN dwell_terms > 0 THEN 'reading_pattern:{vocab.REASON_READING}' END,
      CASE WHEN dwell_journal THEN concat('journal:', journal) END,
      CASE WHEN temporal > 0.9 THEN 'fresh:{vocab.REASON_FRESH}' END,
      CASE WHEN paper_type = 'review' THEN 'review:{vocab.REASON_REVIEW}' END,
      CASE WHEN wanted_journal THEN concat('journal:', journal) END,
      CASE WHEN wanted_type THEN concat('keyword:', CASE study_type WHEN 'rct' THEN 'Rct'
        WHEN 'ai_ml' THEN 'Ai Ml' WHEN 'biomarker' THEN 'Biomarker' WHEN 'review' THEN 'Review' END) END
    ], lambda r: r IS NOT NULL)), 1, 5), ' | ') AS reasons,
  coalesce(array_to_string(list_slice(matched_list, 1, 10), '; '), '') AS matched
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, position) AS INT) AS rank
      FROM final WHERE score > 0) t
WHERE rank <= 5""",
    **_SCORING,
)
_INSTANT = {
    "pool": """
  SELECT *, lower(title) AS low_title, lower(abstract) AS low_abstract, lower(journal) AS low_journal
  FROM (SELECT *, row_number() OVER (ORDER BY pub_date DESC NULLS FIRST, id) AS position
        FROM papers WHERE fetched_at >= TIMESTAMP '2023-12-31') t""",
    "targets": f"""
  SELECT * FROM pool WHERE NOT {_any("low_title", vocab.INSTANT_SKIPPED_TITLES)} AND length(abstract) >= 100""",
    "kw_points": r"""
  SELECT kw, id AS paper_id, CASE WHEN regexp_matches(low_title, concat('\b', kw, '\b')) THEN 30
      WHEN regexp_matches(low_abstract, concat('\b', kw, '\b')) THEN 10 ELSE 0 END AS points
  FROM (SELECT DISTINCT term AS kw FROM user_keywords) u CROSS JOIN targets WHERE contains(low_title, kw) OR contains(low_abstract, kw)""",
    "kw_part": """
  SELECT user_id, paper_id, sum(points) AS tenths FROM user_keywords JOIN kw_points ON kw = term GROUP BY ALL""",
    "wants_journal": _SCORING["wants_journal"],
    "seen": "SELECT user_id, paper_id FROM feedbacks UNION SELECT user_id, paper_id FROM read_history",
    "scored": f"""
  SELECT p.id AS user_id, t.id AS paper_id, t.position,
    (coalesce(k.tenths, 0) + CASE WHEN w.user_id IS NULL THEN 0 ELSE 20 END
      + CASE WHEN list_contains(p.preferred_study_types, coalesce(t.study_type, 'other')) THEN 15 ELSE 0 END) / 10e0
    + CASE WHEN pub_date IS NULL THEN 0e0 ELSE greatest(0e0, 1 - greatest(0e0,
        date_diff('second', CAST(pub_date AS TIMESTAMP), {AS_OF}) / 86400e0) / 30e0) END AS raw
  FROM profiles p CROSS JOIN targets t
  LEFT JOIN kw_part k ON k.user_id = p.id AND k.paper_id = t.id
  LEFT JOIN wants_journal w ON w.user_id = p.id AND w.low_journal = t.low_journal
  WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.user_id = p.id AND z.paper_id = t.id)""",
}
check(
    "instant_recommendations",
    """
SELECT user_id, paper_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, position) AS INT) AS rank
  FROM (SELECT *, floor(raw * 100 + 0.5e0) / 100e0 AS score FROM scored WHERE raw > 0) s) t
WHERE rank <= 5""",
    **_INSTANT,
)

# --- picks and digest ------------------------------------------------------------------------------------------------

_PICKS = """
  SELECT r.*, p.pmid, p.title, f.action AS feedback_action,
    CAST(row_number() OVER (PARTITION BY r.user_id, rec_date ORDER BY score DESC, r.paper_id) AS INT) AS position,
    CASE WHEN clinical_relevance = 5 THEN 'Practice-Changing' WHEN clinical_relevance >= 4 THEN 'High Relevance' END AS relevance
  FROM recommendations r JOIN papers p ON p.id = r.paper_id
  LEFT JOIN feedbacks f ON f.user_id = r.user_id AND f.paper_id = r.paper_id"""
check(
    "picks_for_date",
    """SELECT user_id, paper_id, position, score, pmid, title, feedback_action, relevance
FROM picks WHERE rec_date = DATE '2024-01-30'""",
    picks=_PICKS,
)
check(
    "feedback_progress",
    """SELECT user_id, count(*) AS picks, count(feedback_action) AS reviewed,
  count(feedback_action) = count(*) AS all_done FROM picks
WHERE rec_date = DATE '2024-01-20' GROUP BY user_id""",
    picks=_PICKS,
)
_DIGEST = """
  SELECT r.user_id, p.digest_address, p.name, r.paper_id, r.score,
    CAST(row_number() OVER (PARTITION BY r.user_id ORDER BY score DESC, paper_id) AS INT) AS rank
  FROM recommendations r JOIN profiles p ON p.id = r.user_id
  WHERE rec_date = DATE '2024-01-20' AND email_digest AND digest_address <> ''
  QUALIFY rank <= 5"""
check(
    "digest_payload",
    """
SELECT d.user_id, d.digest_address, 'Your daily picks - January 20' AS subject, d.name AS greeting, d.rank,
  d.paper_id, a.title, a.journal, a.pub_date, array_to_string(a.authors, ', ') AS authors,
  concat('https://pubmed.ncbi.nlm.nih.gov/', a.pmid, '/') AS url,
  concat('user ', d.user_id, ' | second | third') AS why, d.score
FROM digest d JOIN papers a ON a.id = d.paper_id""",
    digest=_DIGEST,
)
check(
    "digest_report",
    """
SELECT count(*) AS wanted, count(*) FILTER (r.user_id IS NOT NULL AND digest_address IS NOT NULL) AS ready,
  count(*) FILTER (digest_address IS NULL) AS no_address,
  count(*) FILTER (r.user_id IS NULL AND digest_address IS NOT NULL) AS no_picks
FROM profiles p LEFT JOIN (SELECT DISTINCT user_id FROM recommendations WHERE rec_date = DATE '2024-01-20') r
  ON r.user_id = p.id
WHERE email_digest""",
)
_FLOW = {"rule_text": _RULE_TEXT, "scopes": _SCOPES, "listed": _LISTED, "found": _FOUND}
check(
    "run_report",
    f"""
SELECT (SELECT count(*) FROM found) AS found,
  (SELECT count(*) FROM unknown) AS unknown, (SELECT count(*) FROM good) AS valid,
  (SELECT count(DISTINCT pmid) FROM good) AS new, (SELECT count(*) FROM pool) AS pool,
  (SELECT count(*) FROM final WHERE prompted) AS scored,
  (SELECT sum(least(n, 5))::BIGINT FROM (SELECT count(*) AS n FROM final WHERE score > 0 GROUP BY user_id)) AS picked""",
    unknown="SELECT * FROM found WHERE pmid NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
    good=f"""
  SELECT f.pmid FROM unknown f JOIN rule_text r ON r.id = f.id
  WHERE f.pmid <> '' AND f.title <> '' AND f.abstract <> '' AND {_PAPER_TYPE} NOT IN ('letter', 'editorial')""",
    **_FLOW,
    **_SCORING,
)
check(
    "replace_days",
    """
SELECT user_id, paper_id, score, rec_date FROM recommendations
WHERE rec_date NOT IN (DATE '2024-01-10', DATE '2024-01-11')
UNION ALL SELECT user_id, paper_id, score, DATE '2024-01-10' FROM recommendations WHERE rec_date = DATE '2024-01-12'""",
)

# --- usage analytics ---------------------------------------------------------------------------------------------------

_SINCE = "TIMESTAMP '2024-01-23 23:59:59'"
check(
    "admin_stats",
    f"""
SELECT *, CASE WHEN total_feedbacks > 0
  THEN CAST(floor(total_likes / total_feedbacks * 100 + 0.5e0) AS BIGINT) ELSE 0 END AS like_rate
FROM (SELECT (SELECT count(*) FROM customer) AS total_users,
  (SELECT count(*) FROM papers) AS total_papers,
  (SELECT count(*) FROM papers WHERE fetched_at > {_SINCE}) AS papers_7d,
  (SELECT count(*) FROM feedbacks) AS total_feedbacks,
  (SELECT count(*) FROM feedbacks WHERE action = 'like') AS total_likes,
  (SELECT count(*) FROM feedbacks WHERE action = 'dislike') AS total_dislikes,
  (SELECT count(*) FROM read_history) AS total_reads,
  (SELECT CAST(coalesce(floor(avg(dwell_seconds) + 0.5e0), 0) AS BIGINT) FROM read_history
    WHERE dwell_seconds > 0) AS avg_dwell_seconds,
  (SELECT count(DISTINCT user_id) FROM read_history WHERE clicked_at > {_SINCE}) AS active_users_7d) t""",
)
check(
    "admin_daily_activity",
    """
SELECT *, greatest(2e0, (likes + dislikes) / greatest(1, max(likes + dislikes) OVER ()) * 100) AS bar_height,
  CASE WHEN likes + dislikes > 0 THEN likes / (likes + dislikes)
    * greatest(2e0, (likes + dislikes) / greatest(1, max(likes + dislikes) OVER ()) * 100) ELSE 0e0 END AS like_part
FROM (SELECT CAST(d AS DATE) AS day,
    (SELECT count(DISTINCT user_id) FROM read_history WHERE CAST(clicked_at AS DATE) = CAST(d AS DATE)) AS active_users,
    (SELECT count(*) FROM feedbacks WHERE CAST(created_at AS DATE) = CAST(d AS DATE) AND action = 'like') AS likes,
    (SELECT count(*) FROM feedbacks WHERE CAST(created_at AS DATE) = CAST(d AS DATE) AND action = 'dislike') AS dislikes,
    (SELECT count(*) FROM papers WHERE CAST(fetched_at AS DATE) = CAST(d AS DATE)) AS new_papers
  FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS d) c) t""",
)
_TOP_PAPERS = """
  SELECT p.id, p.title, p.journal, p.pub_date, p.study_type, p.clinical_relevance, count(*) AS like_count
  FROM feedbacks f JOIN papers p ON p.id = f.paper_id WHERE f.action = 'like'
  GROUP BY ALL ORDER BY like_count DESC, p.id LIMIT 20"""
check("admin_top_papers", "SELECT * FROM top_papers", top_papers=_TOP_PAPERS)
check(
    "admin_popular_keywords",
    """SELECT term AS keyword, count(*) AS user_count FROM user_keywords
GROUP BY term ORDER BY user_count DESC, keyword LIMIT 30""",
)
check(
    "admin_journal_dist",
    f"""SELECT journal, count(*) AS paper_count, count(*) FILTER (fetched_at > {_SINCE}) AS recent_count
FROM papers WHERE journal IS NOT NULL GROUP BY journal ORDER BY paper_count DESC, journal LIMIT 30""",
)
_ENGAGEMENT = """
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS institution,
    (SELECT count(*) FROM feedbacks WHERE user_id = c_custkey AND action = 'like') AS likes,
    (SELECT count(*) FROM feedbacks WHERE user_id = c_custkey AND action = 'dislike') AS dislikes,
    (SELECT count(*) FROM read_history WHERE user_id = c_custkey) AS reads,
    (SELECT max(clicked_at) FROM read_history WHERE user_id = c_custkey) AS last_active
  FROM customer"""
check("admin_user_engagement", "SELECT * FROM engagement", engagement=_ENGAGEMENT)
check(
    "json_result",
    """SELECT concat('[', string_agg(concat('{"id":', id, ',"study_type":"', study_type,
  '","like_count":', like_count, '}'), ',' ORDER BY like_count DESC, id), ']') AS json FROM top_papers""",
    top_papers=_TOP_PAPERS,
)
check(
    "json_engagement_rows",
    """SELECT concat('{"id":', id, ',"name":"', name, '","likes":', likes, ',"dislikes":', dislikes,
  ',"reads":', reads, '}') AS json FROM engagement""",
    engagement=_ENGAGEMENT,
)

# --- readers -----------------------------------------------------------------------------------------------------------------

_READERS = {
    "met": """
  SELECT user_id, paper_id FROM feedbacks WHERE action = 'like'
  UNION SELECT user_id, paper_id FROM read_history""",
    "topic_rows": """
  SELECT paper_id, term FROM paper_terms
  UNION ALL SELECT id, lower(unnest(mesh_terms)) FROM papers""",
    "topics": f"""
  SELECT user_id, term, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, term) AS INT) AS rank
  FROM (SELECT user_id, term, count(*) AS n FROM met JOIN topic_rows USING (paper_id)
        WHERE length(term) > 2 AND length(term) < 40 AND term NOT IN {_in(vocab.TOPIC_STOP_TERMS)}
        GROUP BY ALL) t QUALIFY rank <= 10""",
    "kinds": """
  SELECT user_id, study_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, study_type) AS INT) AS rank
  FROM (SELECT user_id, coalesce(study_type, 'other') AS study_type, count(*) AS n
        FROM met JOIN papers ON id = paper_id GROUP BY ALL) t QUALIFY rank <= 6""",
    "top_journal": """
  SELECT user_id, journal, count(*) AS n FROM met JOIN papers ON id = paper_id WHERE journal <> ''
  GROUP BY user_id, journal QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, journal) = 1""",
}
check(
    "reader_topics",
    """SELECT user_id, term, n, rank, n / sum(n) OVER (PARTITION BY user_id) AS share FROM topics""",
    **_READERS,
)
CHECKS["reader_topics_of_text_lists"] = CHECKS["reader_topics"]
check(
    "reader_study_types",
    f"""SELECT user_id, study_type, n, rank, n / max(n) OVER (PARTITION BY user_id) AS ratio,
  {_label("study_type", vocab.STUDY_TYPE_LABELS, "study_type")} AS label FROM kinds""",
    **_READERS,
)
check("reader_journal", "SELECT * FROM top_journal", **_READERS)
check(
    "reads_per_day",
    "SELECT user_id, CAST(clicked_at AS DATE) AS day, count(*) AS n FROM read_history GROUP BY ALL",
)
check(
    "reader_heatmap",
    f"""
SELECT u.user_id, CAST(pos // 7 AS INT) AS week, CAST(pos % 7 AS INT) AS slot, c.day,
  coalesce(n, 0) AS n, CAST(least(5, coalesce(n, 0)) AS INT) AS bucket
FROM (SELECT DISTINCT user_id FROM read_history) u
CROSS JOIN (SELECT pos, {TODAY} - 90 + CAST(pos AS INT) AS day FROM (SELECT unnest(range(91)) AS pos) r) c
LEFT JOIN (SELECT user_id, CAST(clicked_at AS DATE) AS day, count(*) AS n FROM read_history GROUP BY ALL) d
  ON d.user_id = u.user_id AND d.day = c.day""",
)
check(
    "reader_months",
    f"""
SELECT label, CAST(min(week) AS INT) AS start, count(*) AS span, CAST(sum(n) AS BIGINT) AS reads FROM (
  SELECT *, sum(changed) OVER (ORDER BY week) AS run FROM (
    SELECT w.*, coalesce(r.n, 0) AS n,
      CASE WHEN label = lag(label) OVER (ORDER BY w.week) THEN 0 ELSE 1 END AS changed
    FROM (SELECT week, strftime({TODAY} - CAST((25 - week) * 7 AS INT), '%b') AS label
          FROM (SELECT unnest(range(26)) AS week) x) w
    LEFT JOIN (SELECT 25 - date_diff('day', CAST(clicked_at AS DATE), {TODAY}) // 7 AS week, count(*) AS n
               FROM read_history WHERE CAST(clicked_at AS DATE) BETWEEN {TODAY} - 181 AND {TODAY} GROUP BY 1) r
      ON r.week = w.week) a) b
GROUP BY run, label""",
)
_TOTALS = f"""
SELECT m.user_id, m.total, coalesce(l.liked, 0) AS liked, coalesce(s.streak, 0) AS streak
FROM (SELECT user_id, count(*) AS total FROM met GROUP BY user_id) m
LEFT JOIN (SELECT user_id, count(*) AS liked FROM feedbacks WHERE action = 'like' GROUP BY user_id) l
  ON l.user_id = m.user_id
LEFT JOIN (SELECT user_id, CAST(count(*) AS INT) AS streak FROM (
    SELECT user_id, day, day + CAST(row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS INT) AS island
    FROM (SELECT DISTINCT user_id, CAST(clicked_at AS DATE) AS day FROM read_history
          WHERE CAST(clicked_at AS DATE) <= {TODAY}) d) i
  WHERE island = {TODAY} + 1 GROUP BY user_id) s ON s.user_id = m.user_id"""
check("reader_totals", _TOTALS, met=_READERS["met"])
check(
    "reader_totals_of_a_week",
    f"SELECT * REPLACE (least(streak, 7) AS streak) FROM ({_TOTALS}) t",
    met=_READERS["met"],
)
check(
    "reader_summary",
    f"""
SELECT t.user_id, concat('Your reading is centered on ', first, ' and ', second, '. ',
  CAST(CAST(floor(k.n / f.papers * 100 + 0.5e0) AS INT) AS VARCHAR), '% are ',
  {_label("k.study_type", vocab.STUDY_TYPE_LABELS, "k.study_type")}, '.',
  CASE WHEN j.journal IS NULL THEN '' ELSE concat(' Most read: ', j.journal, ' (', j.n, ').') END) AS summary
FROM (SELECT user_id, max(term) FILTER (rank = 1) AS first, max(term) FILTER (rank = 2) AS second
      FROM topics GROUP BY user_id HAVING max(term) FILTER (rank = 2) IS NOT NULL) t
JOIN kinds k ON k.user_id = t.user_id AND k.rank = 1
JOIN (SELECT user_id, count(*) AS papers FROM met JOIN papers ON id = paper_id GROUP BY user_id) f
  ON f.user_id = t.user_id
LEFT JOIN top_journal j ON j.user_id = t.user_id""",
    **_READERS,
)
check(
    "learned_interests",
    """
SELECT user_id,
  coalesce(string_agg(value, '; ' ORDER BY rank) FILTER (kind = 'author' AND rank <= 5), '') AS authors,
  coalesce(string_agg(value, '; ' ORDER BY rank) FILTER (kind = 'keyword' AND rank <= 8), '') AS keywords,
  coalesce(string_agg(value, '; ' ORDER BY rank) FILTER (kind = 'journal' AND rank <= 5), '') AS journals
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY n DESC, value) AS rank FROM (
    SELECT user_id, kind, value, count(*) AS n FROM feedbacks JOIN (
      SELECT id AS paper_id, 'author' AS kind, unnest(authors) AS value FROM papers
      UNION ALL SELECT paper_id, 'keyword', term FROM paper_terms
      UNION ALL SELECT id, 'journal', journal FROM papers WHERE journal <> '') v USING (paper_id)
    WHERE action = 'like' GROUP BY ALL) c) r
GROUP BY user_id""",
)

# --- enrichment, text, alerts --------------------------------------------------------------------------------------------------

_CANDIDATES = """
  SELECT * FROM (SELECT * FROM papers WHERE abstract <> '') t
  WHERE summary_ko IS NULL OR summary_ko = 'one line' OR NOT has_qa OR clinical_relevance = 0"""
check(
    "enrichment_candidates",
    "SELECT id, pmid, fetched_at FROM candidates",
    candidates=_CANDIDATES,
)
_before, _rest = TEMPLATE.split("{title}")
_between, _after = _rest.split("{abstract}")
check(
    "enrichment_request",
    f"""
SELECT id, pmid, concat({_q(_before)}, CASE WHEN title = '' THEN 'Untitled' ELSE title END, {_q(_between)},
  abstract, {_q(_after)}) AS prompt FROM candidates""",
    candidates=_CANDIDATES,
)
check(
    "enrichment_parse",
    r"""
SELECT pmid, summary_ko, study_design, sample_size, clinical_relevance, question, answer,
  summary_ko <> '' AND len(list_filter(string_split(summary_ko, chr(10)), lambda x: regexp_matches(x, '\S'))) <> 3 AS malformed
FROM (SELECT CAST(doc_id AS VARCHAR) AS pmid,
  CASE doc_id % 4 WHEN 1 THEN concat('plain ', doc_id, ' ', text, ' end')
    WHEN 2 THEN concat('{"summary_ko":', CAST(to_json(text) AS VARCHAR), ',"structured":{"study_design":"', lang,
      '"},"clinical_relevance":"high","qa":[{"q":"', source, '","a":"', lang, '"}]}')
    ELSE text END AS summary_ko,
  CASE WHEN doc_id % 4 <> 1 THEN lang END AS study_design,
  CASE WHEN doc_id % 4 IN (0, 3) THEN CAST(n_chars AS VARCHAR) END AS sample_size,
  CASE WHEN doc_id % 4 IN (0, 3) AND doc_id % 6 <> 0 THEN CAST(doc_id % 6 AS INT) END AS clinical_relevance,
  CASE WHEN doc_id % 4 IN (0, 3) THEN source END AS question,
  CASE WHEN doc_id % 4 IN (0, 3) THEN lang END AS answer
  FROM documents) t""",
)
check(
    "enrichment_report",
    r"""
SELECT count(*) AS asked, count(l.doc_id) AS done, count(*) - count(l.doc_id) AS failed,
  count(*) FILTER (l.doc_id IS NOT NULL AND (d.doc_id % 4 IN (1, 2) AND d.lines <> 3
    OR d.doc_id % 4 IN (0, 3) AND d.text <> '' AND d.lines <> 3)) AS malformed
FROM candidates c
JOIN (SELECT doc_id, text, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE len(list_filter(string_split(text, chr(10)),
        lambda x: regexp_matches(x, '\S'))) END AS lines FROM documents) d ON d.doc_id = c.id
LEFT JOIN labels l ON l.doc_id = c.id""",
    candidates=_CANDIDATES,
)
check(
    "paper_text",
    f"""
SELECT id, CAST(greatest(1, ceil(len(regexp_split_to_array(abstract, '\\s+')) / 200)) AS INT) AS minutes,
  CASE WHEN k.pattern IS NULL THEN title
    ELSE regexp_replace(title, concat('(?i)(', k.pattern, ')'), '<mark>\\1</mark>', 'g') END AS marked,
  concat(authors[1], ' et al.') AS first_author, array_to_string(authors, ', ') AS authors,
  concat(array_to_string(authors, ', '), '. ', title, ' ', journal, '. ',
    CAST(coalesce(pub_date, DATE '2000-01-01') AS VARCHAR), '. PMID: ', pmid) AS citation,
  CASE study_type WHEN 'rct' THEN 'Rct' WHEN 'ai_ml' THEN 'Ai Ml' WHEN 'retrospective' THEN 'Retrospective'
    WHEN 'biomarker' THEN 'Biomarker' WHEN 'review' THEN 'Review' ELSE 'Other' END AS titled,
  {_label("study_type", vocab.BADGE_LABELS, "'Article'")} AS badge,
  CASE WHEN clinical_relevance = 5 THEN 'Practice-Changing' WHEN clinical_relevance >= 4 THEN 'High Relevance' END AS relevance,
  concat('https://pubmed.ncbi.nlm.nih.gov/', pmid, '/') AS url,
  CASE WHEN doi <> '' THEN concat('https://doi.org/', doi) END AS doi_url
FROM papers LEFT JOIN (SELECT paper_id, string_agg(term, '|' ORDER BY ord) AS pattern FROM paper_terms
  GROUP BY paper_id) k ON k.paper_id = id""",
)
check(
    "alert_match",
    f"""
SELECT w.id AS alert_id, w.alert_type, lower(w.value) AS value, p.id AS paper_id FROM wanted w
JOIN (SELECT * FROM papers WHERE fetched_at > {_SINCE}) p ON CASE w.alert_type
  WHEN 'keyword' THEN contains(lower(p.title), lower(w.value)) OR contains(lower(p.abstract), lower(w.value))
  WHEN 'author' THEN len(list_filter(p.authors, lambda a: contains(lower(a), lower(w.value)))) > 0
  ELSE contains(lower(p.journal), lower(w.value)) END
WHERE w.c_acctbal >= 0""",
    wanted="""
  SELECT id, c_acctbal, CASE id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'author' ELSE 'journal' END AS alert_type,
    CASE id % 3 WHEN 0 THEN coalesce(k.term, 'psa') WHEN 1 THEN concat('LAB ', id % 97)
      ELSE concat('Urology', CASE WHEN id % 2 = 0 THEN ' Focus' ELSE '' END) END AS value
  FROM profiles LEFT JOIN (SELECT c_custkey AS user_id, term FROM customer, n_docs
    JOIN alert_words ON paper_id = c_custkey * 7 % n) k ON k.user_id = profiles.id""",
    alert_words=rf"""
  SELECT paper_id, arg_min(term, pos) AS term
  FROM (SELECT doc_id AS paper_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term
        FROM (SELECT doc_id, regexp_split_to_array(
                regexp_replace(lower(text), '[^a-z \n\t\r]', '', 'g'), '[ \n\t\r]+') AS w
              FROM documents) s0) s1
  WHERE length(term) >= {ALERT_LETTERS} GROUP BY paper_id""",
)
