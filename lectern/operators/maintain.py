"""Table maintenance: patches, deletes, defaults and appends as new snapshots."""

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import array_or_empty
from lectern.session import dropped, path_exists, remove_path, staged
from lectern.sources import vocab
from lectern.sources.tables import owned_by, patched, replace_parts

PROFILE_FIELDS = [
    "name", "institution", "keywords", "preferred_journals", "preferred_study_types",
    "email_digest",
]


def clean_tags(tags: Column) -> Column:
    """Trimmed, non-empty, unique tags in the order they were added."""
    trimmed = F.transform(tags, lambda t: F.trim(t))
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def latest_fields(log: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key and field the last value given; fields never given are NULL."""
    order = F.struct("ts", "event_id")

    def last(field):
        given = F.when(F.col(field).isNotNull(), order)
        return F.max_by(field, given).alias(field)

    return log.groupBy(key).agg(*[last(field) for field in fields])


def profile_updates(profiles: DataFrame, log: DataFrame, fields=None) -> DataFrame:
    """Profiles after a log of edits, each naming only the fields it changes."""
    fields = fields or [f for f in PROFILE_FIELDS if f in log.columns]
    types = dict(log.dtypes)
    cleaned = log.select(
        "id", "ts", "event_id",
        *[
            clean_tags(F.col(f)).alias(f) if types[f].startswith("array") else F.col(f)
            for f in fields
        ],
    )
    return patched(profiles, latest_fields(cleaned, "id", fields), "id", fields)


def soft_deleted(profiles: DataFrame, deleted: DataFrame) -> DataFrame:
    """Profiles with the deleted accounts made anonymous and silent."""
    gone = deleted.select("id").distinct().withColumn("_gone", F.lit(True))
    none = F.array().cast("array<string>")
    values = {
        "name": F.lit(vocab.DELETED_NAME),
        "keywords": none,
        "preferred_journals": none,
        "email_digest": F.lit(False),
    }
    marked = profiles.join(gone, "id", "left")
    return marked.select(
        *[
            F.when(F.col("_gone"), values[c]).otherwise(F.col(c)).alias(c)
            if c in values
            else F.col(c)
            for c in profiles.columns
        ]
    )


def without(table: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Rows that do not refer to a deleted parent."""
    ids = deleted.select(F.col(deleted.columns[0]).alias("_id"))
    return table.join(ids, F.col(column) == F.col("_id"), "left_anti")


#: What each column refers to, parents before their children.
REFERENCES = {
    "profiles": {},
    "papers": {},
    "collections": {"user_id": "profiles"},
    "collection_papers": {"collection_id": "collections", "paper_id": "papers"},
    "feedbacks": {"user_id": "profiles", "paper_id": "papers"},
    "read_history": {"user_id": "profiles", "paper_id": "papers"},
    "recommendations": {"user_id": "profiles", "paper_id": "papers"},
    "alerts": {"user_id": "profiles"},
}


def cascade_delete(
    tables: dict[str, DataFrame], deleted: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """All tables after the rows of `deleted` (table -> ids) are gone, with all that refers to them.

    Walks the references from parents to children. What a child loses is in turn deleted for its
    own children, by id. Tables and parents that are not given lose nothing.
    """
    gone = {name: ids.select(F.col(ids.columns[0]).alias("id")) for name, ids in deleted.items()}
    kept = {}
    for name, references in REFERENCES.items():
        if name not in tables:
            continue
        table = kept[name] = tables[name]
        if name in gone:
            kept[name] = without(kept[name], "id", gone[name])
        for column, parent in references.items():
            if parent not in gone:
                continue
            kept[name] = without(kept[name], column, gone[parent])
            if any(name in other.values() for other in REFERENCES.values()):
                ids = gone[parent].select(F.col("id").alias(column))
                lost = table.join(ids, column, "left_semi").select("id")
                gone[name] = gone[name].union(lost) if name in gone else lost
    return {name: kept.get(name, table) for name, table in tables.items()}


def cascade_user_delete(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    return cascade_delete(tables, {"profiles": users})


def cascade_paper_delete(tables: dict[str, DataFrame], papers: DataFrame) -> dict[str, DataFrame]:
    return cascade_delete(tables, {"papers": papers})


def cascade_collection_delete(collections, members, deleted):
    given = {"collections": collections, "collection_papers": members}
    return tuple(cascade_delete(given, {"collections": deleted}).values())


def default_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """One profile with default values per user who has none; the name from the sign-up."""
    none = F.array().cast("array<string>")
    given_name = F.get_json_object("raw_user_meta_data", "$.name")
    return users.join(profiles.select("id"), "id", "left_anti").select(
        "id",
        F.coalesce(given_name, F.lit("")).alias("name"),
        F.lit("").alias("institution"),
        none.alias("keywords"),
        none.alias("mesh_terms"),
        none.alias("preferred_journals"),
        none.alias("preferred_study_types"),
        F.lit(True).alias("email_digest"),
        F.lit("daily").alias("digest_frequency"),
        F.lit(False).alias("onboarding_done"),
    )


def list_entries(requests: DataFrame, column: str) -> DataFrame:
    """Alerts or collections to add: the value trimmed, blank ones refused."""
    return requests.withColumn(column, F.trim(column)).where(F.col(column) != "")


def without_entries(table: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(removed.select(*keys), keys, "left_anti")


def custom_keywords(profiles: DataFrame) -> DataFrame:
    """Profile keywords that are not in the catalogue; the catalogue is a fixed short list."""
    known = [k for keywords in vocab.KEYWORD_CATALOGUE.values() for k in keywords]
    return (
        profiles.select(
            F.col("id").alias("user_id"), F.explode(array_or_empty(F.col("keywords"))).alias("keyword")
        )
        .where(~F.col("keyword").isin(known))
    )


def catalogue_choices(profiles: DataFrame) -> DataFrame:
    """Profile keywords with their catalogue category, NULL for custom ones."""
    pairs = [
        (keyword, category)
        for category, keywords in vocab.KEYWORD_CATALOGUE.items()
        for keyword in keywords
    ]
    catalogue = profiles.sparkSession.createDataFrame(pairs, "keyword string, category string")
    chosen = profiles.select(
        F.col("id").alias("user_id"), F.explode(array_or_empty(F.col("keywords"))).alias("keyword")
    )
    return chosen.join(F.broadcast(catalogue), "keyword", "left")


def collection_listing(collections, members, papers) -> DataFrame:
    """Papers of every collection with its owner, a user's newest collection first.

    Sorted over the whole result, not numbered per user, so that a user with very many
    collections is spread over tasks like all others.
    """
    listed = collections.select(
        F.col("id").alias("collection_id"), "user_id", "name", "created_at"
    )
    described = papers.select(
        F.col("id").alias("paper_id"), "pmid", "title", "journal", "pub_date"
    )
    return (
        members.join(listed, "collection_id")
        .join(described, "paper_id")
        .orderBy("user_id", F.desc("created_at"), "collection_id", "paper_id")
    )


def members_of_user(members: DataFrame, collections: DataFrame, user) -> DataFrame:
    """Collection rows a user may see: the collection belongs to them."""
    own = owned_by(collections, user).select(F.col("id").alias("collection_id"))
    return members.join(own, "collection_id", "left_semi")


def replace_days(picks: DataFrame, path: str, days: list[str]) -> None:
    """Write the recommendations of `days` in place of what was there; other days stay.

    `picks` have a rec_date, and rows of other days are not written. Days with picks are replaced
    together, by one job; the folders of days without any are then removed.
    """
    spark = picks.sparkSession
    dates = [F.lit(d).cast("date") for d in days]
    rows = staged(picks.where(F.col("rec_date").isin(*dates)), "days")
    replace_parts(rows, path, "rec_date")
    filled = {str(r[0]) for r in rows.select("rec_date").distinct().collect()}
    for day in set(days) - filled:
        remove_path(spark, f"{path}/rec_date={day}")
    dropped(rows)


def replace_day(picks: DataFrame, path: str, rec_date: str, users: DataFrame | None = None):
    """Write one day of recommendations in place of what was there for these users.

    Without `users` the whole day is replaced. Only the folder of the day is written, also
    when there are no picks, so a day without picks becomes empty and other days stay.
    """
    spark = picks.sparkSession
    folder = f"{path}/rec_date={rec_date}"
    rows = picks.drop("rec_date")
    if users is not None:
        if path_exists(spark, folder):
            before = spark.read.schema(rows.schema).parquet(folder)
            others = without(before, "user_id", users)
            rows = staged(others.unionByName(rows), "day")
    rows.write.mode("overwrite").parquet(folder)
