"""The tables and their schemas."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import text_or_array

SCHEMAS = {
    "papers": """id bigint, pmid string, title string, abstract string,
        authors array<string>, journal string, pub_date date, mesh_terms array<string>,
        keywords array<string>, doi string, paper_type string, study_type string,
        pub_types array<string>, topic_tags array<string>, fetched_at timestamp,
        summary_ko string, structured_data struct<study_design: string,
        sample_size: string, key_finding: string, population: string>,
        clinical_relevance int, qa_data array<struct<q: string, a: string>>""",
    "profiles": """id string, name string, institution string, keywords array<string>,
        mesh_terms array<string>, preferred_journals array<string>,
        preferred_study_types array<string>, email_digest boolean,
        digest_address string, digest_frequency string, onboarding_done boolean,
        created_at timestamp""",
    "feedbacks": "user_id string, paper_id bigint, action string, created_at timestamp",
    "read_history": """id bigint, user_id string, paper_id bigint, dwell_seconds int,
        scroll_depth float, source string, clicked_at timestamp""",
    "recommendations": """user_id string, paper_id bigint, score double,
        reasons struct<reasons: array<struct<type: string, label: string>>,
        matched_terms: array<string>>, is_read boolean, rec_date date""",
    "collections": """id string, user_id string, name string, description string,
        color string, created_at timestamp""",
    "collection_papers": "collection_id string, paper_id bigint, added_at timestamp",
    "alerts": """id bigint, user_id string, alert_type string, value string,
        is_active boolean, last_triggered timestamp, created_at timestamp""",
}


#: Tables that are changed row by row: dealt by a hash of the key to so many folders, so that a
#: change writes only the folders that hold changed rows.
DEALT = {"papers": ("id", 64)}
PART = "_part"


def read_table(spark: SparkSession, root: str, name: str, columns=None) -> DataFrame:
    """A stored table, only the columns asked for. `rec_date` is a partition column."""
    table = spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
    return table.select(*columns) if columns else table.drop(PART)


def one_row(table: DataFrame, key: str, value) -> DataFrame:
    """Point lookup. Two rows are let through so that a duplicate key shows."""
    return table.where(F.col(key) == value).limit(2)


def newest_page(table: DataFrame, by: str, rows: int, page: int = 0) -> DataFrame:
    """A page of the table, newest first; ties by id."""
    ordered = table.orderBy(F.desc_nulls_first(by), "id")
    return ordered.offset(rows * page).limit(rows) if page else ordered.limit(rows)


def normalised(table: DataFrame, *columns: str) -> DataFrame:
    """JSON text columns as arrays; columns that are arrays already stay."""
    types = dict(table.dtypes)
    for name in columns:
        if types[name] == "string":
            table = table.withColumn(name, text_or_array(F.col(name)))
    return table


def owned_by(table: DataFrame, user: Column | str, column: str = "user_id") -> DataFrame:
    """Rows of one user."""
    return table.where(F.col(column) == user)


def _as_stored(rows: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """The table's columns in order; columns the rows lack are NULL."""
    fields = spark.createDataFrame([], SCHEMAS[name]).schema.fields
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def _part_of(name: str, key=None) -> Column:
    column, parts = DEALT[name]
    return F.pmod(F.xxhash64(F.col(column) if key is None else key), F.lit(parts)).cast("int")


def append_rows(rows: DataFrame, root: str, name: str) -> None:
    out = _as_stored(rows, rows.sparkSession, name)
    if name in DEALT:
        out.withColumn(PART, _part_of(name)).write.mode("append").partitionBy(PART).parquet(
            f"{root}/{name}"
        )
    else:
        out.write.mode("append").parquet(f"{root}/{name}")


def replace_parts(rows: DataFrame, path: str, by: str) -> None:
    """Write `rows` in place of the folders (values of column `by`) that they fall into.

    Other folders stay. New files are moved in when the whole job has been written, so a failure
    before leaves the table as it was; `rows` may be made from the table itself.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        by
    ).parquet(path)


def patch_rows(changes: DataFrame, root: str, name: str, columns: list[str]) -> None:
    """Put the non-null fields of `changes` (one row per key) into a dealt table.

    Only folders that hold a changed key are read and written, once.
    """
    spark = changes.sparkSession
    key, _ = DEALT[name]
    touched = [r[0] for r in changes.select(_part_of(name)).distinct().collect()]
    stored = spark.read.schema(f"{SCHEMAS[name]}, {PART} int").parquet(f"{root}/{name}")
    held = stored.where(F.col(PART).isin(touched))
    replace_parts(patched(held, changes, key, columns), f"{root}/{name}", PART)


def patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`base` with the non-null fields of `patch` (one row per key) put in."""
    given = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = base.join(given, key, "left")
    return joined.select(
        *[
            F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )
