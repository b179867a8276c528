"""Constraint audit: storage constraints of the tables as one violations table.

The rules are data. Rules that look at one row are tested together in one pass over a table;
keys and references are counted per value first, and the values then meet their parents.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern.operators.maintain import REFERENCES
from lectern.sources import vocab

#: Columns that name a row in the report of rules on single rows.
ROW_KEY = {
    "papers": "id", "profiles": "id", "feedbacks": "paper_id", "read_history": "paper_id",
    "recommendations": "paper_id", "collections": "id", "collection_papers": "paper_id",
    "alerts": "id",
}
UNIQUE = {
    "papers": [["id"], ["pmid"]],
    "profiles": [["id"]],
    "feedbacks": [["user_id", "paper_id"]],
    "collections": [["id"]],
    "collection_papers": [["collection_id", "paper_id"]],
    "alerts": [["id"]],
}
NOT_NULL = {
    "papers": ["pmid", "title"],
    "recommendations": ["score", "rec_date"],
    "collections": ["name"],
    "alerts": ["value"],
}
DOMAIN = {
    "profiles": {"digest_frequency": vocab.DIGEST_FREQUENCIES},
    "feedbacks": {"action": vocab.FEEDBACK_ACTIONS},
    "alerts": {"alert_type": vocab.ALERT_TYPES},
}
RESULT = "table_name string, rule string, key string, n bigint"


def row_violations(df: DataFrame, table: str) -> DataFrame | None:
    """Rules on single rows, all in one pass; rules on columns that are not there are left out."""
    broken = [
        F.when(F.col(c).isNull(), F.lit(f"not_null({c})"))
        for c in NOT_NULL.get(table, [])
        if c in df.columns
    ]
    broken += [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(domain), F.lit(f"domain({c})"))
        for c, domain in DOMAIN.get(table, {}).items()
        if c in df.columns
    ]
    if not broken:
        return None
    rules = F.filter(F.array(*broken), lambda rule: rule.isNotNull())
    key = F.col(ROW_KEY[table]).cast("string")
    return df.select(
        F.lit(table).alias("table_name"), F.explode(rules).alias("rule"), key.alias("key"),
        F.lit(1).cast("bigint").alias("n"),
    )


def duplicates(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    counted = df.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rule = "unique(" + ",".join(columns) + ")"
    key = F.concat_ws("/", *columns).cast("string")
    return counted.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), key.alias("key"), "n"
    )


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame) -> DataFrame:
    """References without a parent, one row per missing parent.

    References are counted before they meet the parents, so a popular parent is one row.
    """
    wanted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    missing = wanted.join(parent.select(F.col("id").alias(column)), column, "left_anti")
    return missing.select(
        F.lit(table).alias("table_name"), F.lit(f"reference({column})").alias("rule"),
        F.col(column).cast("string").alias("key"), "n",
    )


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, key, n) of all violations in the tables given.

    References to tables that are not given are not tested. Missing values refer to nothing.
    """
    found = []
    for name, df in tables.items():
        found += [duplicates(df, name, columns) for columns in UNIQUE.get(name, [])]
        found += [
            orphans(df, name, column, tables[parent])
            for column, parent in REFERENCES[name].items()
            if parent in tables
        ]
        rows = row_violations(df, name)
        found += [] if rows is None else [rows]
    if not found:
        raise ValueError("no table to audit")
    return reduce(DataFrame.unionByName, found)
