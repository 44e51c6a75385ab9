"""The tables the analyses read: column contracts and a reader that applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyscan.sources.sinks import read_folder

_CONTENT = {"listing_id": "bigint", "title": "string", "description": "string", "state": "int"}

# Columns and types by table; a nested table is a struct. ``event_seq`` is any sortable value that tells
# apart log entries of one listing at one instant.
CONTRACTS = {
    "active_listings": {
        "listing_id": "bigint",
        "user_id": "bigint",
        "shop_id": "bigint",
        "title": "string",
        "description": "string",
        "taxonomy_id": "bigint",
        "top_category": "string",
        "past_year_gms": "double",
        "past_year_orders": "bigint",
        "how_its_made_label": "string",
        "price_usd": "double",
        "is_digital": "int",
        "print_on_demand": {"is_pod": "int"},
    },
    "listing_tags": {"listing_id": "bigint", "all_tags": "string"},
    "listing_taxonomy": {"listing_id": "bigint", "full_path": "string"},
    "flagged": {"listing_id": "bigint"},
    "reviews": {
        "reference_id": "bigint",
        "content_type": "string",
        "in_scope_policy": "string",
        "earliest_in_scope_date": "timestamp",
        "first_review_date": "date",
        "latest_review_date": "timestamp",
    },
    "change_log": {
        "event_ts": "timestamp",
        "event_seq": None,
        "before": _CONTENT,
        "after": _CONTENT,
    },
    "listings": {
        "listing_id": "bigint",
        "user_id": "bigint",
        "state": "int",
        "description": "string",
    },
    "listing_view": {"listing_id": "bigint", "is_active": "boolean"},
}


def _column(path: str, kind: str | dict | None) -> Column:
    if isinstance(kind, dict):
        # Field by field, so that the scan reads and filters the used ones only.
        return F.struct(*[_column(f"{path}.{name}", k).alias(name) for name, k in kind.items()])
    return F.col(path).cast(kind) if kind else F.col(path)


# Columns that a table may have besides. ``event_date`` is the day of ``event_ts``, by which a log
# may be partitioned; ``arrival_ts`` is when the log received an entry.
OPTIONAL = {"change_log": {"event_date": "date", "arrival_ts": "timestamp"}}


def conform(df: DataFrame, table: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """Select a table's columns with their types; ``renamed`` maps contract to source names.

    Optional columns are selected where the source has them.
    """
    source = renamed or {}
    more = {
        name: kind
        for name, kind in OPTIONAL.get(table, {}).items()
        if source.get(name, name) in df.columns
    }
    return df.select(
        *[
            _column(source.get(name, name), kind).alias(name)
            for name, kind in (CONTRACTS[table] | more).items()
        ]
    )


def read_table(
    spark: SparkSession, table: str, location: str, renamed: dict[str, str] | None = None
) -> DataFrame:
    """Read a table from a catalog name, or from a folder when ``location`` is a path: its
    published version if ``sinks`` wrote it, or else its Parquet files."""
    df = read_folder(spark, location) if "/" in location else spark.table(location)
    return conform(df, table, renamed)


def stream_table(
    spark: SparkSession, table: str, folder: str, renamed: dict[str, str] | None = None
) -> DataFrame:
    """Read a table as a stream of Parquet files arriving in a folder."""
    files = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return conform(files, table, renamed)
