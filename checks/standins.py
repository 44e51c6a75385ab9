"""Stand-in tables derived from the driver's Parquet, in Spark.

Listings come from ``part``, the change log from ``lineitem``, reviews from
``orders`` and long descriptions from ``documents``. Titles are picked from
``TEMPLATES`` by key arithmetic, so every row of the source tables takes part.
``checks.twins`` states the same definitions in SQL.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.templates import TEMPLATES
from policyscan.functions.text import computed_once
from policyscan.sources.tables import conform

LAUNCH = dt.date(1998, 7, 1)
EDITS_SINCE = dt.date(1995, 1, 1)
REACTIVATED_SINCE = dt.date(2001, 1, 1)
REACTIVATED_UNTIL = dt.date(2002, 1, 1)
POLICY = "target_policy"


def _template(number: Column, field: str) -> Column:
    values = json.dumps([getattr(t, field) for t in TEMPLATES])
    listed = F.from_json(F.lit(values), "array<string>")
    return F.element_at(listed, (number % len(TEMPLATES) + 1).cast("int"))


def _state(key: Column) -> Column:
    """Four of five listings are active (0); the others have the states 1 to 5."""
    turn = F.floor(key / 7) % 25
    return F.when(turn < 20, 0).otherwise(turn - 19).cast("int")


class StandIns:
    """The contract tables over one folder of driver Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._sources: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._sources[name]

    def described(self) -> DataFrame:
        """Parts with a long description: a document, then the template's own text."""
        documents = self.source("documents").select(
            F.col("doc_id").alias("document"), F.col("text")
        )
        key = F.col("p_partkey")
        own = _template(key, "description")
        count = documents.agg(F.count("*")).scalar()
        return (
            self.source("part")
            .withColumn("document", key % count)
            .join(documents, "document", "left")
            .withColumn("description", F.nullif(F.concat_ws(" ", "text", own), F.lit("")))
            .withColumn("state", _state(key))
        )

    def listings(self) -> DataFrame:
        df = self.described().withColumns(
            {"listing_id": F.col("p_partkey"), "user_id": F.col("p_partkey") % 100}
        )
        return conform(df, "listings")

    def active_listings(self) -> DataFrame:
        key = F.col("p_partkey")
        df = self.described().filter("state = 0")
        return conform(
            df.withColumns(
                {
                    "listing_id": key,
                    "user_id": key % 100,
                    "shop_id": key % 100 + 1000,
                    "title": _template(key, "title"),
                    "top_category": _template(key, "top_category"),
                    "taxonomy_id": F.col("p_size"),
                    "past_year_gms": F.col("p_retailprice"),
                    "past_year_orders": F.col("p_size"),
                    "how_its_made_label": F.col("p_type"),
                    "price_usd": F.col("p_retailprice") / 10,
                    "is_digital": F.when(key % 37 == 0, 1).when(key % 41 != 0, 0),
                    "print_on_demand": F.struct(
                        F.when(key % 43 == 0, 1).when(key % 47 != 0, 0).alias("is_pod")
                    ),
                }
            ),
            "active_listings",
        )

    def listing_tags(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.source("part").select(
            key.alias("listing_id"), F.when(key % 29 != 0, _template(key, "tags")).alias("all_tags")
        )

    def listing_taxonomy(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.source("part").select(
            key.alias("listing_id"),
            F.when(key % 31 != 0, _template(key, "full_path")).alias("full_path"),
        )

    def flagged(self) -> DataFrame:
        key = F.col("p_partkey")
        return (
            self.source("part")
            .filter((key % 3 == 0) & (key % 100 < 60))
            .select(key.alias("listing_id"))
        )

    def reviews(self) -> DataFrame:
        reviewed = F.col("o_orderdate")
        days = F.make_dt_interval(F.col("o_orderkey") % 400)
        df = self.source("orders").select(
            F.col("o_custkey").alias("reference_id"),
            F.when(F.col("o_orderstatus") == "P", "shop").otherwise("listing").alias("content_type"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), POLICY)
            .otherwise("other_policy")
            .alias("in_scope_policy"),
            reviewed.alias("earliest_in_scope_date"),
            F.to_date(reviewed).alias("first_review_date"),
            (reviewed + days).alias("latest_review_date"),
        )
        return conform(df, "reviews")

    def listing_view(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.source("part").select(
            key.alias("listing_id"), (_state(key) == 0).alias("is_active")
        )

    def change_log(self, items: DataFrame | None = None, long: bool = False) -> DataFrame:
        """The change log over ``lineitem``, or over a stream of it; ``long`` descriptions
        are whole documents."""
        part, line, supplier = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
        items = self.source("lineitem") if items is None else items
        own = F.lit("d")
        if long:
            documents = self.source("documents").select(F.col("doc_id").alias("document"), "text")
            count = documents.agg(F.count("*")).scalar()
            items = items.withColumn("document", F.col("l_orderkey") % count)
            items = items.join(documents, "document", "left")
            own = F.concat("text", F.lit(" d"))
        title = F.when(supplier % 50 != 7, _template(part + line, "title"))
        # A tenth of the listings is never edited; their entries change the state alone.
        quiet = part % 10 == 9
        changed_title = F.when(quiet | (F.col("l_returnflag") == "N"), title).otherwise(
            _template(part + supplier, "title")
        )
        line_after = line + F.when(~quiet & (F.col("l_linestatus") == "F"), 1).otherwise(0)

        def content(title: Column, number: Column, state: Column) -> Column:
            return F.struct(
                part.alias("listing_id"),
                title.alias("title"),
                F.concat(own, number.cast("string")).alias("description"),
                state.cast("int").alias("state"),
            )

        log = conform(
            items.select(
                F.col("l_shipdate").alias("event_ts"),
                F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("event_seq"),
                content(title, line, (line - 1) % 6).alias("before"),
                content(changed_title, line_after, supplier % 4).alias("after"),
            ),
            "change_log",
        )
        # A stored log holds these columns; do not rebuild them in every filter.
        return computed_once(
            log, ["event_ts", "event_seq"], before=F.col("before"), after=F.col("after")
        )

    def change_log_stream(self) -> DataFrame:
        """The change log as a stream of the files that hold ``lineitem``."""
        items = (
            self.spark.readStream.schema(self.source("lineitem").schema)
            .option("pathGlobFilter", "lineitem.parquet")
            .parquet(self.folder)
        )
        return self.change_log(items)
