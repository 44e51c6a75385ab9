"""Reactivations as they arrive in the change log.

A batch writes its files and then publishes a state that names them (``sources.commits``), so
readers see whole batches only, whatever a stopped or retried batch left behind.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from policyscan.operators.reactivations import reactivations
from policyscan.plans.reactivation import watched_events
from policyscan.sources import commits

#: What a run does: take what is there and stop. A dictionary of trigger arguments.
ONCE = {"availableNow": True}
#: Folders of one level that are put together into one of the next.
FOLDERS = 8
#: Days that a scan is given one by one.
LISTED_DAYS = 10
ENTRY = ["event_date", "listing_id", "event_ts", "event_seq"]


def _run(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What tells a stream from one that begins again with an empty checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def monitor_reactivations(
    changes: DataFrame,
    watched: DataFrame,
    since: dt.date,
    target: str,
    checkpoint: str,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Write every new risky reactivation of a watched listing.

    Rows are taken as they arrive, so a late log entry is reported late instead
    of being missed. The checkpoint remembers how far the last run came; with a new one the
    stream begins again, and its alerts take the place of the old ones. ``current_alerts``
    reads them. Pass ``watched`` as a stored table when a run has many batches: each joins
    it anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream, before = _stream_id(spark, checkpoint), commits.published(spark, target)
        if before and before["stream"] == stream and before["last"] >= batch_id:
            return  # stopped between this batch's publication and the checkpoint's
        batch.write.mode("overwrite").parquet(f"{target}/stream={stream}/batch_id={batch_id}")
        commits.publish(spark, target, {"stream": stream, "last": batch_id}, before)
        commits.tidy(spark, target)

    return _run(watched_events(reactivations(changes, since), watched), write, checkpoint, trigger)


def current_alerts(spark: SparkSession, target: str) -> DataFrame:
    """The alerts of all finished batches of ``monitor_reactivations``, with their batch."""
    state = commits.published(spark, target)
    if state is None:
        raise FileNotFoundError(f"no batch was finished in {target}")
    folder, last = f"{target}/stream={state['stream']}", state["last"]
    schema = spark.read.parquet(f"{folder}/batch_id={last}").schema.add("batch_id", LongType())
    return spark.read.schema(schema).parquet(folder).filter(F.col("batch_id") <= last)


def roll_up_reactivations(
    changes: DataFrame,
    since: dt.date,
    target: str,
    checkpoint: str,
    trigger: dict = ONCE,
    folders: int = FOLDERS,
) -> StreamingQuery:
    """Keep first reactivation, state before it and count per listing up to date.

    Every entry counts, however late it comes, and one that is delivered again does not count
    again: a batch is compared with the stored entries of its days. First dates and counts
    can be merged in any order, so nothing is kept in memory between batches.

    A batch adds one folder of entries and one of sums per listing. Their files follow the
    amount of data, whatever days it is of; entries are stored by day, so that the statistics
    of files and row groups lead to the days wanted. ``folders`` folders of one level are
    (two at least) are put together into one of the next, so their number grows with the
    logarithm of the batches. A batch that is repeated, by a retry or a lost checkpoint, finds its entries
    stored and adds nothing.
    """
    events = reactivations(changes, since).select(
        F.col("before.listing_id").alias("listing_id"),
        "event_ts",
        "event_seq",
        F.col("before.state").alias("state"),
        F.to_date("event_ts").alias("event_date"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = commits.published(spark, target)
        state = dict(before) if before else {"entries": [], "sums": [], "schemas": {}}
        # Written as it came first: the log is read once, and what follows reads a few columns.
        draft = _added(batch.dropDuplicates(ENTRY), target)
        came = spark.read.schema(batch.schema).parquet(f"{target}/{draft}")
        fresh = _unknown(came, _stored(spark, target, state, "entries"))
        # The range of days that a file holds is as narrow as the data allow.
        state["schemas"] = {"entries": fresh.schema.json(), "sums": _sums(fresh).schema.json()}
        state["entries"] = [*state["entries"], [0, _added(_by_day(fresh), target)]]
        added = _stored(spark, target, state | {"entries": state["entries"][-1:]}, "entries")
        state["sums"] = [*state["sums"], [0, _added(_sums(added).hint("rebalance"), target)]]
        _merge(spark, target, state, "entries", folders, _by_day)
        _merge(spark, target, state, "sums", folders, lambda df: _merged(df).hint("rebalance"))
        commits.publish(spark, target, state, before)
        commits.tidy(spark, target)

    return _run(events, write, checkpoint, trigger)


def _by_day(entries: DataFrame) -> DataFrame:
    return entries.repartitionByRange(*ENTRY[:3]).sortWithinPartitions(*ENTRY[:3])


def _added(df: DataFrame, target: str) -> str:
    """Write rows into a folder of their own; its name."""
    folder = commits.fresh()
    df.write.parquet(f"{target}/{folder}")
    return folder


def _stored(spark: SparkSession, target: str, state: dict, kind: str) -> DataFrame | None:
    paths = [f"{target}/{folder}" for _, folder in state[kind]]
    if not paths:
        return None
    schema = StructType.fromJson(json.loads(state["schemas"][kind]))
    return spark.read.schema(schema).parquet(*paths)


def _unknown(fresh: DataFrame, held: DataFrame | None) -> DataFrame:
    """The entries that are not among those held; of these, only days of the batch are read."""
    if held is None:
        return fresh
    # At most the days of the calendar. A scan looks single days up in its statistics up to
    # some number, and beyond it the range.
    days = sorted(d for d in fresh.agg(F.collect_set("event_date")).first()[0] if d)
    day, keys = F.col("event_date"), fresh.select(*ENTRY)
    wanted = day.isin(days) if len(days) <= LISTED_DAYS else day.between(days[0], days[-1])
    held = held.filter(wanted).select(*ENTRY)
    # The batch is mostly the smaller side, which Spark can send to all tasks; what it meets
    # among the stored entries are those delivered again.
    again = held.join(keys, [held[n].eqNullSafe(keys[n]) for n in ENTRY], "left_semi")
    return fresh.join(again, [fresh[n].eqNullSafe(again[n]) for n in ENTRY], "left_anti")


def _sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("listing_id").agg(
        F.min(F.struct("event_ts", "event_seq", "state")).alias("first"),
        F.count("*").alias("reactivation_count"),
    )


def _merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy("listing_id").agg(
        F.min("first").alias("first"), F.sum("reactivation_count").alias("reactivation_count")
    )


def _merge(
    spark: SparkSession,
    target: str,
    state: dict,
    kind: str,
    folders: int,
    together: Callable[[DataFrame], DataFrame],
) -> None:
    """Replace full levels of a list of ``state``, pairs of level and folder, by a folder of the next."""
    level = 0
    while len(full := [pair for pair in state[kind] if pair[0] == level]) >= folders:
        whole = together(_stored(spark, target, state | {kind: full}, kind))
        others = [pair for pair in state[kind] if pair[0] != level]
        state[kind] = [*others, [level + 1, _added(whole, target)]]
        level += 1


def current_rollup(spark: SparkSession, target: str) -> DataFrame:
    """One row per listing from the finished batches of ``roll_up_reactivations``."""
    state = commits.published(spark, target)
    if state is None:
        raise FileNotFoundError(f"no batch was finished in {target}")
    return _merged(_stored(spark, target, state, "sums")).select(
        "listing_id",
        F.to_date("first.event_ts").alias("reactivated_date"),
        F.col("first.state").alias("state_before"),
        "reactivation_count",
    )
