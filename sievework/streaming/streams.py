"""Event logs as streams.

Every sink is safe to repeat: file sinks use Spark's commit log, and foreachBatch
sinks write one folder per batch id and overwrite it when a batch is replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.operators import billing, detect, profile, redact
from sievework.session import materialise, work_dir
from sievework.sources.buckets import BucketTable


# ------------------------------------------------------------------ sources, sinks


def read_table_stream(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain_to_files(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Append mode: run over everything available and return what was written."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_changes(
    stream: DataFrame, path: str, keys: list[str], checkpoint: str | None = None,
    progress: Callable[[dict], None] | None = None,
) -> DataFrame:
    """Update mode: each batch's changed rows go to their own folder; returns the last per key.

    ``progress`` is called with the figures of each of the latest batches.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint or work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    for figures in query.recentProgress if progress else []:
        progress(figures)
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in log.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*")


# ------------------------------------------------------------------------- streams


def dedupe_events(events: DataFrame, delay: str = "7 days", ts: str = "ts") -> DataFrame:
    """Each event id once while the watermark remembers it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def usage_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running counts per user and day: ``user_id, day, count, assessments_used``.

    Days are event-time windows, so the state of a day goes when the watermark has passed its end: state is that
    of the days still open, not of all months.  Events later than ``delay`` are not counted; the stream's
    progress reports how many they were.  ``months`` folds the days.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.window("ts", "1 day"))
        .agg(
            F.count_if(F.col("kind") == "scan").alias("count"),
            F.count_if(F.col("kind") == "assessment").alias("assessments_used"),
        )
        .select("user_id", F.to_date("window.start").alias("day"), "count", "assessments_used")
    )


def months(days: DataFrame) -> DataFrame:
    """Daily usage folded into ``user_id, period, count, assessments_used``."""
    return days.groupBy("user_id", F.date_format("day", "yyyy-MM").alias("period")).agg(
        F.sum("count").alias("count"), F.sum("assessments_used").alias("assessments_used")
    )


def scan_stream(docs: DataFrame) -> DataFrame:
    """The whole screening as a stateless projection over arriving documents."""
    found = redact.add_safe_copy(detect.detect(detect.normalise(docs)))
    return profile.analyse_corpus(found.drop(*detect.WORK_COLUMNS))


def high_risk_alerts(new_candidates: DataFrame, scans: DataFrame) -> DataFrame:
    """A notification per arriving candidate whose scan is RED (stream-static join)."""
    red = scans.filter(F.col("risk_level") == "RED").select("scan_id")
    return new_candidates.join(red, "scan_id").select(
        "user_id",
        "org_id",
        F.lit("high_risk").alias("type"),
        F.concat(F.lit("High-risk CV: "), F.col("full_name")).alias("title"),
        F.lit(lx.ALERT_BODY).alias("body"),
        "candidate_id",
        F.lit(0).alias("read"),
        "created_at",
    )


def funnel_stream(outcomes: DataFrame, *keys: str) -> DataFrame:
    """The outcome funnel kept up to date per key."""
    counts = outcomes.groupBy(*keys).agg(
        *[F.count_if(F.col("type") == t).alias(t) for t in lx.OUTCOME_TYPES]
    )
    return counts.withColumns(
        {
            "total": sum((F.col(t) for t in lx.OUTCOME_TYPES), F.lit(0)),
            "success": sum((F.col(t) for t in lx.PLACED_TYPES), F.lit(0)),
        }
    )


# ------------------------------------------------------------ subscription state


def _as_history(state: DataFrame) -> DataFrame:
    """A stored state row as a row that precedes all events, in order of creation."""
    return state.select(
        F.lit(None).cast("string").alias("event_id"),
        F.lit(billing.STORED).alias("event_type"),
        F.col("last_event_at").alias("created"),
        (F.col("since") - F.lit(billing.EARLIER)).alias("arrival_no"),
        "scope",
        "owner",
        "customer",
        "subscription_id",
        "status",
        F.col("current_period_end").alias("period_end"),
        "from_checkout",
    )


def subscription_merge(state: DataFrame | None, rows: DataFrame) -> DataFrame:
    """One step: stored state and a batch of billing rows to the new state."""
    events = rows.withColumn("from_checkout", F.lit(False))
    history = events if state is None else _as_history(state).unionByName(events)
    return billing.subscription_state(billing.replay(history))


def first_arrivals(rows: DataFrame) -> DataFrame:
    """Each event id once: its first arrival, whatever batch the others come in (update mode).

    A native aggregate holds one row per id in the state store, and a batch touches that of its own ids only: an id
    whose earliest and latest sighting, by the clock of the batch, are one has not been there before.  Ids are
    never forgotten; ``dedupe_events`` is the form with a watermark.
    """
    rows.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    seen = rows.withColumn("_seen", F.current_timestamp()).groupBy("event_id").agg(
        F.min_by(F.struct(*rows.columns), "arrival_no").alias("_row"),
        F.min("_seen").alias("_from"),
        F.max("_seen").alias("_to"),
    )
    return seen.filter("_from = _to").select("_row.*")


STATE = (
    "scope string, owner string, customer string, subscription_id string, status string, "
    "current_period_end timestamp, last_event_at timestamp, from_checkout boolean, since long"
)


def _tables(spark: SparkSession, path: str, buckets: int, before: int | None = None) -> tuple[BucketTable, BucketTable]:
    """The accounts by owner, and which owners hold a customer."""
    accounts = BucketTable(spark, f"{path}/accounts", STATE, ["scope", "owner"], None, buckets, before)
    holders = BucketTable(
        spark, f"{path}/holders", "scope string, customer string, owner string",
        ["scope", "customer", "owner"], ["scope", "customer"], buckets, before,
    )
    return accounts, holders


def merge_subscriptions(
    spark: SparkSession, path: str, batch: DataFrame, version: int, buckets: int = 64
) -> dict[str, list[int]]:
    """Fold a batch of billing rows into the tables under ``path``; returns the buckets written.

    A batch can change the accounts it names and those that hold one of its customers, and nothing it decides
    depends on others: an account that leaves a customer matters only to events on that customer.  So only
    their buckets are read and written.
    """
    accounts, holders = _tables(spark, path, buckets, before=version)
    accounts.vacuum()
    holders.vacuum()
    named = batch.filter("owner is not null").select("scope", "owner")
    customers = batch.filter("customer is not null").select("scope", "customer")
    touched = materialise(named.unionByName(holders.lookup(customers).select("scope", "owner")).distinct(), "subscriptions")
    state = materialise(accounts.lookup(touched), "subscriptions")
    new = materialise(subscription_merge(state, batch), "subscriptions")
    held = lambda t: t.select("scope", "customer", "owner")
    moved = held(new).exceptAll(held(state)), held(state).exceptAll(held(new))
    return {"accounts": accounts.merge(version, new), "holders": holders.merge(version, *moved)}


def run_subscription_stream(
    rows: DataFrame, path: str, checkpoint: str | None = None, buckets: int = 64
) -> DataFrame:
    """Fold arriving events into the subscription tables under ``path`` and return the accounts.

    ``rows`` are billing rows of any event type (``billing.billing_fields``): ids count for all of them, accounts
    change by some.  A batch reads and writes the buckets of its own keys; version n depends on the versions
    before n and batch n only, so a repeated batch writes the same again, and a restart without
    new data returns what was committed last.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        # Written once: every further use of the batch would run the stream's query again.
        new = materialise(billing.only_billing(batch), "arrivals")
        merge_subscriptions(spark, path, new, batch_id, buckets)

    query = (
        first_arrivals(rows)
        .writeStream.foreachBatch(merge)
        .outputMode("update")
        .option("checkpointLocation", checkpoint or work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _tables(spark, path, buckets)[0].read()
