"""Tables, import files and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.fence import fence
from sievework.sources.json_array import read_json_array

EVENT_OBJECT = (
    "struct<id:string,customer:string,subscription:string,client_reference_id:string,"
    "status:string,current_period_end:long,"
    "metadata:struct<scope:string,user_id:string,org_id:string>>"
)
EVENT_SCHEMA = f"id string, type string, created string, data struct<object:{EVENT_OBJECT}>"

# Explicit schemas of the recruiting store
SCHEMAS = {
    "candidates": "candidate_id long, user_id string, org_id string, scan_id long, "
    "full_name string, email string, phone string, headline string, location string, "
    "source string, status string, notes string, tags array<string>, created_at timestamp",
    "jobs": "job_id long, user_id string, org_id string, title string, client_name string, "
    "location string, description string, required_skills array<string>, status string, "
    "created_at timestamp",
    "pipeline_stages": "stage_id long, job_id long, user_id string, org_id string, name string, "
    "position int",
    "placements": "placement_id long, job_id long, candidate_id long, stage_id long, "
    "user_id string, org_id string, created_at timestamp",
    "shortlist_entries": "entry_id long, job_id long, candidate_id long, user_id string, "
    "org_id string, created_at timestamp",
    "outcomes": "outcome_id long, job_id long, candidate_id long, user_id string, "
    "org_id string, type string, occurred_at timestamp",
    "client_shares": "share_id long, job_id long, user_id string, org_id string, token string, "
    "expires_at timestamp",
    "notifications": "notification_id long, user_id string, org_id string, type string, "
    "title string, body string, candidate_id long, read int, created_at timestamp",
    "audit_log": "audit_id long, user_id string, org_id string, action string, "
    "entity_type string, entity_id string, summary string, created_at timestamp",
    "subscriptions": "user_id string, stripe_customer_id string, stripe_subscription_id string, "
    "plan string, status string, current_period_end timestamp, last_event_at timestamp",
    "org_subscriptions": "org_id string, stripe_customer_id string, "
    "stripe_subscription_id string, plan string, status string, "
    "current_period_end timestamp, last_event_at timestamp",
    "monthly_usage": "user_id string, period string, count int, assessments_used int",
    "webhook_events": "event_id string, event_type string, received_at timestamp",
}


def load_table(spark: SparkSession, root: str, name: str, jdbc: dict | None = None) -> DataFrame:
    """A table from Parquet under ``root``, or over JDBC when options are given."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{root}/{name}.parquet")


def read_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header lower-cased, cells trimmed, doubled quotes unescaped, missing cells empty."""
    raw = spark.read.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="PERMISSIVE",
        enforceSchema=False,
    )
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return named.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in named.columns]).na.fill("")


def read_import_json(
    spark: SparkSession, path: str, fields: list[str], array: bool = False
) -> DataFrame:
    """Rows of JSON lines, every field read as a string.

    ``array``: each file is one array of rows, cut into splits all the same (``json_array``).
    """
    if array:
        return read_json_array(spark, path, fields)
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(schema).json(path)


def unix_timestamp(value: Column) -> Column:
    """Seconds since 1970 to UTC; garbage becomes null."""
    return F.timestamp_seconds(value.try_cast("long"))


def parse_events(raw: DataFrame, column: str = "payload") -> DataFrame:
    """JSON events to columns; ``is_valid`` is false without an id or a type."""
    body = F.from_json(F.col(column), EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    parsed = (
        raw.withColumn("_e", body)
        .withColumns(
            {
                "event_id": F.nullif(F.col("_e.id"), F.lit("")),
                "event_type": F.nullif(F.col("_e.type"), F.lit("")),
                "created": unix_timestamp(F.col("_e.created")),
                "object": F.col("_e.data.object"),
            }
        )
        .withColumn("is_valid", F.col("event_id").isNotNull() & F.col("event_type").isNotNull())
        .drop("_e")
    )
    return fence(parsed, ["event_id", "event_type", "created", "object", "is_valid"])


def rejection(event_id: Column, event_type: Column, payload: Column) -> Column:
    """Why an event cannot be used; null where it can."""
    return (
        F.when(payload.isNull() | (F.trim(payload) == ""), "empty")
        .when(F.try_parse_json(payload).isNull(), "malformed")
        .when(event_id.isNull() & event_type.isNull(), "no id and type")
        .when(event_id.isNull(), "no id")
        .when(event_type.isNull(), "no type")
    )


def route_events(raw: DataFrame, path: str, column: str = "payload") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Usable events, rejected ones with their payload and ``reason``, and how many of each, in one pass.

    The parsed log is written once under ``path``, ``outcome`` by folder, and counted on the way.
    """
    parsed = parse_events(raw, column)
    reason = rejection(F.col("event_id"), F.col("event_type"), F.col(column))
    routed = parsed.withColumn("reason", reason).withColumn(
        "outcome", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )
    counted = Observation()
    reasons = ["empty", "malformed", "no id and type", "no id", "no type"]
    routed = routed.observe(
        counted,
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
    )
    routed.drop("is_valid").write.mode("overwrite").partitionBy("outcome").parquet(path)
    schema = routed.drop("is_valid", "outcome").schema
    back = raw.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("outcome", T.StringType())]))
    table = back.parquet(path)
    accepted = table.filter("outcome = 'accepted'").drop("outcome", "reason")
    rejected = table.filter("outcome = 'rejected'").select(*raw.columns, "reason")
    return accepted, rejected, counted.get
