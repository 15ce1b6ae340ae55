"""What is written: scans, audit rows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions.text import label_of, shortened

SCAN_COLUMNS = [
    "scan_id", "created_at", "user_id", "org_id", "filename", "risk_level", "risk_score",
    "prompt_injection_findings", "pii_findings", "ai_text_likelihood", "ai_text_score",
    "safe_copy_text", "summary", "match_analysis",
]


def scan_rows(scans: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Rows as stored: owner required, whole texts, the original text never kept.

    ``widths``: characters per column, for a store with fixed column widths.
    """
    stored = scans.filter(F.col("user_id").isNotNull()).withColumn(
        "ai_text_score", F.bround("ai_text_score", 3)
    )
    for column, width in (widths or {}).items():
        stored = stored.withColumn(column, shortened(F.col(column), width))
    return stored.select(*[c for c in SCAN_COLUMNS if c in stored.columns])


def write_scans(scans: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by risk level: dashboards read one level without the others."""
    scan_rows(scans).write.mode(mode).partitionBy("risk_level").parquet(path)


# Summary text per action
AUDIT_SUMMARY = {
    "candidate.created": ("candidate", "Candidate '%1$s' added (%2$s)."),
    "candidates.imported": ("candidate", "Imported %1$s candidate(s)."),
    "jobs.imported": ("job", "Imported %1$s job(s)."),
    "share.created": ("job", "Shortlist share link created for '%1$s'."),
    "outcome.recorded": ("candidate", "%1$s — %2$s on '%3$s'."),
}


def audit_rows(events: DataFrame, action: str, entity_id: Column, *parts: Column) -> DataFrame:
    entity, template = AUDIT_SUMMARY[action]
    return events.select(
        "user_id",
        "org_id",
        F.lit(action).alias("action"),
        F.lit(entity).alias("entity_type"),
        entity_id.cast("string").alias("entity_id"),
        F.format_string(template, *parts).alias("summary"),
        "created_at",
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def report_rows(scans: DataFrame) -> DataFrame:
    """One JSON report per document."""
    titled = F.transform(
        "pii_findings",
        lambda f: F.struct(
            F.initcap(F.replace(f["pii_type"], F.lit("_"), F.lit(" "))).alias("type"),
            f["matched_text"].alias("value"),
        ),
    )
    record = F.struct(
        F.col("filename").alias("file"),
        F.col("risk_level").alias("risk_level"),
        F.concat(F.col("risk_score").cast("string"), F.lit("/100")).alias("risk_score"),
        label_of(F.col("risk_level"), lx.RISK_VERDICTS).alias("verdict"),
        F.col("prompt_injection_findings").alias("hidden_instructions"),
        titled.alias("personal_data"),
        F.col("ai_text_likelihood").alias("ai_likelihood"),
        F.format_string("%.2f", F.col("ai_text_score")).alias("ai_score"),
    )
    return scans.select("scan_id", F.to_json(record).alias("report"))


def risk_text(level: Column, score: Column) -> Column:
    """``LEVEL (n/100)``, or a dash without a scan."""
    full = F.concat(level, F.lit(" ("), score.cast("string"), F.lit("/100)"))
    return F.coalesce(full, level, F.lit("—"))


def shortlist_report(jobs: DataFrame, cards: DataFrame) -> DataFrame:
    """Report lines per job, one row per shortlisted candidate; jobs without any keep one row.

    Lines stay as rows, so a very long shortlist never becomes one cell; writing them
    with ``partitionBy`` or sorted by job gives one document per job.
    """
    lines = cards.select(
        "job_id", "candidate_id", "full_name", "created_at",
        F.coalesce(F.nullif(F.col("headline"), F.lit("")), F.lit("—")).alias("headline"),
        F.initcap("status").alias("status"),
        risk_text(F.col("risk_level"), F.col("risk_score")).alias("risk"),
    )
    named = jobs.select("job_id", F.col("title").alias("job_title"), "client_name")
    # Lines lead: the rows of a hot job can then be split.
    listed = lines.join(named, "job_id").select(*named.columns, *[c for c in lines.columns if c != "job_id"])
    empty = named.join(lines.select("job_id").distinct(), "job_id", "left_anti")
    return listed.unionByName(empty, allowMissingColumns=True)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)
