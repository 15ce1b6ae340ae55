"""Recruiting tables: joins, scope, status changes, boards, dashboards, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import text as tx
from sievework.operators.detect import first_pii
from sievework.operators.profile import headline
from sievework.operators.scope import CELL, summed_for, top_for
from sievework.operators.skew import evenly, first_per_key, flag_members, in_blocks
from sievework.session import materialise
from sievework.sources.buckets import BucketTable

# ------------------------------------------------------------- filters and lookups


def tenant_scope(df: DataFrame, user: str, org: str | None = None) -> DataFrame:
    own = F.col("user_id") == user
    return df.filter(own | (F.col("org_id") == org)) if org else df.filter(own)


def by_status(df: DataFrame, status: str) -> DataFrame:
    return df.filter(F.col("status") == status)


def name_search(df: DataFrame, q: str, column: str = "full_name") -> DataFrame:
    """Case-insensitive; ``%`` and ``_`` in the query act as wildcards."""
    return df.filter(F.col(column).ilike(f"%{q}%"))


def since_month_start(df: DataFrame, as_of: Column, ts: str = "created_at") -> DataFrame:
    return df.filter(F.col(ts) >= F.date_trunc("month", as_of))


def unexpired_shares(shares: DataFrame, as_of: Column) -> DataFrame:
    return shares.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed in ``wanted``."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def scan_history(scans: DataFrame) -> DataFrame:
    return scans.select("scan_id", "created_at", "filename", "risk_level", "risk_score")


def scan_detail(scans: DataFrame) -> DataFrame:
    """Full rows; the stored safe copy stands in for the original, which is never kept."""
    return scans.withColumn("original_text", F.col("safe_copy_text"))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.filter(F.col("read") == 0)


def mark_read(
    notifications: DataFrame, ids: DataFrame | None = None, user: str | None = None, org: str | None = None
) -> DataFrame:
    """Listed notifications are read; without a list, all that the principal may see."""
    if ids is None:
        mine = F.coalesce(F.col("user_id") == user, F.lit(False))
        if org:
            mine = mine | F.coalesce(F.col("org_id") == org, F.lit(False))
        return notifications.withColumn("read", F.when(mine, 1).otherwise(F.col("read")))
    flagged = flag_members(
        notifications, ids.select("notification_id").distinct(), "notification_id", "_now"
    )
    return flagged.withColumn("read", F.when(F.col("_now"), 1).otherwise(F.col("read"))).drop("_now")


def validate_enum(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Add ``is_valid``; the caller keeps or quarantines."""
    return df.withColumn("is_valid", F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def merge_changes(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Apply partial updates.

    ``changes``: ``key, change_no, fields map<string,string>``.  A field that is
    absent keeps its value; one that is present wins even when null.  The last
    change of each field counts.
    """
    fields = [c for c in table.columns if c != key]
    long = changes.select(key, "change_no", F.explode("fields").alias("field", "value"))
    last = (
        long.groupBy(key, "field")
        .agg(F.max_by(F.struct("value"), "change_no").alias("v"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("_set"))
    )
    types = dict(table.dtypes)
    merged = table.join(last, key, "left")
    return merged.select(
        key,
        *[
            F.when(
                F.coalesce(F.map_contains_key("_set", f), F.lit(False)),
                F.try_element_at("_set", F.lit(f))["value"].cast(types[f]),
            )
            .otherwise(F.col(f))
            .alias(f)
            for f in fields
        ],
    )


def merge_stored(table: BucketTable, version: int, changes: DataFrame, key: str) -> list[int]:
    """``merge_changes`` on a stored table: only the buckets of changed keys are read and written.
    A repeated ``version`` changes nothing further.  Returns the buckets written."""
    return table.merge(version, materialise(merge_changes(table.lookup(changes), changes, key), "merged"))


def mark_read_stored(table: BucketTable, version: int, ids: DataFrame) -> list[int]:
    """``mark_read`` on a stored table, for listed notifications."""
    listed = ids.select("notification_id").distinct()
    return table.merge(version, materialise(mark_read(table.lookup(listed), listed), "marked"))


# --------------------------------------------------------------------------- joins


def candidates_with_risk(candidates: DataFrame, scans: DataFrame) -> DataFrame:
    return candidates.join(scans.select("scan_id", "risk_level", "risk_score"), "scan_id", "left")


def shortlist_cards(shortlist: DataFrame, candidates: DataFrame, scans: DataFrame) -> DataFrame:
    people = candidates_with_risk(candidates, scans).select(
        "candidate_id", "full_name", "headline", "status", "risk_level", "risk_score"
    )
    return shortlist.select("entry_id", "job_id", "candidate_id", "created_at").join(
        people, "candidate_id"
    )


def pipeline_board(
    stages: DataFrame, placements: DataFrame, candidates: DataFrame, scans: DataFrame
) -> DataFrame:
    """One row per (stage, card); empty stages keep one row without a card.

    ``stages`` holds every job that has cards; ``seed_stages`` gives the others the default ones.
    A placement without a stage of its own job falls into the job's first stage.
    Cards stay as rows: a stage with very many candidates never becomes one cell.
    """
    firsts = stages.groupBy("job_id").agg(
        F.min_by("stage_id", F.struct("position", "stage_id")).alias("_first")
    )
    own = stages.select("stage_id", "job_id").withColumn("_own", F.lit(True))
    people = candidates_with_risk(candidates, scans).select(
        "candidate_id", "full_name", "headline", "status", "risk_level", "risk_score"
    )
    cards = (
        placements.select("placement_id", "job_id", "candidate_id", "stage_id")
        .join(own, ["stage_id", "job_id"], "left")
        .join(firsts, "job_id")
        .withColumn("stage_id", F.when(F.col("_own"), F.col("stage_id")).otherwise(F.col("_first")))
        .drop("_own", "_first", "job_id")
        .join(people, "candidate_id")
    )
    # The cards are the large side and stay on the left, where a hot stage can be split.
    columns = stages.select("stage_id", "job_id", "name", "position")
    filled = cards.join(columns, "stage_id")
    empty = columns.join(cards.select("stage_id").distinct(), "stage_id", "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def high_risk_candidates(candidates: DataFrame, scans: DataFrame) -> DataFrame:
    red = scans.filter(F.col("risk_level") == "RED").select("scan_id", "risk_level", "risk_score")
    return candidates.join(red, "scan_id")


def open_jobs_without_candidates(jobs: DataFrame, placements: DataFrame) -> DataFrame:
    placed = placements.select("job_id").distinct()
    return by_status(jobs, "open").join(placed, "job_id", "left_anti")


def available_candidates(
    wanted: DataFrame, taken: DataFrame, people: DataFrame | None = None, by: str = "slot"
) -> DataFrame:
    """(job, candidate) pairs not yet on the board or shortlist.

    ``wanted`` lists the pairs; or, with ``people`` (``candidate_id, by``), it holds ``job_id, by``, and every job
    is wanted for all people of its ``by``.  Such pairs are formed last and never shuffled: jobs and people
    meet in blocks, with the taken pairs of both blocks beside them.
    """
    if people is None:
        return wanted.join(
            taken.select("job_id", "candidate_id").distinct(), ["job_id", "candidate_id"], "left_anti"
        )
    wanted, people = wanted.filter(F.col(by).isNotNull()), people.filter(F.col(by).isNotNull())

    def blocks(df: DataFrame, key: str, rows: str, block: str) -> DataFrame:
        found = in_blocks(df, [by], F.struct(key), key, rows).withColumnRenamed("_block", block)
        return found.withColumn(rows, F.col(rows)[key])

    jobs = blocks(wanted, "job_id", "_jobs", "_jb")
    seen = blocks(people, "candidate_id", "_people", "_cb")
    told = lambda df, rows, block, key: df.select(by, block, F.explode(rows).alias(key)).distinct()
    gone = (
        taken.select("job_id", "candidate_id").distinct()
        .join(told(jobs, "_jobs", "_jb", "job_id"), "job_id")
        .join(told(seen, "_people", "_cb", "candidate_id"), ["candidate_id", by])
        .groupBy(by, "_jb", "_cb")
        .agg(F.collect_list(F.struct("job_id", "candidate_id")).alias("_taken"))
    )
    cells = jobs.select(by, "_jb").join(seen.select(by, "_cb"), by).join(gone, [by, "_jb", "_cb"], "left")
    cells = evenly(cells.join(jobs, [by, "_jb"]).join(seen, [by, "_cb"]), by, "_jb", "_cb")
    mine = F.filter(F.col("_taken"), lambda t: t["job_id"] == F.col("job_id"))
    each = cells.select("_people", "_taken", F.explode("_jobs").alias("job_id")).select(
        "job_id", "_people", F.transform(mine, lambda t: t["candidate_id"]).alias("_gone")
    )
    return each.select("job_id", "_gone", F.explode("_people").alias("candidate_id")).filter(
        ~F.coalesce(F.array_contains("_gone", F.col("candidate_id")), F.lit(False))
    ).select("job_id", "candidate_id")


def promote_scans(requests: DataFrame, scans: DataFrame) -> DataFrame:
    """Candidate rows from promotion requests.

    Fields given by the caller win; the rest comes from the scan.  A request for a
    scan outside the caller's scope, or without any name, is marked not accepted.
    """
    src = scans.select(
        "scan_id", F.col("user_id").alias("s_user"), F.col("org_id").alias("s_org"), "filename",
        "pii_findings", "match_analysis", F.lit(True).alias("_found"),
    )
    joined = requests.join(src, "scan_id", "left").withColumn(
        "_found",
        F.coalesce(F.col("_found"), F.lit(False))
        & F.coalesce(
            (F.col("s_user") == F.col("user_id")) | (F.col("s_org") == F.col("org_id")),
            F.lit(False),
        ),
    )

    def filled(column: str, fallback: Column) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.when(F.col("_found"), fallback))

    match = F.col("match_analysis")
    return joined.select(
        "request_id", "user_id", "org_id", "scan_id",
        filled("full_name", tx.filename_stem(F.col("filename"))).alias("full_name"),
        filled("email", first_pii(F.col("pii_findings"), "email")).alias("email"),
        filled("phone", first_pii(F.col("pii_findings"), "phone")).alias("phone"),
        filled("headline", headline(match["experience_tier"], match["years_experience"])).alias(
            "headline"
        ),
        F.when(F.col("scan_id").isNotNull(), "scan").otherwise("manual").alias("source"),
        F.when(F.col("scan_id").isNotNull() & ~F.col("_found"), "scan_not_found")
        .when(
            F.col("scan_id").isNull() & F.nullif(F.col("full_name"), F.lit("")).isNull(),
            "name_required",
        )
        .otherwise("created")
        .alias("disposition"),
    )


def public_share_view(
    shares: DataFrame,
    jobs: DataFrame,
    shortlist: DataFrame,
    candidates: DataFrame,
    scans: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Shortlists behind live tokens; contact columns are never selected."""
    live = unexpired_shares(shares, as_of).select("token", "job_id")
    titles = jobs.select("job_id", F.col("title").alias("job_title"), "client_name")
    cards = shortlist_cards(shortlist, candidates, scans)
    return (
        live.join(titles, "job_id")
        .join(cards, "job_id")
        .select(
            "token", "job_title", "client_name", "full_name", "headline", "status", "risk_level",
            "risk_score", "created_at",
        )
    )


def assessments_with_scan(assessments: DataFrame, scans: DataFrame) -> DataFrame:
    """An assessment belongs to the organisation of its scan."""
    return assessments.drop("org_id").join(scans.select("scan_id", "org_id"), "scan_id")


def cascade_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """ON DELETE CASCADE: child rows whose parent is gone are dropped."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return child.join(keys, fk, "left_semi")


def null_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """ON DELETE SET NULL: the key of a missing parent becomes null."""
    keys = parent.select(F.col(pk).alias(fk)).distinct().withColumn("_there", F.lit(True))
    return (
        child.join(keys, fk, "left")
        .withColumn(fk, F.when(F.col("_there"), F.col(fk)))
        .drop("_there")
    )


def validate_moves(moves: DataFrame, placements: DataFrame, stages: DataFrame) -> DataFrame:
    """A placement may move only to a stage of its own job; adds ``is_valid``."""
    targets = stages.select(
        F.col("stage_id").alias("to_stage_id"), F.col("job_id"), F.lit(True).alias("is_valid")
    )
    return (
        moves.join(placements.select("placement_id", "job_id"), "placement_id")
        .join(targets, ["to_stage_id", "job_id"], "left")
        .withColumn("is_valid", F.coalesce("is_valid", F.lit(False)))
    )


# ---------------------------------------------------------------------- aggregates


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def zero_filled(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """One count column per value; values outside the list are ignored."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in values]
    )


def risk_breakdown(scans: DataFrame, *keys: str) -> DataFrame:
    return zero_filled(scans, list(keys), "risk_level", ["GREEN", "ORANGE", "RED"])


def dashboard_metrics(
    candidates: DataFrame,
    jobs: DataFrame,
    scans: DataFrame,
    placements: DataFrame,
    shortlist: DataFrame,
    statuses: list[str],
    principals: DataFrame,
) -> DataFrame:
    """One row per principal: totals and breakdowns of all rows it may see, zero where there are none.

    Each table is aggregated once per (user, organisation); principals sum these cells.
    """

    tables = {
        "candidates": candidates, "jobs": jobs, "scans": scans, "placements": placements, "shortlist": shortlist,
    }
    parts = [dashboard_cells(rows, name, statuses) for name, rows in tables.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    measures = [c for c in every.columns if c not in CELL]
    return dashboard_of(every.na.fill(0, measures), principals)


def dashboard_cells(rows: DataFrame, name: str, statuses: list[str]) -> DataFrame:
    """What one table of the store adds to the dashboard, per (user, organisation)."""
    prefix, column, values = {
        "candidates": ("candidates", "status", statuses),
        "jobs": ("jobs", "status", lx.JOB_STATUSES),
        "scans": ("risk", "risk_level", ["GREEN", "ORANGE", "RED"]),
    }.get(name, (name, None, []))
    counts = rows.groupBy(*CELL).agg(
        *[F.count_if(F.col(column) == v).alias(f"{prefix}_{v}") for v in values],
        F.count(F.lit(1)).alias(f"{prefix}_total"),
    )
    return counts.drop("risk_total")


def dashboard_of(cells: DataFrame, principals: DataFrame) -> DataFrame:
    """The dashboard from its cells, counted afresh or kept up to date (``deltas.Cells``)."""
    return summed_for(cells, principals).withColumn("open_jobs", F.col("jobs_open"))


def outcome_funnel(outcomes: DataFrame, keys: list[str], every: DataFrame | None = None):
    """Zero-filled counts over the six types, with ``total`` and ``success`` (hired or placed).

    ``every``: rows that must appear even without an outcome (for example all jobs).
    """
    counts = zero_filled(outcomes, keys, "type", lx.OUTCOME_TYPES)
    if every is not None:
        counts = every.select(*keys).distinct().join(counts, keys, "left").na.fill(0)
    return counts.withColumns(_funnel_sums())


def _funnel_sums() -> dict[str, Column]:
    return {
        "total": sum((F.col(t) for t in lx.OUTCOME_TYPES), F.lit(0)),
        "success": sum((F.col(t) for t in lx.PLACED_TYPES), F.lit(0)),
    }


def tenant_funnel(outcomes: DataFrame, principals: DataFrame) -> DataFrame:
    """The funnel of all outcomes a principal may see."""
    out = summed_for(zero_filled(outcomes, CELL, "type", lx.OUTCOME_TYPES), principals)
    return out.withColumns(_funnel_sums())


def unread_count(notifications: DataFrame, principals: DataFrame) -> DataFrame:
    """True number of unread notifications per principal, zero included."""
    cells = unread(notifications).groupBy(*CELL).agg(F.count(F.lit(1)).alias("unread_count"))
    return summed_for(cells, principals)


def today_queue(
    candidates: DataFrame,
    scans: DataFrame,
    jobs: DataFrame,
    placements: DataFrame,
    principals: DataFrame,
    k: int = 10,
) -> DataFrame:
    """Per principal: new candidates, high-risk candidates, open jobs without anyone.

    Long form, one row per listed item, with its list's true count; an empty list keeps one row
    without an item and with count 0.
    """

    def listed(df: DataFrame, name: str, item: str, label: str) -> DataFrame:
        return df.select(
            *CELL, F.lit(name).alias("queue"), F.col(item).alias("item_id"),
            F.col(label).alias("label"), "created_at",
        )

    rows = (
        listed(by_status(candidates, "new"), "new_candidates", "candidate_id", "full_name")
        .unionByName(
            listed(
                high_risk_candidates(candidates, scans), "high_risk", "candidate_id", "full_name"
            )
        )
        .unionByName(
            listed(open_jobs_without_candidates(jobs, placements), "open_jobs", "job_id", "title")
        )
    )
    queues = F.array(*[F.lit(q) for q in ("new_candidates", "high_risk", "open_jobs")])
    every = principals.select("p_user", "p_org", F.explode(queues).alias("queue"))
    cells = rows.groupBy(*CELL, "queue").agg(F.count(F.lit(1)).alias("queue_count"))
    counts = summed_for(cells, every, ["queue"])
    top = top_for(rows, principals, [F.desc("created_at"), F.asc("item_id")], k, ["queue"]).select(
        F.col("p_user").alias("_u"), F.col("p_org").alias("_o"), F.col("queue").alias("_q"),
        "item_id", "label", "rank",
    )
    on = (
        (F.col("p_user") == F.col("_u"))
        & F.col("p_org").eqNullSafe(F.col("_o"))
        & (F.col("queue") == F.col("_q"))
    )
    return counts.join(top, on, "left").drop("_u", "_o", "_q")


def corpus_findings_summary(scans: DataFrame) -> DataFrame:
    """Findings and documents per pattern or personal-data type.

    Each document is first reduced to (type, count) rows, so the aggregate needs
    neither a distinct count nor one row per finding.
    """
    kinds = F.concat(
        F.transform("prompt_injection_findings", lambda f: f["pattern_id"]),
        F.transform("pii_findings", lambda f: f["pii_type"]),
    )
    per_doc = scans.select(kinds.alias("_kinds")).select(
        F.explode(
            F.transform(
                F.array_distinct("_kinds"),
                lambda k: F.struct(
                    k.alias("finding"),
                    F.size(F.filter("_kinds", lambda x: x == k)).alias("n"),
                ),
            )
        ).alias("f")
    )
    return per_doc.groupBy(F.col("f.finding").alias("finding")).agg(
        F.sum("f.n").alias("findings"), F.count(F.lit(1)).alias("documents")
    )


def quota_percent(used: Column, limit: Column) -> Column:
    share = F.floor(100 * used / limit + F.lit(0.5))
    return F.when(limit > 0, F.least(F.lit(100), share)).otherwise(0).cast("int")


# ---------------------------------------------------------------- pages and stages


def newest_first(df: DataFrame, key: str, ts: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(ts), key)


def notification_page(notifications: DataFrame, principals: DataFrame, size: int = 50) -> DataFrame:
    """First page of each principal: unread first, then newest."""
    order = [F.asc("read"), F.desc("created_at"), F.asc("notification_id")]
    return top_for(notifications, principals, order, size)


def audit_page(audit: DataFrame, principals: DataFrame, size: int = 200) -> DataFrame:
    """First page of each principal: newest first."""
    return top_for(audit, principals, [F.desc("created_at"), F.asc("audit_id")], size)


def seed_stages(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Default stages for jobs that have none (an explode, not a cross join)."""
    defaults = F.array(*[F.lit(s) for s in lx.DEFAULT_STAGES])
    bare = jobs.join(stages.select("job_id").distinct(), "job_id", "left_anti")
    return bare.select("job_id", "user_id", "org_id", F.posexplode(defaults).alias("position", "name"))


def append_stage(new_stages: DataFrame, stages: DataFrame) -> DataFrame:
    """Position defaults to the job's current number of stages."""
    counts = stages.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return (
        new_stages.join(counts, "job_id", "left")
        .withColumn("position", F.coalesce("position", "_n", F.lit(0)))
        .drop("_n")
    )


def stage_order(stages: DataFrame) -> DataFrame:
    return stages.orderBy("job_id", "position", "stage_id")


def delete_stage_reassign(
    stages: DataFrame, placements: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete one stage per listed job; its placements move to the first that remains.

    Returns (stages, placements).  The only stage of a job is kept.
    """
    marked = flag_members(stages, deleted.select("stage_id").distinct(), "stage_id", "_gone")
    targets = (
        marked.filter(~F.col("_gone"))
        .groupBy("job_id")
        .agg(F.min_by("stage_id", F.struct("position", "stage_id")).alias("_target"))
    )
    fate = marked.join(targets, "job_id", "left").withColumn(
        "_gone", F.col("_gone") & F.col("_target").isNotNull()
    )
    left = fate.filter(~F.col("_gone")).select(*stages.columns)
    moves = fate.filter("_gone").select("stage_id", "_target")
    moved = placements.join(moves, "stage_id", "left").withColumn(
        "stage_id", F.coalesce("_target", "stage_id")
    )
    return left, moved.select(*placements.columns)


def unique_pair(requests: DataFrame, existing: DataFrame, order: str = "row_no") -> DataFrame:
    """First request per (job, candidate) that is not there yet; the rest are duplicates."""
    pair = ["job_id", "candidate_id"]
    firsts = first_per_key(requests, pair, order).join(
        existing.select(*pair).distinct(), pair, "left_anti"
    )
    return flag_members(requests, firsts, order, "_first").withColumn(
        "disposition", F.when(F.col("_first"), "created").otherwise("duplicate")
    ).drop("_first")
