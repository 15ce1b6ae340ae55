"""Matching, recruiting tables, imports, billing and streams as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.operators import billing, crm, deltas, detect, imports, matching, profile, redact, scope
from sievework.plans import dataset as ds
from sievework.plans import oracles as o
from sievework.plans.queries import _LINES, _TAGGED, AS_OF_SQL, as_of, joined, oracle_of, register, stamp
from sievework.session import materialise, work_dir
from sievework.sources import sinks, tables
from sievework.sources.buckets import BucketTable
from sievework.streaming import streams

EVENTS = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CUSTOMERS = (
    "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
)


def event_stream(spark, sf):
    raw = streams.read_table_stream(spark, f"{sf}/events*.parquet", EVENTS)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


# =============================================================== matching

_WEIGHT = "CASE category " + " ".join(
    f"WHEN {o.q(c)} THEN {w}" for c, w in lx.CATEGORY_WEIGHTS.items()
) + f" ELSE {lx.DEFAULT_CATEGORY_WEIGHT} END"
_JD = (
    f"jds AS MATERIALIZED (SELECT item_id AS jd_id, text || chr(10) || "
    f"{o.pick('item_id', ds.JD_SKILLS)} AS jd_text FROM benchmark),\n"
    + o.doc_skills("jskills", "jds", "jd_id", "jd_text")
)
_SCORED = f"""cats AS (SELECT p.doc_id, p.jd_id, j.category, count(*) AS n,
    count(d.skill) AS hit FROM wanted p JOIN jskills j ON j.jd_id = p.jd_id
    LEFT JOIN dskills d ON d.doc_id = p.doc_id AND d.skill = j.skill GROUP BY 1, 2, 3),
scores AS (SELECT doc_id, jd_id, round_even(100 * sum({_WEIGHT} * (hit / n)) / sum({_WEIGHT}), 0) AS raw,
    sum(n) AS n_jd, sum(hit) AS n_hit FROM cats GROUP BY 1, 2),
ncv AS (SELECT doc_id, count(*) AS n FROM dskills GROUP BY 1)"""
_JD_OUT = """CAST(CASE WHEN coalesce(n_jd, 0) < 3 THEN least(coalesce(raw, 0), 60) ELSE raw END AS BIGINT)
    AS match_score, CAST(coalesce(n_hit, 0) AS BIGINT) AS matched,
    CAST(coalesce(n_jd - n_hit, 0) AS BIGINT) AS missing,
    CAST(coalesce(ncv.n, 0) - coalesce(n_hit, 0) AS BIGINT) AS bonus"""


def _jd_counts(df, *more):
    return df.select(
        "doc_id", "jd_id", F.col("match_score").cast("long"),
        *[F.size(f"{n}_skills").cast("long").alias(n) for n in ("matched", "missing", "bonus")],
        *more,
    )


_JD_LISTS = """lists AS (SELECT w.doc_id, w.jd_id,
  string_agg(j.skill, '|' ORDER BY j.skill) FILTER (d.skill IS NOT NULL) AS matched_list,
  string_agg(j.skill, '|' ORDER BY j.skill) FILTER (d.skill IS NULL) AS missing_list
  FROM wanted w JOIN jskills j USING (jd_id) LEFT JOIN dskills d ON d.doc_id = w.doc_id AND d.skill = j.skill
  GROUP BY 1, 2),
extra AS (SELECT w.doc_id, w.jd_id, string_agg(d.skill, '|' ORDER BY d.skill) AS bonus_list FROM wanted w
  JOIN dskills d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM jskills j WHERE j.jd_id = w.jd_id
  AND j.skill = d.skill) GROUP BY 1, 2)"""
_JD_NOTE = (
    "CASE WHEN coalesce(n_jd, 0) < 3 THEN 'Only ' || CAST(CAST(coalesce(n_jd, 0) AS BIGINT) AS VARCHAR) || "
    "' recognisable skill' || CASE WHEN coalesce(n_jd, 0) <> 1 THEN 's' ELSE '' END || ' found in the JD — "
    "score is capped at 60/100 until the JD lists more requirements.' ELSE '' END"
)


@register(
    "jd_match_pairs",
    f"WITH {o.SKILLS}, {_JD}, wanted AS (SELECT doc_id, doc_id % 40 AS jd_id FROM docs), {_SCORED}, "
    f"{_JD_LISTS} SELECT w.doc_id, w.jd_id, {_JD_OUT}, coalesce(matched_list, '') AS matched_list, "
    "coalesce(missing_list, '') AS missing_list, coalesce(bonus_list, '') AS bonus_list, "
    f"{_JD_NOTE} AS note FROM wanted w LEFT JOIN scores USING (doc_id, jd_id) LEFT JOIN ncv USING (doc_id) "
    "LEFT JOIN lists USING (doc_id, jd_id) LEFT JOIN extra USING (doc_id, jd_id)",
)
def jd_match_pairs(spark, sf):
    cvs = ds.skills_of_documents(spark, sf).withColumnRenamed("skills", "cv_skills")
    jds = profile.add_skills(ds.job_descriptions(spark, sf), "jd_text").select(
        "jd_id", F.col("skills").alias("jd_skills")
    )
    pairs = cvs.withColumn("jd_id", F.col("doc_id") % 40).join(jds, "jd_id")
    scored = matching.jd_match(pairs)
    return _jd_counts(
        scored,
        *[joined(f"{n}_skills").alias(f"{n}_list") for n in ("matched", "missing", "bonus")],
        F.col("coverage_note").alias("note"),
    )


@register(
    "jd_match_corpus",
    f"WITH {o.SKILLS}, {_JD}, wanted AS (SELECT DISTINCT d.doc_id, j.jd_id FROM dskills d "
    f"JOIN jskills j ON d.skill = j.skill), {_SCORED} SELECT w.doc_id, w.jd_id, {_JD_OUT} "
    "FROM wanted w JOIN scores USING (doc_id, jd_id) JOIN ncv USING (doc_id)",
)
def jd_match_corpus(spark, sf):
    jds = profile.add_skills(ds.job_descriptions(spark, sf), "jd_text").select("jd_id", "skills")
    return _jd_counts(matching.jd_match_corpus(ds.skills_of_documents(spark, sf), jds))


@register(
    "jd_top",
    f"WITH {o.SKILLS}, {_JD}, wanted AS (SELECT DISTINCT d.doc_id, j.jd_id FROM dskills d "
    f"JOIN jskills j ON d.skill = j.skill), {_SCORED}, found AS (SELECT w.doc_id, w.jd_id, {_JD_OUT} "
    "FROM wanted w JOIN scores USING (doc_id, jd_id) JOIN ncv USING (doc_id)) SELECT * FROM (SELECT *, "
    "row_number() OVER (PARTITION BY jd_id ORDER BY match_score DESC, doc_id) AS rank FROM found) WHERE rank <= 10",
)
def jd_top(spark, sf):
    jds = profile.add_skills(ds.job_descriptions(spark, sf), "jd_text").select("jd_id", "skills")
    best = matching.jd_top(ds.skills_of_documents(spark, sf), jds, 10)
    return _jd_counts(best, F.col("rank").cast("long"))


_MATCH = f"""WITH {o.SKILLS}, {o.CAND}, {o.JOBS},
reqs AS (SELECT job_id, i, req FROM (SELECT job_id, unnest(r) AS req, generate_subscripts(r, 1) AS i
  FROM (SELECT job_id, list_filter(list_transform(required_skills, lambda s: lower(trim(s))),
        lambda s: s <> '') AS r FROM jobs))),
nreq AS (SELECT job_id, count(*) AS n FROM reqs GROUP BY 1),
parts AS (SELECT DISTINCT doc_id, unnest(list_append(list_filter(string_split_regex(lower(skill),
  '[.\\s/,]+'), lambda x: x <> ''), lower(skill))) AS part FROM dskills),
seen AS (SELECT j.job_id, c.candidate_id, c.full_name, c.scan_id FROM jobs j JOIN cand c
  ON c.user_id = j.user_id OR c.org_id = j.org_id),
hits AS (SELECT s.job_id, s.candidate_id, s.full_name, r.i, r.req FROM reqs r
  JOIN parts p ON p.part = r.req JOIN seen s ON s.job_id = r.job_id AND s.scan_id = p.doc_id),
matches AS (SELECT h.job_id, candidate_id, full_name, count(*) AS n_matched,
  CAST(round_even(100.0 * count(*) / max(n), 0) AS BIGINT) AS score,
  string_agg(req, '|' ORDER BY i) AS matched FROM hits h JOIN nreq USING (job_id) GROUP BY 1, 2, 3)"""


def _matches(spark, sf):
    told = {"matched": joined("matched_skills")}
    return matching.auto_match(ds.jobs(spark, sf), ds.candidates_with_skills(spark, sf), told)


@register("auto_match", f"{_MATCH} SELECT job_id, candidate_id, score, matched FROM matches")
def auto_match(spark, sf):
    return _matches(spark, sf).select("job_id", "candidate_id", F.col("score").cast("long"), "matched")


@register(
    "rank_matches",
    f"{_MATCH} SELECT job_id, candidate_id, score, matched, rank FROM (SELECT *, CAST(row_number() OVER ("
    "PARTITION BY job_id ORDER BY score DESC, n_matched DESC, lower(full_name), candidate_id) AS "
    "BIGINT) AS rank FROM matches) WHERE rank <= 5",
)
def rank_matches(spark, sf):
    best = matching.best_matches(ds.jobs(spark, sf), ds.candidates_with_skills(spark, sf), 5)
    return best.select(
        "job_id", "candidate_id", F.col("score").cast("long"),
        joined("matched_skills").alias("matched"), F.col("rank").cast("long"),
    )


def _tok(expr: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({expr}), '{lx.SEARCH_TOKEN}')), "
        f"lambda x: len(x) > 1 AND NOT list_contains({o.arr(lx.SEARCH_STOP_WORDS)}, x))"
    )


_SEARCH = f"""WITH {o.SKILLS}, {o.CAND}, qs AS (SELECT item_id AS query_id, {o.user_of('item_id')} AS u,
  {o.org_of('item_id')} AS g, {_tok(o.pick('item_id', ds.SEARCHES))} AS terms FROM benchmark),
terms AS (SELECT query_id, u, g, len(terms) AS n, unnest(terms) AS token FROM qs),
idx AS MATERIALIZED (SELECT candidate_id, lower(skill) AS token FROM cand JOIN dskills ON scan_id = doc_id
  UNION SELECT candidate_id, unnest({_tok('skill')}) FROM cand JOIN dskills ON scan_id = doc_id
  UNION SELECT candidate_id, unnest({_tok("coalesce(headline, '')")}) FROM cand
  UNION SELECT candidate_id, unnest({_tok('full_name')}) FROM cand),
hits AS (SELECT query_id, candidate_id, CAST(round_even(100.0 * count(*) / max(n), 0) AS BIGINT) AS score
FROM terms JOIN idx USING (token) JOIN cand c USING (candidate_id)
WHERE c.user_id = terms.u OR c.org_id = terms.g GROUP BY 1, 2)"""


@register("talent_search", f"{_SEARCH} SELECT query_id, candidate_id, score FROM hits")
def talent_search(spark, sf):
    hits = matching.talent_search(ds.searches(spark, sf), ds.candidates_with_skills(spark, sf))
    return hits.select("query_id", "candidate_id", F.col("score").cast("long"))


@register(
    "rank_hits",
    f"{_SEARCH} SELECT query_id, rank, candidate_id, score FROM (SELECT query_id, candidate_id, score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(full_name), candidate_id) AS rank "
    "FROM hits JOIN cand USING (candidate_id)) WHERE rank <= 10",
)
def rank_hits(spark, sf):
    hits = matching.talent_search(ds.searches(spark, sf), ds.candidates_with_skills(spark, sf), 10)
    return hits.select(
        "query_id", F.col("rank").cast("long"), "candidate_id", F.col("score").cast("long")
    )


@register(
    "flat_skills",
    f"WITH {o.SKILLS} SELECT doc_id, string_agg(DISTINCT lower(skill), '|' ORDER BY lower(skill)) "
    "AS skills FROM dskills GROUP BY 1",
)
def flat_skills(spark, sf):
    flat = ds.skills_of_documents(spark, sf).withColumn("f", profile.flat_skills(F.col("skills")))
    return flat.filter(F.size("f") > 0).select("doc_id", joined(F.array_sort("f")).alias("skills"))


@register(
    "union_findings",
    f"WITH {o.SCAN_CTES} SELECT kind AS finding, count(*) AS n FROM ("
    "SELECT kind FROM inj UNION ALL SELECT kind FROM b64inj) GROUP BY 1",
)
def union_findings(spark, sf):
    found = ds.scans(spark, sf).select(F.explode("prompt_injection_findings").alias("f"))
    return found.groupBy(F.col("f.pattern_id").alias("finding")).agg(F.count(F.lit(1)).alias("n"))


# ============================================================ store: joins

_RISKY = f"WITH {o.SCAN_CTES}, {o.CAND}"


@register(
    "candidates_with_risk",
    f"{_RISKY} SELECT candidate_id, risk_level, CAST(risk_score AS VARCHAR) AS risk_score FROM cand c "
    "LEFT JOIN scan s ON c.scan_id = s.doc_id",
)
def candidates_with_risk(spark, sf):
    return crm.candidates_with_risk(ds.candidates(spark, sf), ds.stored_scans(spark, sf)).select(
        "candidate_id", "risk_level", F.col("risk_score").cast("string")
    )


@register(
    "shortlist_cards",
    f"{_RISKY}, {o.PAIRS}, {o.SHORT} SELECT entry_id, l.job_id, candidate_id, c.full_name, c.status, "
    "s.risk_level FROM shortl l JOIN cand c USING (candidate_id) LEFT JOIN scan s "
    "ON c.scan_id = s.doc_id",
)
def shortlist_cards(spark, sf):
    cards = crm.shortlist_cards(
        ds.shortlist(spark, sf), ds.candidates(spark, sf), ds.stored_scans(spark, sf)
    )
    return cards.select("entry_id", "job_id", "candidate_id", "full_name", "status", "risk_level")


_BOARD_STAGES = (
    f"{o.STAGES}, full_stages AS (SELECT stage_id, job_id, name, position FROM stages UNION ALL "
    f"SELECT job_id * 10 + n - 1, job_id, {o.arr(lx.DEFAULT_STAGES)}[n], CAST(n - 1 AS INTEGER) FROM jobs, "
    "(VALUES (1), (2), (3), (4), (5)) v(n) WHERE job_id NOT IN (SELECT job_id FROM stages))"
)


@register(
    "pipeline_board",
    f"{_RISKY}, {_BOARD_STAGES}, {o.PLACE}, firsts AS (SELECT job_id, first(stage_id ORDER BY position, "
    "stage_id) AS first_id FROM full_stages GROUP BY 1), cards AS (SELECT coalesce(own.stage_id, f.first_id) "
    "AS stage_id, p.placement_id, c.full_name, s.risk_level FROM place p JOIN firsts f USING (job_id) "
    "LEFT JOIN full_stages own ON own.stage_id = p.stage_id AND own.job_id = p.job_id "
    "JOIN cand c USING (candidate_id) LEFT JOIN scan s ON c.scan_id = s.doc_id) "
    "SELECT job_id, stage_id, name, position, CAST(placement_id AS VARCHAR) AS placement_id, full_name, "
    "risk_level FROM full_stages LEFT JOIN cards USING (stage_id)",
)
def pipeline_board(spark, sf):
    stages = ds.stages(spark, sf)
    seeded = crm.seed_stages(ds.jobs(spark, sf), stages).withColumn(
        "stage_id", F.col("job_id") * 10 + F.col("position")
    )
    board = crm.pipeline_board(
        stages.unionByName(seeded.select(*stages.columns)),
        ds.placements(spark, sf), ds.candidates(spark, sf), ds.stored_scans(spark, sf),
    )
    return board.select(
        "job_id", "stage_id", "name", "position", F.col("placement_id").cast("string"),
        "full_name", "risk_level",
    )


@register(
    "high_risk_candidates",
    f"{_RISKY} SELECT candidate_id, full_name, risk_score FROM cand c JOIN scan s "
    "ON c.scan_id = s.doc_id WHERE risk_level = 'RED'",
)
def high_risk_candidates(spark, sf):
    return crm.high_risk_candidates(ds.candidates(spark, sf), ds.stored_scans(spark, sf)).select(
        "candidate_id", "full_name", F.col("risk_score").cast("long")
    )


@register(
    "open_jobs_without_candidates",
    f"WITH {o.JOBS}, {o.PLACE} SELECT job_id, title FROM jobs WHERE status = 'open' AND job_id NOT IN "
    "(SELECT job_id FROM place WHERE job_id % 7 <> 3)",
)
def open_jobs_without_candidates(spark, sf):
    """Every job of the store has placements; here those of some jobs were withdrawn."""
    left = ds.placements(spark, sf).filter(F.col("job_id") % 7 != 3)
    return crm.open_jobs_without_candidates(ds.jobs(spark, sf), left).select("job_id", "title")


@register(
    "available_candidates",
    f"WITH {o.PAIRS}, {o.JOBS} SELECT j.job_id, c.c_custkey AS candidate_id FROM jobs j JOIN customer c "
    "ON c.c_custkey % 25 = j.job_id % 25 WHERE NOT EXISTS (SELECT 1 FROM prs p WHERE p.job_id = j.job_id "
    "AND p.candidate_id = c.c_custkey)",
)
def available_candidates(spark, sf):
    """Offers of every candidate to a fixed share of the jobs, minus those already placed."""
    slot = lambda df, key: df.select(key, (F.col(key) % 25).alias("slot"))
    return crm.available_candidates(
        slot(ds.jobs(spark, sf), "job_id"), ds.pairs(spark, sf), slot(ds.candidates(spark, sf), "candidate_id")
    )


@register(
    "promote_scans",
    f"WITH {o.SCAN_CTES}, {o.YEARS}, {o.TIER}, mails AS (SELECT doc_id, min_by(m, s) AS m FROM {o.LAST} "
    "WHERE kind = 'email' GROUP BY 1) SELECT d.doc_id AS request_id, "
    "CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 4 = 0 THEN 'Given Name' "
    "WHEN d.doc_id % 7 = 3 THEN NULL ELSE 'cv ' || CAST(d.doc_id AS VARCHAR) || '.v1' END AS full_name, "
    "CASE WHEN d.doc_id % 10 <> 0 AND d.doc_id % 7 <> 3 THEN mails.m END AS email, "
    "CASE WHEN d.doc_id % 10 <> 0 AND d.doc_id % 7 <> 3 THEN CASE WHEN max_years > 0 THEN tier || ' · ' "
    "|| CAST(max_years AS VARCHAR) || ' yrs experience' ELSE tier END END AS headline, "
    "CASE WHEN d.doc_id % 10 = 0 THEN 'name_required' WHEN d.doc_id % 7 = 3 THEN 'scan_not_found' "
    "ELSE 'created' END AS disposition FROM docs d JOIN tier USING (doc_id) "
    "LEFT JOIN mails ON mails.doc_id = d.doc_id",
)
def promote_scans(spark, sf):
    d = F.col("doc_id")
    requests = ds.table(spark, sf, "documents").select(
        d.alias("request_id"),
        F.when(d % 10 != 0, d).alias("scan_id"),
        # Requests by a stranger fail; the rest come from the owner.
        F.when(d % 7 == 3, "stranger").otherwise(ds.user_of(d)).alias("user_id"),
        F.lit(None).cast("string").alias("org_id"),
        F.when((d % 4 == 0) & (d % 10 != 0), "Given Name").alias("full_name"),
        F.lit("").alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("string").alias("headline"),
    )
    docs = ds.documents(spark, sf)
    found = detect_and_analyse(docs)
    out = crm.promote_scans(
        requests,
        found.withColumnsRenamed({"doc_id": "scan_id", "upload_name": "filename"}),
    )
    return out.select("request_id", "full_name", "email", "headline", "disposition")


def detect_and_analyse(docs):
    return profile.analyse_corpus(detect.scan_risk(docs))


@register(
    "public_share_view",
    f"{_RISKY}, {o.JOBS}, {o.PAIRS}, {o.SHORT}, {o.SHARES} SELECT token, j.title AS job_title, "
    "c.full_name, s.risk_level FROM shares h JOIN jobs j USING (job_id) JOIN shortl l USING (job_id) "
    "JOIN cand c USING (candidate_id) LEFT JOIN scan s ON c.scan_id = s.doc_id "
    f"WHERE h.expires_at IS NULL OR h.expires_at >= {AS_OF_SQL}",
)
def public_share_view(spark, sf):
    view = crm.public_share_view(
        ds.shares(spark, sf), ds.jobs(spark, sf), ds.shortlist(spark, sf),
        ds.candidates(spark, sf), ds.stored_scans(spark, sf), as_of(),
    )
    return view.select("token", "job_title", "full_name", "risk_level")


@register(
    "assessments_with_scan",
    f"WITH {o.DOCS} SELECT l.doc_id AS assessment_id, d.org_id FROM labels l JOIN docs d USING (doc_id)",
)
def assessments_with_scan(spark, sf):
    made = ds.table(spark, sf, "labels").select(
        F.col("doc_id").alias("assessment_id"), F.col("doc_id").alias("scan_id"),
        F.lit("other").alias("org_id"),
    )
    scans = ds.with_cv_columns(ds.table(spark, sf, "documents")).select(
        F.col("doc_id").alias("scan_id"), "org_id"
    )
    return crm.assessments_with_scan(made, scans).select("assessment_id", "org_id")


@register(
    "integrity_sweep",
    "SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 11 <> 0 AND c_custkey IN "
    "(SELECT doc_id FROM documents) THEN CAST(c_custkey AS VARCHAR) END AS scan_id FROM customer",
)
def integrity_sweep(spark, sf):
    parents = ds.table(spark, sf, "documents")
    swept = crm.null_orphans(ds.candidates(spark, sf), parents, "scan_id", "doc_id")
    return swept.select("candidate_id", F.col("scan_id").cast("string"))


@register(
    "cascade_orphans",
    f"WITH {o.PAIRS} SELECT row_no AS entry_id FROM prs WHERE job_id IN (SELECT p_partkey FROM part "
    "WHERE p_size % 2 = 0)",
)
def cascade_orphans(spark, sf):
    kept = ds.table(spark, sf, "part").filter(F.col("p_size") % 2 == 0)
    return crm.cascade_orphans(ds.shortlist(spark, sf), kept, "job_id", "p_partkey").select(
        "entry_id"
    )


@register(
    "validate_moves",
    f"WITH {o.STAGES}, {o.PLACE} SELECT placement_id, EXISTS (SELECT 1 FROM stages s WHERE s.job_id = "
    "p.job_id AND s.stage_id = p.job_id * 10 + p.placement_id % 3) AS is_valid FROM place p",
)
def validate_moves(spark, sf):
    places = ds.placements(spark, sf)
    moves = places.select(
        "placement_id", (F.col("job_id") * 10 + F.col("placement_id") % 3).alias("to_stage_id")
    )
    return crm.validate_moves(moves, places, ds.stages(spark, sf)).select(
        "placement_id", "is_valid"
    )


# ============================================ store: filters and projections


@register(
    "tenant_scope",
    f"WITH {o.CAND} SELECT candidate_id FROM cand WHERE user_id = 'u3' OR org_id = 'o1'",
)
def tenant_scope(spark, sf):
    return crm.tenant_scope(ds.candidates(spark, sf), "u3", "o1").select("candidate_id")


@register(
    "visible_to_many",
    f"WITH {o.CAND}, ps AS (SELECT DISTINCT {o.user_of('p_partkey')} AS u, {o.org_of('p_partkey')} AS g "
    "FROM part) SELECT u AS p_user, coalesce(g, '') AS p_org, count(*) AS n FROM ps JOIN cand c "
    "ON c.user_id = u OR c.org_id = g GROUP BY 1, 2",
)
def visible_to_many(spark, sf):
    who = ds.jobs(spark, sf).select(
        F.col("user_id").alias("p_user"), F.col("org_id").alias("p_org")
    ).distinct()
    seen = scope.visible_to(ds.candidates(spark, sf), who, "user_id", "org_id")
    return seen.groupBy("p_user", F.coalesce("p_org", F.lit("")).alias("p_org")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "status_and_name_filters",
    f"WITH {o.CAND} SELECT candidate_id FROM cand WHERE status = 'new' AND full_name ILIKE '%r#0_%5%'",
)
def status_and_name_filters(spark, sf):
    people = crm.by_status(ds.candidates(spark, sf), "new")
    return crm.name_search(people, "R#0_%5").select("candidate_id")


@register(
    "since_month_start",
    f"SELECT event_id FROM events WHERE ts >= date_trunc('month', {AS_OF_SQL})",
)
def since_month_start(spark, sf):
    return crm.since_month_start(ds.table(spark, sf, "events"), as_of(), "ts").select("event_id")


@register(
    "unexpired_shares",
    f"WITH {o.JOBS}, {o.SHARES} SELECT token FROM shares WHERE expires_at IS NULL OR "
    f"expires_at >= {AS_OF_SQL}",
)
def unexpired_shares(spark, sf):
    return crm.unexpired_shares(ds.shares(spark, sf), as_of()).select("token")


@register(
    "lookup",
    f"WITH {o.JOBS} SELECT job_id, title FROM jobs WHERE job_id IN (SELECT l_partkey FROM lineitem "
    "WHERE l_returnflag = 'R')",
)
def lookup(spark, sf):
    keys = ds.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("job_id")
    )
    return crm.lookup(ds.jobs(spark, sf), keys, "job_id").select("job_id", "title")


@register(
    "scan_history",
    f"WITH {o.SCAN_CTES} SELECT doc_id AS scan_id, {o.ts('created_at')} AS created_at, risk_level "
    "FROM scan WHERE user_id = 'u2' OR org_id = 'o0'",
)
def scan_history(spark, sf):
    mine = crm.tenant_scope(ds.scans(spark, sf), "u2", "o0")
    listed = crm.newest_first(crm.scan_history(mine), "scan_id")
    return listed.select("scan_id", stamp(F.col("created_at")).alias("created_at"), "risk_level")


@register(
    "scan_detail",
    f"WITH {o.SCAN_CTES}, {_LINES} SELECT s.doc_id, s.risk_level, md5(regexp_replace({_TAGGED}, "
    "'^\\s+|\\s+$', '', 'g')) AS original FROM scan s JOIN swept USING (doc_id)",
)
def scan_detail(spark, sf):
    docs = detect.detect(detect.normalise(ds.documents(spark, sf)))
    kept = redact.add_safe_copy(docs).select("doc_id", "risk_level", "safe_copy_text")
    detail = crm.scan_detail(kept)
    return detail.select(
        "doc_id", "risk_level", F.md5(F.col("original_text").cast("binary")).alias("original")
    )


@register(
    "unread", f"WITH {o.NOTIF} SELECT notification_id FROM notif WHERE \"read\" = 0"
)
def unread(spark, sf):
    return crm.unread(ds.notifications(spark, sf)).select("notification_id")


@register(
    "mark_read",
    f"WITH {o.NOTIF} SELECT notification_id, CASE WHEN notification_id % 3 = 0 THEN 1 ELSE \"read\" END "
    "AS read_now FROM notif",
)
def mark_read(spark, sf):
    rows = ds.notifications(spark, sf)
    ids = rows.filter(F.col("notification_id") % 3 == 0).select("notification_id")
    return crm.mark_read(rows, ids).select("notification_id", F.col("read").alias("read_now"))


@register(
    "validate_enum",
    f"WITH {o.JOBS} SELECT job_id, job_id % 5 <> 0 AS is_valid FROM jobs",
)
def validate_enum(spark, sf):
    wanted = ds.jobs(spark, sf).withColumn(
        "status", F.when(F.col("job_id") % 5 == 0, "paused").otherwise(F.col("status"))
    )
    return crm.validate_enum(wanted, "status", lx.JOB_STATUSES).select("job_id", "is_valid")


@register(
    "merge_changes",
    f"WITH {o.JOBS} SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'second' ELSE title END AS title, "
    "CASE WHEN job_id % 3 = 0 THEN NULL WHEN job_id % 3 = 1 THEN 'Only' ELSE client_name END AS "
    "client_name FROM jobs",
)
def merge_changes(spark, sf):
    table, changes = _job_changes(spark, sf)
    return crm.merge_changes(table, changes, "job_id")


@register("merge_stored", oracle_of("merge_changes"))
def merge_stored(spark, sf):
    """The same changes on a stored table, the second batch of them twice."""
    table, changes = _job_changes(spark, sf)
    path = work_dir(spark, "jobs")
    stored = lambda v: BucketTable(spark, path, "job_id long, title string, client_name string", ["job_id"], before=v)
    stored(0).merge(0, table)
    for version in (1, 2, 2):
        crm.merge_stored(stored(version), version, changes.filter(F.col("change_no") == version), "job_id")
    return stored(None).read()


@register("mark_read_stored", oracle_of("mark_read"))
def mark_read_stored(spark, sf):
    rows = ds.notifications(spark, sf).select("notification_id", "user_id", "org_id", "read")
    path, schema = work_dir(spark, "notifications"), "notification_id long, user_id string, org_id string, read int"
    stored = lambda v: BucketTable(spark, path, schema, ["notification_id"], before=v)
    stored(0).merge(0, rows)
    ids = rows.filter(F.col("notification_id") % 3 == 0)
    crm.mark_read_stored(stored(1), 1, ids)
    return stored(None).read().select("notification_id", F.col("read").alias("read_now"))


def _job_changes(spark, sf):
    table = ds.jobs(spark, sf).select("job_id", "title", "client_name")
    k = F.col("job_id")
    first = table.filter(k % 3 == 0).select(
        "job_id", F.lit(1).alias("change_no"),
        F.create_map(F.lit("title"), F.lit("first"), F.lit("client_name"), F.lit("x")).alias("fields"),
    )
    second = table.filter(k % 3 == 0).select(
        "job_id", F.lit(2).alias("change_no"),
        F.create_map(
            F.lit("title"), F.lit("second"), F.lit("client_name"), F.lit(None).cast("string")
        ).alias("fields"),
    )
    single = table.filter(k % 3 == 1).select(
        "job_id", F.lit(1).alias("change_no"),
        F.create_map(F.lit("client_name"), F.lit("Only")).alias("fields"),
    )
    return table, first.unionByName(second).unionByName(single)


# ======================================================== store: aggregates


@register("counts_by", f"WITH {o.CAND} SELECT user_id, status, count(*) AS n FROM cand GROUP BY 1, 2")
def counts_by(spark, sf):
    return crm.counts_by(ds.candidates(spark, sf), "user_id", "status")


_STATUS = ", ".join(
    f"count(*) FILTER (status = {o.q(s)}) AS candidates_{s}" for s in ds.CANDIDATE_STATUSES
)
_JSTATUS = ", ".join(f"count(*) FILTER (status = {o.q(s)}) AS jobs_{s}" for s in lx.JOB_STATUSES)


_WHO = "u AS p_user, coalesce(g, '') AS p_org"


def _named(df):
    return df.withColumn("p_org", F.coalesce("p_org", F.lit("")))


@register(
    "dashboard_metrics",
    f"{_RISKY}, {o.JOBS}, {o.PLACE}, {o.SHORT}, {o.PRINCIPALS}, "
    f"a AS (SELECT {_WHO}, {_STATUS}, count(t.candidate_id) AS candidates_total FROM "
    f"{o.seen('cand', 't')} GROUP BY 1, 2), "
    f"b AS (SELECT {_WHO}, {_JSTATUS}, count(t.job_id) AS jobs_total FROM {o.seen('jobs', 't')} "
    "GROUP BY 1, 2), "
    f"r AS (SELECT {_WHO}, count(*) FILTER (risk_level = 'GREEN') AS risk_GREEN, "
    "count(*) FILTER (risk_level = 'ORANGE') AS risk_ORANGE, "
    f"count(*) FILTER (risk_level = 'RED') AS risk_RED FROM {o.seen('scan', 't')} GROUP BY 1, 2), "
    f"p AS (SELECT {_WHO}, count(t.job_id) AS placements_total FROM {o.seen('place', 't')} GROUP BY 1, 2), "
    f"s AS (SELECT {_WHO}, count(t.job_id) AS shortlist_total FROM {o.seen('shortl', 't')} GROUP BY 1, 2) "
    "SELECT *, jobs_open AS open_jobs FROM a JOIN b USING (p_user, p_org) JOIN r USING (p_user, p_org) "
    "JOIN p USING (p_user, p_org) JOIN s USING (p_user, p_org)",
)
def dashboard_metrics(spark, sf):
    return _named(
        crm.dashboard_metrics(
            ds.candidates(spark, sf), ds.jobs(spark, sf), ds.stored_scans(spark, sf),
            ds.placements(spark, sf), ds.shortlist(spark, sf), ds.CANDIDATE_STATUSES,
            ds.principals(spark, sf),
        )
    )


@register(
    "maintained_dashboard",
    f"WITH {o.CAND}, {o.JOBS}, {o.PLACE}, {o.PRINCIPALS}, "
    f"cand2 AS (SELECT * REPLACE (CASE WHEN candidate_id % 4 = 1 THEN {o.q(ds.CANDIDATE_STATUSES[0])} ELSE status END "
    "AS status) FROM cand WHERE candidate_id % 9 <> 0), "
    "jobs2 AS (SELECT * REPLACE (CASE WHEN job_id % 5 = 0 THEN 'u1' ELSE user_id END AS user_id) FROM jobs), "
    f"a AS (SELECT {_WHO}, {_STATUS}, count(t.candidate_id) AS candidates_total FROM "
    f"{o.seen('cand2', 't')} GROUP BY 1, 2), "
    f"b AS (SELECT {_WHO}, {_JSTATUS}, count(t.job_id) AS jobs_total FROM {o.seen('jobs2', 't')} GROUP BY 1, 2), "
    f"p AS (SELECT {_WHO}, count(t.job_id) AS placements_total FROM {o.seen('place', 't')} GROUP BY 1, 2) "
    "SELECT *, jobs_open AS open_jobs FROM a JOIN b USING (p_user, p_org) JOIN p USING (p_user, p_org)",
)
def maintained_dashboard(spark, sf):
    """Cells counted once, then changed by batches: new statuses and deletions, jobs that move, one batch twice."""
    people, jobs, placed = ds.candidates(spark, sf), ds.jobs(spark, sf), ds.placements(spark, sf)
    count = {n: lambda rows, n=n: crm.dashboard_cells(rows, n, ds.CANDIDATE_STATUSES) for n in ("candidates", "jobs", "placements")}
    k, j = F.col("candidate_id"), F.col("job_id")
    changed = people.filter((k % 4 == 1) | (k % 9 == 0))
    now = changed.filter(k % 9 != 0).withColumn("status", F.lit(ds.CANDIDATE_STATUSES[0]))
    moved = jobs.filter(j % 5 == 0)
    keys = ["user_id", "org_id"]
    batches = [
        [(n, rows.limit(0), rows) for n, rows in (("candidates", people), ("jobs", jobs), ("placements", placed))],
        [("candidates", changed, now)],
        [("jobs", moved, moved.withColumn("user_id", F.lit("u1")))],
    ]
    every = [c for n, rows in (("candidates", people), ("jobs", jobs), ("placements", placed)) for c in count[n](rows).columns]
    measures = list(dict.fromkeys(c for c in every if c not in keys))
    cells = deltas.Cells(spark, work_dir(spark, "dashboard"), dict.fromkeys(keys, "string"), measures)
    for version in (0, 1, 2, 2):
        parts = [deltas.changed_cells(before, after, count[n], keys) for n, before, after in batches[version]]
        changes = parts[0]
        for part in parts[1:]:
            changes = changes.unionByName(part, allowMissingColumns=True)
        changes = changes.fillna(0, [c for c in changes.columns if c not in keys])
        cells.apply(version, changes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in changes.columns if c not in keys]))
    return _named(crm.dashboard_of(cells.read(), ds.principals(spark, sf)))


@register(
    "risk_breakdown",
    f"WITH {o.SCAN_CTES} SELECT user_id, count(*) FILTER (risk_level = 'GREEN') AS green, "
    "count(*) FILTER (risk_level = 'ORANGE') AS orange, count(*) FILTER (risk_level = 'RED') AS red "
    "FROM scan GROUP BY 1",
)
def risk_breakdown(spark, sf):
    out = crm.risk_breakdown(ds.scans(spark, sf), "user_id")
    return out.withColumnsRenamed({"GREEN": "green", "ORANGE": "orange", "RED": "red"})


@register(
    "outcome_funnel_by_job",
    f"WITH {o.OUTCOMES} SELECT p_partkey AS job_id, "
    + ", ".join(f"count(outc.type) FILTER (type = {o.q(t)}) AS n_{t}" for t in lx.OUTCOME_TYPES)
    + ", count(outc.type) AS total, count(outc.type) FILTER (type IN ('hired', 'placed')) AS success "
    "FROM part LEFT JOIN outc ON p_partkey = outc.job_id GROUP BY 1",
)
def outcome_funnel_by_job(spark, sf):
    return _funnel_out(
        crm.outcome_funnel(ds.outcomes(spark, sf), ["job_id"], ds.jobs(spark, sf)), "job_id"
    )


def _funnel_out(df, *keys):
    return df.select(
        *keys,
        *[F.col(t).cast("long").alias(f"n_{t}") for t in lx.OUTCOME_TYPES],
        F.col("total").cast("long"),
        F.col("success").cast("long"),
    )


_FUNNEL_USER = (
    f"WITH {o.OUTCOMES} SELECT user_id, "
    + ", ".join(f"count(*) FILTER (type = {o.q(t)}) AS n_{t}" for t in lx.OUTCOME_TYPES)
    + ", count(*) AS total, count(*) FILTER (type IN ('hired', 'placed')) AS success FROM outc GROUP BY 1"
)


@register("outcome_funnel_by_user", _FUNNEL_USER)
def outcome_funnel_by_user(spark, sf):
    return _funnel_out(crm.outcome_funnel(ds.outcomes(spark, sf), ["user_id"]), "user_id")


@register(
    "tenant_funnel",
    f"WITH {o.OUTCOMES}, {o.PRINCIPALS} SELECT {_WHO}, "
    + ", ".join(f"count(*) FILTER (t.type = {o.q(t)}) AS n_{t}" for t in lx.OUTCOME_TYPES)
    + ", count(t.type) AS total, count(*) FILTER (t.type IN ('hired', 'placed')) AS success FROM "
    + o.seen("outc", "t") + " GROUP BY 1, 2",
)
def tenant_funnel(spark, sf):
    out = _named(crm.tenant_funnel(ds.outcomes(spark, sf), ds.principals(spark, sf)))
    return _funnel_out(out, "p_user", "p_org")


@register(
    "unread_count",
    f"WITH {o.NOTIF}, {o.PRINCIPALS} SELECT {_WHO}, count(*) FILTER (t.\"read\" = 0) AS unread_count FROM "
    f"{o.seen('notif', 't')} GROUP BY 1, 2",
)
def unread_count(spark, sf):
    return _named(crm.unread_count(ds.notifications(spark, sf), ds.principals(spark, sf)))


def _queue_sql(name: str, source: str, item: str, label: str) -> str:
    return (
        f"SELECT * FROM (SELECT {_WHO}, '{name}' AS queue, t.{item} AS item_id, t.{label} AS label, "
        f"CASE WHEN t.{item} IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY u, g ORDER BY "
        f"t.created_at DESC, t.{item}) AS BIGINT) END AS rank, count(t.{item}) OVER (PARTITION BY u, g) "
        f"AS queue_count FROM {o.seen(source, 't')}) WHERE rank <= 10 OR rank IS NULL"
    )


@register(
    "today_queue",
    f"{_RISKY}, {o.JOBS}, {o.PLACE}, {o.PRINCIPALS}, n AS (SELECT * FROM cand WHERE status = 'new'), "
    "h AS (SELECT c.* FROM cand c JOIN scan s ON c.scan_id = s.doc_id WHERE s.risk_level = 'RED'), "
    "e AS (SELECT * FROM jobs WHERE status = 'open' AND job_id NOT IN (SELECT job_id FROM place)) "
    + " UNION ALL ".join(
        [
            _queue_sql("new_candidates", "n", "candidate_id", "full_name"),
            _queue_sql("high_risk", "h", "candidate_id", "full_name"),
            _queue_sql("open_jobs", "e", "job_id", "title"),
        ]
    ),
)
def today_queue(spark, sf):
    out = crm.today_queue(
        ds.candidates(spark, sf), ds.stored_scans(spark, sf), ds.jobs(spark, sf),
        ds.placements(spark, sf), ds.principals(spark, sf),
    )
    return _named(out).withColumn("rank", F.col("rank").cast("long"))


@register(
    "corpus_findings_summary",
    f"WITH {o.SCAN_CTES} SELECT finding, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM ("
    "SELECT doc_id, kind AS finding FROM inj UNION ALL SELECT doc_id, kind FROM b64inj UNION ALL "
    f"SELECT doc_id, kind FROM {o.LAST}) GROUP BY 1",
)
def corpus_findings_summary(spark, sf):
    return crm.corpus_findings_summary(ds.scans(spark, sf)).withColumn(
        "findings", F.col("findings").cast("long")
    )


@register(
    "quota_percent",
    "SELECT event_id, CAST(CASE WHEN event_id % 12 > 0 THEN least(100, floor(100.0 * (event_id % 17) / "
    "(event_id % 12) + 0.5)) ELSE 0 END AS BIGINT) AS pct FROM events",
)
def quota_percent(spark, sf):
    e = F.col("event_id")
    return ds.table(spark, sf, "events").select(
        "event_id", crm.quota_percent(e % 17, F.nullif(e % 12, F.lit(0))).cast("long").alias("pct")
    )


# ==================================================== pages, stages, pairs


@register(
    "notification_page",
    f"WITH {o.NOTIF}, {o.PRINCIPALS} SELECT {_WHO}, notification_id, \"read\" AS read_now, "
    "CAST(row_number() OVER (PARTITION BY u, g ORDER BY \"read\", created_at DESC, notification_id) AS "
    f"BIGINT) AS rank FROM {o.seen('notif', 't')} WHERE notification_id IS NOT NULL QUALIFY rank <= 50",
)
def notification_page(spark, sf):
    page = crm.notification_page(ds.notifications(spark, sf), ds.principals(spark, sf))
    return _named(page).select(
        "p_user", "p_org", "notification_id", F.col("read").alias("read_now"),
        F.col("rank").cast("long"),
    )


_AUDIT = (
    f"{o.CAND}, {o.JOBS}, audit AS (SELECT user_id, org_id, 'c' || CAST(candidate_id AS VARCHAR) AS audit_id, "
    "'Candidate ''' || full_name || ''' added (manual).' AS summary, created_at FROM cand UNION ALL "
    "SELECT user_id, org_id, 'j' || CAST(job_id AS VARCHAR), 'Shortlist share link created for ''' || "
    "title || '''.', created_at FROM jobs)"
)


@register(
    "audit_page",
    f"WITH {_AUDIT}, {o.PRINCIPALS} SELECT {_WHO}, audit_id, summary, CAST(row_number() OVER (PARTITION BY "
    f"u, g ORDER BY created_at DESC, audit_id) AS BIGINT) AS rank FROM {o.seen('audit', 't')} "
    "WHERE audit_id IS NOT NULL QUALIFY rank <= 200",
)
def audit_page(spark, sf):
    people, jobs = ds.candidates(spark, sf), ds.jobs(spark, sf)
    log = sinks.audit_rows(
        people, "candidate.created", F.concat(F.lit("c"), F.col("candidate_id")), F.col("full_name"),
        F.lit("manual"),
    ).unionByName(
        sinks.audit_rows(jobs, "share.created", F.concat(F.lit("j"), F.col("job_id")), F.col("title"))
    )
    page = crm.audit_page(log.withColumnRenamed("entity_id", "audit_id"), ds.principals(spark, sf))
    return _named(page).select("p_user", "p_org", "audit_id", "summary", F.col("rank").cast("long"))


@register(
    "seed_stages",
    f"WITH {o.STAGES} SELECT job_id, n - 1 AS position, {o.arr(lx.DEFAULT_STAGES)}[n] AS name FROM jobs, "
    "(VALUES (1), (2), (3), (4), (5)) v(n) WHERE job_id NOT IN (SELECT job_id FROM stages)",
)
def seed_stages(spark, sf):
    return crm.seed_stages(ds.jobs(spark, sf), ds.stages(spark, sf)).select(
        "job_id", "position", "name"
    )


@register(
    "append_stage",
    "SELECT p_partkey AS job_id, CAST(CASE WHEN p_partkey % 6 = 0 THEN 77 ELSE p_partkey % 4 END AS "
    "INTEGER) AS position FROM part",
)
def append_stage(spark, sf):
    new = ds.jobs(spark, sf).select(
        "job_id", F.when(F.col("job_id") % 6 == 0, 77).alias("position")
    )
    return crm.append_stage(new, ds.stages(spark, sf)).select("job_id", "position")


@register("stage_order", f"WITH {o.STAGES} SELECT job_id, stage_id, position FROM stages")
def stage_order(spark, sf):
    return crm.stage_order(ds.stages(spark, sf)).select("job_id", "stage_id", "position")


@register(
    "delete_stage_reassign",
    f"WITH {o.STAGES}, {o.PLACE}, fate AS (SELECT s.stage_id, s.job_id, (SELECT first(t.stage_id "
    "ORDER BY t.position, t.stage_id) FROM stages t WHERE t.job_id = s.job_id AND t.stage_id <> "
    "s.stage_id) AS target FROM stages s WHERE s.stage_id % 10 = 0) SELECT placement_id, "
    "CAST(coalesce(f.target, p.stage_id) AS VARCHAR) AS stage_id FROM place p LEFT JOIN fate f "
    "ON f.stage_id = p.stage_id",
)
def delete_stage_reassign(spark, sf):
    stages = ds.stages(spark, sf)
    gone = stages.filter(F.col("stage_id") % 10 == 0).select("stage_id")
    _, moved = crm.delete_stage_reassign(stages, ds.placements(spark, sf), gone)
    return moved.select("placement_id", F.col("stage_id").cast("string"))


@register(
    "unique_pair",
    f"WITH {o.REQUESTS} SELECT row_no, CASE WHEN row_number() OVER (PARTITION BY job_id, candidate_id "
    "ORDER BY row_no) = 1 AND (job_id * 31 + candidate_id) % 5 <> 0 THEN 'created' ELSE 'duplicate' END "
    "AS disposition FROM reqs",
)
def unique_pair(spark, sf):
    requests = ds.pair_requests(spark, sf)
    have = ds.pairs(spark, sf).filter((F.col("job_id") * 31 + F.col("candidate_id")) % 5 == 0)
    return crm.unique_pair(requests, have).select("row_no", "disposition")


# ================================================================ imports

_IMPORT = f"""WITH {o.CAND}, rows AS (
  SELECT o_orderkey AS row_no, {o.user_of('o_custkey')} AS user_id, {o.org_of('o_orderkey')} AS org_id,
         CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'P ' || CAST(o_custkey AS VARCHAR) END AS name,
         CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'hot@example.org' ELSE
           lower('CUST' || CAST(o_custkey % 700 AS VARCHAR) || '@example.org') END AS email FROM orders),
plan AS (SELECT row_no, user_id, CASE WHEN name = '' THEN 'invalid' WHEN email = '' THEN 'created'
  WHEN EXISTS (SELECT 1 FROM cand c WHERE (c.user_id = rows.user_id OR c.org_id = rows.org_id)
      AND lower(c.email) = rows.email)
    OR row_number() OVER (PARTITION BY user_id, org_id, email, name = '' ORDER BY row_no) > 1 THEN 'skipped'
  ELSE 'created' END AS disposition FROM rows)"""


def _candidate_plan(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    email = (
        F.when(k % 5 == 0, "  ")
        .when(k % 3 == 0, "Hot@example.org ")
        .otherwise(F.concat(F.lit("CUST"), (c % 700).cast("string"), F.lit("@Example.org")))
    )
    rows = ds.table(spark, sf, "orders").select(
        k.alias("row_no"),
        ds.user_of(c).alias("user_id"),
        ds.org_of(k).alias("org_id"),
        F.lit("").alias("full_name"),
        F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" P "), c.cast("string"))).alias("name"),
        email.alias("email"),
        F.col("o_orderpriority").alias("role"),
    )
    return imports.plan_candidates(rows, ds.candidates(spark, sf))


@register("import_candidates_plan", f"{_IMPORT} SELECT row_no, disposition FROM plan")
def import_candidates_plan(spark, sf):
    return _candidate_plan(spark, sf).select("row_no", "disposition")


@register(
    "import_counts",
    f"{_IMPORT} SELECT user_id, count(*) FILTER (disposition = 'created') AS created, "
    "count(*) FILTER (disposition = 'skipped') AS skipped, count(*) FILTER (disposition = 'invalid') "
    "AS invalid FROM plan GROUP BY 1",
)
def import_counts(spark, sf):
    return imports.import_counts(_candidate_plan(spark, sf), "user_id")


@register(
    "import_jobs_plan",
    f"WITH {o.JOBS}, rows AS (SELECT p_partkey AS row_no, {o.user_of('p_size')} AS user_id, "
    f"{o.org_of('p_partkey + 1')} AS org_id, "
    "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 10 <> 0 THEN "
    "p_brand ELSE '' END AS client FROM part) SELECT row_no, CASE WHEN title = '' THEN 'invalid' WHEN "
    "EXISTS (SELECT 1 FROM jobs j WHERE (j.user_id = rows.user_id OR j.org_id = rows.org_id) AND lower(j.title) = lower(rows.title) "
    "AND lower(coalesce(j.client_name, '')) = lower(client)) OR row_number() OVER (PARTITION BY user_id, org_id, "
    "lower(title), lower(client) ORDER BY row_no) > 1 THEN 'skipped' ELSE 'created' END AS disposition, "
    "CAST(CASE WHEN row_no % 2 = 0 THEN 60 ELSE 2 END AS INTEGER) AS n_skills FROM rows",
)
def import_jobs_plan(spark, sf):
    k = F.col("p_partkey")
    rows = ds.table(spark, sf, "part").select(
        k.alias("row_no"),
        ds.user_of(F.col("p_size")).alias("user_id"),
        ds.org_of(k + 1).alias("org_id"),
        F.when(k % 17 != 0, F.concat(F.upper("p_name"), F.lit(" "))).alias("job_title"),
        F.when(k % 10 != 0, F.upper("p_brand")).alias("client"),
        F.when(k % 2 == 0, F.repeat(F.lit("sql,"), F.lit(60))).otherwise("python, go,").alias(
            "skills"
        ),
    )
    plan = imports.plan_jobs(rows, ds.jobs(spark, sf))
    return plan.select("row_no", "disposition", F.size("required_skills").alias("n_skills"))


# ================================================================ billing


@register(
    "active_subscriptions",
    f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_custkey % 7 <> 0 AND "
    f"TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INTEGER)) > {AS_OF_SQL}",
)
def active_subscriptions(spark, sf):
    return billing.active_subscriptions(_subs(spark, sf), as_of()).select(
        F.col("user_id").cast("long")
    )


def _subs(spark, sf):
    k = F.col("c_custkey")
    ends = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((k % 30).cast("int"))
    return ds.table(spark, sf, "customer").select(
        k.cast("string").alias("user_id"),
        ds.pick(k, {0: "active", 1: "trialing", 2: "past_due", 3: "canceled"}).alias("status"),
        F.when(k % 7 != 0, ends).alias("current_period_end"),
    )


@register(
    "scans_used",
    f"WITH {o.USAGE} SELECT user_id, count(*) AS scans_used FROM usage WHERE kind = 'scan' AND ts >= "
    f"date_trunc('month', {AS_OF_SQL}) GROUP BY 1",
)
def scans_used(spark, sf):
    made = ds.usage_events(spark, sf).filter("kind = 'scan'").withColumnRenamed("ts", "created_at")
    return billing.scans_used(made, as_of())


_MONTHLY = (
    f"WITH {o.USAGE} SELECT user_id, strftime(ts, '%Y-%m') AS period, "
    "count(*) FILTER (kind = 'scan') AS scans, count(*) FILTER (kind = 'assessment') AS assessments "
    "FROM usage GROUP BY 1, 2"
)


@register("monthly_usage", _MONTHLY)
def monthly_usage(spark, sf):
    return billing.monthly_usage(ds.usage_events(spark, sf)).select(
        "user_id", "period", F.col("count").alias("scans"),
        F.col("assessments_used").alias("assessments"),
    )


@register(
    "quota_admission",
    f"WITH {o.USAGE} SELECT event_id, (CAST(user_id AS BIGINT) % 6 = 0 OR row_number() OVER (PARTITION BY "
    "user_id, strftime(ts, '%Y-%m'), kind ORDER BY ts, event_id) <= CASE kind WHEN 'scan' THEN 10 ELSE 5 "
    "END) AS admitted FROM usage",
)
def quota_admission(spark, sf):
    pro = ds.table(spark, sf, "events").filter(F.col("user_id") % 6 == 0).select(
        F.col("user_id").cast("string").alias("user_id")
    )
    return billing.quota_admission(ds.usage_events(spark, sf), pro).select("event_id", "admitted")


@register(
    "effective_plan",
    f"""WITH {o.USAGE}, u AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS user_id FROM customer),
own AS (SELECT *, k % 4 IN (0, 1) AND k % 7 <> 0 AND TIMESTAMP '2024-01-01' +
        to_days(CAST(k % 30 AS INTEGER)) > {AS_OF_SQL} AS is_own, k % 5 <> 0 AND k % 3 = 0 AS is_org FROM u),
m AS (SELECT user_id, count(*) FILTER (kind = 'scan') AS s FROM usage
      WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1)
SELECT own.user_id, CASE WHEN is_own OR is_org THEN 'pro' ELSE 'free' END AS plan,
       (is_org AND NOT is_own) AS via_org, coalesce(m.s, 0) AS scans_used
FROM own LEFT JOIN m USING (user_id)""",
)
def effective_plan(spark, sf):
    k = F.col("c_custkey")
    users = ds.table(spark, sf, "customer").select(
        k.cast("string").alias("user_id"), ds.org_of(k).alias("org_id")
    )
    org = users.select("org_id").filter(F.col("org_id") == "o0").distinct().select(
        "org_id", F.lit("active").alias("status"),
        F.to_timestamp(F.lit("2025-01-01")).alias("current_period_end"),
    )
    usage = billing.monthly_usage(ds.usage_events(spark, sf))
    plan = billing.effective_plan(users, _subs(spark, sf), org, usage, as_of())
    return plan.select("user_id", "plan", "via_org", "scans_used")


def _billing_rows(spark, sf):
    """Payloads are parsed once; what the replay reads of them is written and meets the first arrivals."""
    valid = tables.parse_events(ds.billing_payloads(spark, sf)).filter("is_valid")
    fields = materialise(billing.billing_fields(valid), "billing-fields")
    return billing.only_billing(billing.dedupe_events(fields))


@register(
    "dedupe_events",
    "SELECT min(event_id) AS arrival_no FROM events WHERE event_id % 101 <> 0 "
    "GROUP BY CAST(floor(event_id / 10.0 * 9) AS BIGINT)",
)
def dedupe_events(spark, sf):
    valid = tables.parse_events(ds.billing_payloads(spark, sf)).filter("is_valid")
    return billing.dedupe_events(valid).select("arrival_no")


# Event by event: ``walk`` is a dictionary of accounts and of the events decided so far.
_WALK = """
WITH RECURSIVE arrived AS (
  SELECT min(event_id) AS e FROM events WHERE event_id % 101 <> 0
  GROUP BY CAST(floor(event_id / 10.0 * 9) AS BIGINT)
), told AS MATERIALIZED (
  SELECT e, 'evt_' || CAST(floor(e / 10.0 * 9) AS BIGINT) AS event_id,
         CASE WHEN user_id % 4 = 0 THEN 'org' ELSE 'user' END AS scope, e % 7 = 2 AS hard,
         CASE WHEN user_id % 4 = 0 THEN CASE WHEN e % 6 <> 0 THEN 'o' || (user_id % 12) END
              WHEN e % 6 <> 0 OR (e % 7 = 2 AND e % 14 = 2) THEN 'u' || user_id END AS owner,
         CASE WHEN e % 29 <> 0 THEN 'cus_' || ((user_id + CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END) % 90) END AS customer,
         CASE WHEN e % 7 = 2 THEN CASE WHEN e % 2 = 0 THEN 'sub_c' || e END ELSE 'sub_' || e END AS subscription_id,
         CASE WHEN e % 7 <> 2 AND e % 31 <> 0 THEN ['active', 'trialing', 'past_due', 'canceled'][e % 4 + 1] END AS status,
         CASE WHEN e % 47 <> 0 THEN epoch_us(ts) // 1000000 - e % 5 * 200000 END AS created,
         TIMESTAMP '2024-01-10 00:00:00' + to_days(CAST(e % 40 AS INT)) AS period_end
  FROM arrived JOIN events ON e = event_id WHERE e % 7 <> 4
), able AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY e) AS no FROM told
  WHERE customer IS NOT NULL AND CASE WHEN hard THEN owner IS NOT NULL ELSE status IS NOT NULL END
), walk(scope, slot, no, owner, customer, born, last, fate, applied) USING KEY (scope, slot) AS (
  SELECT scope, 'start', 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, false
  FROM (SELECT DISTINCT scope FROM able)
  UNION
  SELECT scope, unnest(CASE WHEN applied THEN ['event ' || no, 'account ' || owner] ELSE ['event ' || no] END), no, owner,
         customer, coalesce(born, no), CASE WHEN hard OR created IS NULL THEN last ELSE created END, fate, applied
  FROM (
    SELECT *, fate = 'mapped' AND (hard OR last IS NULL OR created IS NULL OR created > last) AS applied
    FROM (
      SELECT x.scope, x.no, x.hard, x.customer, x.created, x.owner, a.born, a.last,
             CASE WHEN x.hard THEN 'mapped' WHEN x.owner IS NULL THEN 'unmappable'
                  WHEN x.holders > coalesce(CASE WHEN a.customer = x.customer THEN 1 END, 0) THEN 'collision' ELSE 'mapped' END AS fate
      FROM (
        SELECT e.scope, e.no, e.hard, e.customer, e.created,
               count(k.slot) FILTER (k.customer = e.customer) AS holders,
               CASE WHEN e.hard OR bool_or(k.owner = e.owner) THEN e.owner
                    ELSE coalesce(arg_min(k.owner, k.born) FILTER (k.customer = e.customer), e.owner) END AS owner
        FROM (SELECT scope, max(no) AS no FROM walk GROUP BY scope) w
        JOIN able e ON e.scope = w.scope AND e.no = w.no + 1
        LEFT JOIN recurring.walk k ON k.scope = e.scope AND k.slot LIKE 'account %' AND (k.owner = e.owner OR k.customer = e.customer)
        GROUP BY e.scope, e.no, e.hard, e.customer, e.created, e.owner
      ) x LEFT JOIN recurring.walk a ON a.scope = x.scope AND a.slot = 'account ' || x.owner
    )
  )
), decided AS (
  SELECT t.*, w.owner AS resolved, coalesce(w.fate, 'unmappable') AS disposition, coalesce(w.applied, false) AS applied
  FROM told t LEFT JOIN able b ON b.e = t.e LEFT JOIN walk w ON w.scope = b.scope AND w.slot = 'event ' || b.no
)
"""
_ACCOUNTS = (
    "SELECT scope, resolved AS owner, arg_max(customer, e) AS customer, "
    "arg_max(subscription_id, e) FILTER (subscription_id IS NOT NULL) AS subscription_id, "
    "coalesce(arg_max(status, e) FILTER (NOT hard), 'incomplete') AS status{} "
    "FROM decided WHERE applied GROUP BY scope, resolved"
)


@register("resolve_owner", f"{_WALK} SELECT event_id, scope, resolved, disposition FROM decided")
def resolve_owner(spark, sf):
    return billing.resolve_owner(_billing_rows(spark, sf)).select(
        "event_id", "scope", "resolved", "disposition"
    )


@register(
    "customer_collisions",
    f"{_WALK} SELECT event_id, scope, owner, customer FROM decided WHERE disposition = 'collision'",
)
def customer_collisions(spark, sf):
    return billing.customer_collisions(_billing_rows(spark, sf)).select(
        "event_id", "scope", "owner", "customer"
    )


_ARRIVALS = (
    "arr AS (SELECT event_id, user_id % 10 AS k, CASE WHEN event_id % 47 <> 0 THEN "
    "epoch_us(ts) // 1000000 - event_id % 5 * 200000 END AS created FROM events), "
    "seen AS (SELECT *, max(created) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND 1 PRECEDING) AS top FROM arr)"
)


@register(
    "applied_events",
    f"WITH {_ARRIVALS} SELECT event_id AS arrival_no, (created IS NULL OR top IS NULL OR created > top) "
    "AS applied FROM seen",
)
def applied_events(spark, sf):
    e = F.col("event_id")
    rows = ds.table(spark, sf, "events").select(
        e.alias("arrival_no"),
        (F.col("user_id") % 10).alias("k"),
        F.when(e % 47 != 0, F.unix_timestamp("ts") - (e % 5) * 200000).alias("created"),
    )
    return billing.applied_events(rows, ["k"], chunk_rows=1000).select("arrival_no", "applied")


_PERIOD_END = ", " + o.ts("arg_max(period_end, e) FILTER (NOT hard)") + " AS period_end"


@register("subscription_state", f"{_WALK} {_ACCOUNTS.format(_PERIOD_END)}")
def subscription_state(spark, sf):
    state = billing.subscription_state(billing.replay(_billing_rows(spark, sf)))
    return state.select(
        "scope", "owner", "customer", "subscription_id", "status",
        stamp(F.col("current_period_end")).alias("period_end"),
    )


# ================================================================ streams


@register(
    "stream_dedupe_events",
    "SELECT event_id, event_type FROM events",
)
def stream_dedupe_events(spark, sf):
    twice = event_stream(spark, sf).withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_n")
    out = streams.drain_to_files(streams.dedupe_events(twice, "60 days"), work_dir(spark, "out"))
    return out.select("event_id", "event_type")


@register("stream_usage", _MONTHLY)
def stream_usage(spark, sf):
    usage = ds.with_usage_columns(event_stream(spark, sf))
    days = streams.drain_changes(
        streams.usage_stream(usage), work_dir(spark, "out"), ["user_id", "day"]
    )
    return streams.months(days).select(
        "user_id", "period", F.col("count").alias("scans"),
        F.col("assessments_used").alias("assessments"),
    )


@register(
    "stream_scan",
    f"WITH {o.SCAN_CTES} SELECT doc_id, risk_level, risk_score FROM scan",
)
def stream_scan(spark, sf):
    docs = streams.read_table_stream(spark, f"{sf}/documents*.parquet", DOCUMENTS)
    scanned = streams.scan_stream(ds.with_cv_columns(docs))
    out = streams.drain_to_files(scanned, work_dir(spark, "out"))
    return out.select("doc_id", "risk_level", F.col("risk_score").cast("long"))


@register(
    "stream_high_risk_alerts",
    f"{_RISKY} SELECT candidate_id, 'High-risk CV: ' || full_name AS title FROM cand c JOIN scan s "
    "ON c.scan_id = s.doc_id WHERE s.risk_level = 'RED'",
)
def stream_high_risk_alerts(spark, sf):
    raw = streams.read_table_stream(spark, f"{sf}/customer*.parquet", CUSTOMERS)
    alerts = streams.high_risk_alerts(ds.candidate_columns(raw), ds.stored_scans(spark, sf))
    return streams.drain_to_files(alerts, work_dir(spark, "out")).select("candidate_id", "title")


@register("stream_funnel", _FUNNEL_USER)
def stream_funnel(spark, sf):
    path = work_dir(spark, "outcomes")
    made = ds.outcomes(spark, sf).select("user_id", "type")
    made.write.parquet(path)
    live = streams.read_table_stream(spark, path, "user_id string, type string", 2)
    out = streams.drain_changes(
        streams.funnel_stream(live, "user_id"), work_dir(spark, "out"), ["user_id"]
    )
    return _funnel_out(out, "user_id")


@register("stream_subscriptions", f"{_WALK} {_ACCOUNTS.format('')}")
def stream_subscriptions(spark, sf):
    payloads = ds.with_payload(event_stream(spark, sf))
    valid = tables.parse_events(payloads).filter("is_valid")
    state = streams.run_subscription_stream(billing.billing_fields(valid), work_dir(spark, "state"))
    return state.select("scope", "owner", "customer", "subscription_id", "status")
