"""Every operator as a query over the given tables, with SQL to check it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import regexes as rx
from sievework.functions import spans as sp
from sievework.functions import text as tx
from sievework.operators import crm, detect, hidden, notes, profile, prompts, redact
from sievework.plans import dataset as ds
from sievework.plans import oracles as o
from sievework.session import work_dir
from sievework.sources import files, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

def as_of():
    """A fixed "now" (a function: columns need a session)."""
    return F.to_timestamp(F.lit("2024-01-15 12:00:00"))


AS_OF_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def joined(column, sep: str = "|"):
    return F.array_join(column, sep)


def oracle_of(name: str) -> str:
    """The twin of a registered query, for another way to the same rows."""
    return ORACLES[name]


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def text_query(name: str, column: Callable, sql_expr: str, out: str = "digest") -> None:
    """One text function over whole documents, compared by digest."""
    sql = f"WITH {o.TEXT_CTES} SELECT doc_id, md5({sql_expr}) AS {out} FROM norm"

    @register(name, sql)
    def run(spark, sf):
        docs = ds.documents(spark, sf)
        return docs.select("doc_id", F.md5(column(F.col("text")).cast("binary")).alias(out))


# =============================================================== flagship


@register(
    "corpus_risk_by_source",
    f"WITH {o.SCAN_CTES} SELECT risk_level, source, count(*) AS documents, "
    "CAST(sum(n_inj) AS BIGINT) AS injections, CAST(sum(n_pii) AS BIGINT) AS pii_items "
    "FROM scan GROUP BY 1, 2",
)
def corpus_risk_by_source(spark, sf):
    scans = ds.scans(spark, sf)
    return scans.groupBy("risk_level", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("prompt_injection_findings")).alias("injections"),
        F.sum(F.size("pii_findings")).alias("pii_items"),
    )


# ================================================================ sources


@register(
    "triage_files",
    "SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'unsupported' "
    "WHEN page_id % 5 = 0 OR page_id % 5 = 3 THEN 'type_mismatch' ELSE 'ok' END AS status, "
    "'f_' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 5 IN (0, 1) THEN '.PDF' "
    "ELSE '.txt' END AS safe_name FROM pages",
)
def triage_files(spark, sf):
    k = F.col("page_id")
    pdf = k % 5 == 1
    body = F.concat(F.when(pdf | (k % 5 == 3), "%PDF-1.7\n").otherwise("plain\n"), F.col("html"))
    name = F.concat(
        F.lit("up/f "), k.cast("string"), F.when((k % 5).isin(0, 1), ".PDF").otherwise(".txt")
    )
    kind = F.when(k % 5 == 4, "image/png").when(pdf, "application/pdf").otherwise("text/plain")
    uploads = ds.table(spark, sf, "pages").select(
        "page_id", name.alias("filename"), body.cast("binary").alias("content"),
        kind.alias("content_type"),
    )
    return files.triage_files(uploads, max_bytes=lx.MAX_UPLOAD_BYTES).select("page_id", "status", "safe_name")


@register(
    "sanitise_filename",
    r"""SELECT page_id, coalesce(nullif(regexp_replace(
        list_extract(string_split(url, '/'), -1), '[^\p{L}\p{N}_.\-]', '_', 'g'), ''),
        'upload') AS safe_name FROM pages""",
)
def sanitise_filename(spark, sf):
    return ds.table(spark, sf, "pages").select(
        "page_id", tx.sanitise_filename(F.col("url")).alias("safe_name")
    )


@register(
    "decode_text",
    "SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN html || chr(65533) ELSE html END) "
    "AS digest FROM pages WHERE page_id % 7 <> 0",
)
def decode_text(spark, sf):
    k = F.col("page_id")
    content = F.when(k % 7 == 0, F.lit(" \n\t").cast("binary")).otherwise(
        F.when(k % 3 == 0, F.concat(F.col("html").cast("binary"), F.unhex(F.lit("FF"))))
        .otherwise(F.col("html").cast("binary"))
    )
    uploads = ds.table(spark, sf, "pages").select("page_id", content.alias("content"))
    return files.decode_text(uploads).select(
        "page_id", F.md5(F.col("text").cast("binary")).alias("digest")
    )


@register(
    "cap_text",
    "SELECT doc_id, least(len(text), 500) AS n, len(text) AS whole FROM documents",
)
def cap_text(spark, sf):
    """The operator is a cap: a caller's width on one side, no width on the other."""
    return ds.table(spark, sf, "documents").select(
        "doc_id", F.length(files.cap_text(F.col("text"), 500)).cast("long").alias("n"),
        F.length(files.cap_text(F.col("text"))).cast("long").alias("whole"),
    )


@register(
    "read_import_csv",
    "SELECT CAST(c_custkey AS VARCHAR) AS row_no, c_name || ', \"' || c_mktsegment || '\"' "
    "AS full_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS title FROM customer",
)
def read_import_csv(spark, sf):
    path = work_dir(spark, "csv")
    ds.table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Row_No"),
        F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('" ')).alias(
            "Full_Name"
        ),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("TITLE"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_import_csv(spark, path).select("row_no", "full_name", "title")


@register(
    "read_import_json",
    "SELECT CAST(c_custkey AS VARCHAR) AS row_no, c_name AS name FROM customer",
)
def read_import_json(spark, sf):
    path = work_dir(spark, "json")
    ds.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_no"), F.col("c_name").alias("name")
    ).write.json(path)
    return tables.read_import_json(spark, path, ["row_no", "name"])


@register("read_import_array", oracle_of("read_import_json"))
def read_import_array(spark, sf):
    """Files that each hold one array."""
    path = work_dir(spark, "json")
    rows = ds.table(spark, sf, "customer").select(F.col("c_custkey").alias("row_no"), F.col("c_name").alias("name"))
    lines = rows.select(F.floor(F.col("row_no") / 500).alias("file"), F.to_json(F.struct("row_no", "name")).alias("row"))
    arrays = lines.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return tables.read_import_json(spark, path, ["row_no", "name"], array=True)


@register(
    "load_table",
    f"WITH {o.JOBS} SELECT job_id, title, array_to_string(required_skills, '|') AS skills FROM jobs",
)
def load_table(spark, sf):
    root = work_dir(spark, "store")
    ds.jobs(spark, sf).write.parquet(f"{root}/jobs.parquet")
    return tables.load_table(spark, root, "jobs").select(
        "job_id", "title", joined("required_skills").alias("skills")
    )


@register(
    "parse_events",
    "SELECT event_id AS arrival_no, CASE WHEN event_id % 101 <> 0 THEN 'evt_' || "
    "CAST(CAST(floor(event_id / 10.0 * 9) AS BIGINT) AS VARCHAR) END AS event_id, "
    "event_id % 101 <> 0 AS is_valid, CASE WHEN event_id % 47 <> 0 THEN "
    "strftime(date_trunc('second', ts) - to_seconds(CAST(event_id % 5 * 200000 AS INT)), "
    "'%Y-%m-%d %H:%M:%S') END AS created FROM events",
)
def parse_events(spark, sf):
    parsed = tables.parse_events(ds.billing_payloads(spark, sf))
    return parsed.select(
        "arrival_no", "event_id", "is_valid", stamp(F.col("created")).alias("created")
    )


@register(
    "rejected_events",
    "SELECT event_id AS arrival_no, CASE event_id % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'empty' "
    "ELSE 'no id' END AS reason, (SELECT count(*) FROM events WHERE event_id % 101 <> 0) AS accepted "
    "FROM events WHERE event_id % 101 = 0",
)
def rejected_events(spark, sf):
    """Events without an id, some of them cut off or empty, put aside with the reason."""
    e = F.col("arrival_no")
    cut = F.when(e % 5 == 1, F.expr("left(payload, length(payload) - 9)")).when(e % 5 == 2, "")
    raw = ds.billing_payloads(spark, sf).withColumn(
        "payload", F.when(e % 101 == 0, cut.otherwise(F.col("payload"))).otherwise(F.col("payload"))
    )
    _, rejected, counts = tables.route_events(raw, work_dir(spark, "events"))
    return rejected.select("arrival_no", "reason", F.lit(counts["accepted"]).cast("long").alias("accepted"))


# ================================================================== sinks


@register(
    "write_scans",
    f"WITH {o.SCAN_CTES} SELECT doc_id AS scan_id, upload_name AS filename, risk_level, "
    "risk_score FROM scan WHERE doc_id % 9 <> 0",
)
def write_scans(spark, sf):
    docs = ds.documents(spark, sf).withColumn(
        "user_id", F.when(F.col("doc_id") % 9 != 0, F.col("user_id"))
    )
    found = redact.add_safe_copy(detect.detect(detect.normalise(docs)))
    path = work_dir(spark, "scans")
    sinks.write_scans(
        found.withColumnsRenamed({"doc_id": "scan_id", "upload_name": "filename"}), path
    )
    back = spark.read.parquet(path)
    return back.select("scan_id", "filename", "risk_level", F.col("risk_score").cast("long"))


@register(
    "append_audit",
    f"WITH {o.JOBS}, {o.CAND}, {o.OUTCOMES} SELECT action, entity_id, summary FROM ("
    "SELECT 'candidate.created' AS action, CAST(candidate_id AS VARCHAR) AS entity_id, "
    "'Candidate ''' || full_name || ''' added (manual).' AS summary FROM cand UNION ALL "
    "SELECT 'share.created', CAST(job_id AS VARCHAR), "
    "'Shortlist share link created for ''' || title || '''.' FROM jobs UNION ALL "
    "SELECT 'candidates.imported', NULL, 'Imported ' || CAST(count(*) AS VARCHAR) || ' candidate(s).' "
    "FROM cand GROUP BY user_id, org_id UNION ALL "
    "SELECT 'jobs.imported', NULL, 'Imported ' || CAST(count(*) AS VARCHAR) || ' job(s).' "
    "FROM jobs GROUP BY user_id, org_id UNION ALL "
    "SELECT 'outcome.recorded', CAST(candidate_id AS VARCHAR), c.full_name || ' — ' || o.type || ' on ''' "
    "|| j.title || '''.' FROM outc o JOIN cand c USING (candidate_id) JOIN jobs j USING (job_id))",
)
def append_audit(spark, sf):
    path = work_dir(spark, "audit")
    people, jobs = ds.candidates(spark, sf), ds.jobs(spark, sf)
    sinks.append_audit(
        sinks.audit_rows(
            people, "candidate.created", F.col("candidate_id"), F.col("full_name"), F.lit("manual")
        ),
        path,
    )
    sinks.append_audit(
        sinks.audit_rows(jobs, "share.created", F.col("job_id"), F.col("title")), path
    )
    for rows, action in ((people, "candidates.imported"), (jobs, "jobs.imported")):
        imports = rows.groupBy("user_id", "org_id").agg(
            F.count(F.lit(1)).alias("n"), F.max("created_at").alias("created_at")
        )
        nobody = F.lit(None).cast("string")
        sinks.append_audit(sinks.audit_rows(imports, action, nobody, F.col("n").cast("string")), path)
    made = (
        ds.outcomes(spark, sf)
        .join(people.select("candidate_id", "full_name"), "candidate_id")
        .join(jobs.select("job_id", "title"), "job_id")
        .withColumnRenamed("occurred_at", "created_at")
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    )
    sinks.append_audit(
        sinks.audit_rows(
            made, "outcome.recorded", F.col("candidate_id"), F.col("full_name"), F.col("type"), F.col("title")
        ),
        path,
    )
    return spark.read.parquet(path).select("action", "entity_id", "summary")


_VERDICT = " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in lx.RISK_VERDICTS.items())


@register(
    "report_rows",
    f"WITH {o.SCAN_CTES} SELECT doc_id AS scan_id, CASE risk_level {_VERDICT} END AS verdict, "
    "CAST(risk_score AS VARCHAR) || '/100' AS risk_score, n_inj AS hidden_instructions, "
    "printf('%.2f', ai_score) AS ai_score FROM scan",
)
def report_rows(spark, sf):
    made = sinks.report_rows(ds.scans(spark, sf))
    schema = (
        "verdict string, risk_score string, hidden_instructions array<struct<pattern_id:string>>, "
        "ai_score string"
    )
    r = F.from_json("report", schema)
    return made.select("scan_id", r.alias("r")).select(
        "scan_id", "r.verdict", "r.risk_score",
        F.size("r.hidden_instructions").cast("long").alias("hidden_instructions"), "r.ai_score",
    )


@register(
    "shortlist_report",
    f"WITH {o.SCAN_CTES}, {o.CAND}, {o.JOBS}, {o.PAIRS}, {o.SHORT} "
    "SELECT j.job_id, j.title AS job_title, j.client_name, x.full_name, x.headline, x.status, x.risk "
    "FROM jobs j LEFT JOIN (SELECT l.job_id, c.full_name, coalesce(c.headline, '—') AS headline, "
    "upper(left(c.status, 1)) || substr(c.status, 2) AS status, "
    "coalesce(s.risk_level || ' (' || CAST(s.risk_score AS VARCHAR) || '/100)', '—') AS risk "
    "FROM shortl l JOIN cand c USING (candidate_id) LEFT JOIN scan s ON c.scan_id = s.doc_id) x "
    "USING (job_id)",
)
def shortlist_report(spark, sf):
    cards = crm.shortlist_cards(
        ds.shortlist(spark, sf), ds.candidates(spark, sf), ds.scans(spark, sf)
    )
    return sinks.shortlist_report(ds.jobs(spark, sf), cards).select(
        "job_id", "job_title", "client_name", "full_name", "headline", "status", "risk"
    )


# ========================================================= text functions

text_query("strip_invisible", tx.strip_invisible, "stripped")
text_query(
    "nfkc", lambda t: tx.nfkc(F.concat(t, F.lit("ﬁ Ａ①"))), "text || 'fi A1'"
)
text_query(
    "fold_lookalikes",
    tx.fold_lookalikes,
    f"translate(text, {o.q(o.FOLD_FROM)}, {o.q(o.FOLD_TO)})",
)
text_query(
    "strip_think",
    lambda t: tx.strip_think(
        F.concat(F.lit(" <THINK>\n"), t, F.lit("</think> ok <think>"), t, F.lit("</Think>"), t)
    ),
    "regexp_replace('ok ' || text, '\\s+$', '')",
)
text_query(
    "word_count", lambda t: tx.word_count(t).cast("string"),
    r"CAST(len(regexp_extract_all(text, '\S+')) AS VARCHAR)",
)
_STOPS = o.arr(lx.SEARCH_STOP_WORDS)
text_query(
    "search_tokens",
    lambda t: joined(F.array_sort(tx.search_tokens(t))),
    "array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), "
    f"'{lx.SEARCH_TOKEN}')), lambda x: len(x) > 1 AND NOT list_contains({_STOPS}, x))), '|')",
)
text_query(
    "split_sentences",
    lambda t: joined(tx.split_sentences(t)),
    r"array_to_string(list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), "
    r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|')",
)


# No SQL twin: undecodable bytes are dropped, which SQL cannot express; tested against Python.
@register("decode_base64_tokens")
def decode_base64_tokens(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf))
    return docs.select("doc_id", F.explode("decoded").alias("decoded"))


@register(
    "escape_markup",
    "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) "
    "AS digest FROM pages",
)
def escape_markup(spark, sf):
    return ds.table(spark, sf, "pages").select(
        "page_id", F.md5(tx.escape_markup(F.col("html")).cast("binary")).alias("digest")
    )


@register(
    "clean_cells",
    "SELECT c_custkey, left(c_name, 10) AS name, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' "
    "ELSE c_mktsegment END, '') AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END "
    "AS first_given FROM customer",
)
def clean_cells(spark, sf):
    k = F.col("c_custkey")
    blank = F.when(k % 3 == 0, "  \t ").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    return ds.table(spark, sf, "customer").select(
        "c_custkey",
        tx.clean_cell(F.concat(F.lit(" "), F.col("c_name")), 10).alias("name"),
        tx.clean_cell(blank).alias("segment"),
        # A blank alias made of white space is chosen, then cleaned away.
        tx.clean_cell(
            tx.first_alias(F.when(k % 4 == 0, "  ").otherwise(F.lit("")), F.col("c_name"))
        ).alias("first_given"),
    )


@register(
    "skill_parts",
    f"WITH {o.JOBS} SELECT job_id, skill, array_to_string(list_sort(list_distinct(list_append("
    r"list_filter(string_split_regex(skill, '[.\s/,]+'), lambda x: x <> ''), skill))), '|') AS parts "
    "FROM (SELECT job_id, unnest(list_transform(required_skills, lambda s: lower(trim(s)))) AS skill "
    "FROM jobs)",
)
def skill_parts(spark, sf):
    norm = ds.jobs(spark, sf).select(
        "job_id", F.explode(F.transform("required_skills", tx.normalise_skill)).alias("skill")
    )
    return norm.select(
        "job_id", "skill", joined(F.array_sort(tx.skill_parts(F.col("skill")))).alias("parts")
    )


@register(
    "split_join_skills",
    "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ', ') AS skills FROM part",
)
def split_join_skills(spark, sf):
    listed = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(", ,"))
    return ds.table(spark, sf, "part").select(
        "p_partkey", tx.join_skills(tx.split_skills(listed)).alias("skills")
    )


@register(
    "names_and_titles",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'there' ELSE "
    "string_split(p_name, ' ')[1] END AS first_name, CASE WHEN p_partkey % 5 = 0 THEN "
    "'Unnamed candidate' ELSE p_name || '.v1' END AS stem, "
    "regexp_replace(p_brand || ': ' || p_name, '[^A-Za-z0-9 _-]', '', 'g') AS safe_title "
    "FROM part",
)
def names_and_titles(spark, sf):
    name = F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name"))
    upload = F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(
        F.concat(F.col("p_name"), F.lit(".v1.txt"))
    )
    return ds.table(spark, sf, "part").select(
        "p_partkey",
        tx.first_name(F.concat(F.lit(" "), name)).alias("first_name"),
        tx.filename_stem(upload).alias("stem"),
        tx.safe_title(F.concat(F.col("p_brand"), F.lit(": "), F.col("p_name"))).alias("safe_title"),
    )


_LABEL = " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in lx.PATTERN_LABELS.items())
_AI_TEXT = " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in lx.AI_LABEL_TEXT.items())


@register(
    "finding_labels",
    f"WITH {o.INJ_CTES} SELECT CASE kind {_LABEL} END AS label, count(*) AS n FROM inj GROUP BY 1",
)
def finding_labels(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf))
    found = docs.select(F.explode(detect.injections_in("normalised", "families")).alias("f"))
    return found.groupBy(tx.label_of(F.col("f.pattern_id"), lx.PATTERN_LABELS).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "ai_label_text",
    f"WITH {o.SCAN_CTES} SELECT doc_id, CASE ai_label {_AI_TEXT} END AS label FROM scan",
)
def ai_label_text(spark, sf):
    return ds.scans(spark, sf).select(
        F.col("scan_id").alias("doc_id"),
        tx.label_of(F.col("ai_text_likelihood"), lx.AI_LABEL_TEXT).alias("label"),
    )


@register(
    "iso_timestamp",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 "
    "THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events",
)
def iso_timestamp(spark, sf):
    return ds.table(spark, sf, "events").select(
        "event_id", tx.iso_timestamp(F.col("ts")).alias("iso")
    )


@register(
    "expiry_from_days",
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(ts + "
    "to_days(CAST(event_id % 365 + 1 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS expires FROM events",
)
def expiry_from_days(spark, sf):
    days = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 365 + 1).cast("int"))
    return ds.table(spark, sf, "events").select(
        "event_id", stamp(tx.expiry(F.col("ts"), days)).alias("expires")
    )


# ============================================================== detection


@register(
    "find_spans",
    f"WITH {o.DOCS}, "
    + o.spans("sp", "docs", "doc_id", "text", [("digits", "[0-9]+")])
    + " SELECT doc_id, s, e, m FROM sp",
)
def find_spans(spark, sf):
    spans = ds.documents(spark, sf).select(
        "doc_id", F.explode(sp.find_spans("text", "[0-9]+")).alias("x")
    )
    return spans.select(
        "doc_id", F.col("x.start").cast("long").alias("s"), F.col("x.end").cast("long").alias("e"),
        F.col("x.match").alias("m"),
    )


def _context_sql(s: str, e: str) -> str:
    left = f"greatest({s} - 30, 0)"
    piece = f"substr(normalised, {left} + 1, {e} + 30 - {left})"
    return f"'...' || replace({piece}, chr(10), ' ') || '...'"


def _register_family(family: str, body: str) -> None:
    spans = o.spans("inj", "norm", "doc_id", "normalised", [(family, "(?i)" + body)])
    sql = (
        f"WITH {o.TEXT_CTES}, {spans} SELECT doc_id, kind AS pattern_id, m AS matched_text, "
        f"{_context_sql('s', 'e')} AS context FROM inj JOIN norm USING (doc_id)"
    )

    @register(f"injection_family_{family[-1].lower()}", sql)
    def run(spark, sf):
        docs = detect.normalise(ds.documents(spark, sf))
        found = docs.select(
            "doc_id", F.explode(detect.family_findings("normalised", family)).alias("f")
        )
        return found.select("doc_id", "f.*")


for _family, _body in lx.INJECTION_FAMILIES:
    _register_family(_family, _body)


@register(
    "scan_injections",
    f"WITH {o.INJ_CTES} SELECT doc_id, string_agg(kind || '=' || m, '|' ORDER BY prio, s) "
    "AS findings FROM inj GROUP BY 1",
)
def scan_injections(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf)).withColumn(
        "f", detect.injections_in("normalised", "families")
    )
    listed = F.transform("f", lambda x: F.concat(x["pattern_id"], F.lit("="), x["matched_text"]))
    return docs.filter(F.size("families") > 0).select("doc_id", joined(listed).alias("findings"))


@register(
    "scan_base64_injections",
    f"WITH {o.B64_CTES} SELECT doc_id, kind AS pattern_id, '[base64] ' || m AS matched_text, "
    "'Decoded from base64: ' || decoded AS context FROM b64inj",
)
def scan_base64_injections(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf))
    found = docs.select(
        "doc_id", F.explode(detect.base64_injections("decoded", "decoded_norm")).alias("f")
    )
    return found.select("doc_id", "f.*")


def _register_pii(kind: str, pattern: str) -> None:
    spans = o.spans("pii", "norm", "doc_id", "stripped", [(kind, pattern)])
    sql = f"WITH {o.TEXT_CTES}, {spans} SELECT doc_id, s, e, m FROM pii"

    @register(f"pii_{kind}", sql)
    def run(spark, sf):
        docs = ds.documents(spark, sf).withColumn("stripped", tx.strip_invisible(F.col("text")))
        found = docs.select(
            "doc_id", F.explode(sp.find_spans("stripped", dict(rx.PII)[kind])).alias("x")
        )
        return found.select(
            "doc_id", F.col("x.start").cast("long").alias("s"),
            F.col("x.end").cast("long").alias("e"), F.col("x.match").alias("m"),
        )


for _kind, _pattern in o.PII_PATTERNS:
    _register_pii(_kind, _pattern)


@register(
    "suppress_overlaps",
    f"WITH {o.PII_CTES} SELECT doc_id, kind AS pii_type, s, e, m FROM {o.LAST}",
)
def suppress_overlaps(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf)).withColumn(
        "digits", rx.has_digit(F.col("stripped"))
    ).withColumn("kinds", rx.pii_present("stripped", "lowered", "digits"))
    found = docs.select("doc_id", F.explode(detect.pii_spans("stripped", "kinds")).alias("x"))
    return found.select(
        "doc_id", "x.pii_type", F.col("x.start").cast("long").alias("s"),
        F.col("x.end").cast("long").alias("e"), F.col("x.matched_text").alias("m"),
    )


@register(
    "first_pii",
    f"WITH {o.PII_CTES} SELECT doc_id, min_by(m, s) AS email FROM {o.LAST} "
    "WHERE kind = 'email' GROUP BY 1",
)
def first_pii(spark, sf):
    return ds.scans(spark, sf).select(
        F.col("scan_id").alias("doc_id"),
        detect.first_pii(F.col("pii_findings"), "email").alias("email"),
    ).filter(F.col("email").isNotNull())


@register(
    "ai_text_score",
    f"WITH {o.SCAN_CTES} SELECT doc_id, CAST(round(ai_score * 10) AS BIGINT) AS tenths, "
    "ai_label FROM scan",
)
def ai_text_score(spark, sf):
    return ds.scans(spark, sf).select(
        F.col("scan_id").alias("doc_id"),
        F.round(F.col("ai_text_score") * 10).cast("long").alias("tenths"),
        F.col("ai_text_likelihood").alias("ai_label"),
    )


@register(
    "risk_score",
    f"WITH {o.SCAN_CTES} SELECT doc_id, risk_score, risk_level FROM scan",
)
def risk_score(spark, sf):
    return ds.scans(spark, sf).select(
        F.col("scan_id").alias("doc_id"), F.col("risk_score").cast("long"), "risk_level"
    )


@register(
    "scan_summary",
    f"WITH {o.SCAN_CTES} SELECT doc_id, coalesce(nullif(concat_ws(' ', CASE WHEN n_inj > 0 THEN "
    "CAST(n_inj AS VARCHAR) || ' hidden instruction(s) found — do not paste this CV into an AI "
    "tool.' END, CASE WHEN n_pii > 0 THEN CAST(n_pii AS VARCHAR) || ' personal data item(s) "
    "flagged.' END, CASE WHEN ai_label <> 'UNLIKELY' THEN 'Text ' || lower(ai_label) || "
    "' written by AI.' END), ''), 'No issues detected. CV appears safe for AI workflow use.') "
    "AS summary FROM scan",
)
def scan_summary(spark, sf):
    return ds.scans(spark, sf).select(F.col("scan_id").alias("doc_id"), "summary")


@register(
    "rank_findings",
    f"WITH {o.INJ_CTES} SELECT doc_id, string_agg(kind, '|' ORDER BY len(m) DESC, prio, s) "
    "AS ranked FROM inj GROUP BY 1",
)
def rank_findings(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf)).withColumn(
        "f", detect.injections_in("normalised", "families")
    )
    ranked = F.transform(detect.rank_findings(F.col("f")), lambda x: x["pattern_id"])
    return docs.filter(F.size("families") > 0).select("doc_id", joined(ranked).alias("ranked"))


@register(
    "finding_counts",
    f"WITH {o.SCAN_CTES} SELECT doc_id, n_inj AS injection_count, n_pii AS pii_count, "
    "(risk_level = 'GREEN' AND n_inj = 0 AND n_pii = 0 AND ai_label = 'UNLIKELY') AS all_clear "
    "FROM scan",
)
def finding_counts(spark, sf):
    return detect.finding_counts(ds.scans(spark, sf)).select(
        F.col("scan_id").alias("doc_id"), F.col("injection_count").cast("long"),
        F.col("pii_count").cast("long"), "all_clear",
    )


# ============================================================== redaction

_R = o.q(lx.REMOVED_LINE)
_TAGGED = "cleaned"
for _k, _p in o.PII_PATTERNS:
    _TAGGED = f"regexp_replace({_TAGGED}, {o.q(_p)}, '[PII:{_k.upper()}]', 'g')"
_LINES = f"""ln AS MATERIALIZED (
  SELECT doc_id, i, line, CAST(coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ls
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(normalised, chr(10)) AS l FROM norm))),
cut AS MATERIALIZED (
  SELECT doc_id, i, CASE WHEN EXISTS (SELECT 1 FROM inj WHERE inj.doc_id = ln.doc_id
         AND ls <= inj.e AND ls + len(line) >= inj.s) THEN {_R} ELSE line END AS line FROM ln),
col AS MATERIALIZED (
  SELECT doc_id, i, line FROM cut
  QUALIFY NOT (line = {_R} AND coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY i), '') = {_R})),
swept AS MATERIALIZED (
  SELECT doc_id, string_agg(CASE WHEN regexp_matches(line, {o.q(o.ANY_INJ)}) THEN {_R} ELSE line END,
         chr(10) ORDER BY i) AS cleaned FROM col GROUP BY 1)"""
_SAFE = f"{o.INJ_CTES}, {_LINES}"


@register(
    "remove_injected_lines",
    f"WITH {_SAFE} SELECT doc_id, count(*) FILTER (line = {_R}) AS removed, count(*) AS n_lines, "
    "md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM cut GROUP BY 1",
)
def remove_injected_lines(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf))
    lines = redact.remove_injected_lines("normalised", "families")
    staged = docs.select("doc_id", lines.alias("lines"))
    return staged.select(
        "doc_id",
        F.size(F.filter("lines", lambda x: x == lx.REMOVED_LINE)).cast("long").alias("removed"),
        F.size("lines").cast("long").alias("n_lines"),
        F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest"),
    )


@register(
    "collapse_and_sweep_lines",
    f"WITH {_SAFE} SELECT doc_id, md5(cleaned) AS digest FROM swept",
)
def collapse_and_sweep_lines(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf))
    staged = docs.select(
        "doc_id", redact.remove_injected_lines("normalised", "families").alias("lines")
    )
    swept = redact.sweep_lines(redact.collapse_markers(F.col("lines")))
    return staged.select("doc_id", F.md5(joined(swept, "\n").cast("binary")).alias("digest"))


@register(
    "annotate_pii",
    f"WITH {o.TEXT_CTES} SELECT doc_id, md5(regexp_replace({_TAGGED}, '^\\s+|\\s+$', '', 'g')) "
    "AS digest FROM (SELECT doc_id, normalised AS cleaned FROM norm)",
)
def annotate_pii(spark, sf):
    docs = detect.normalise(ds.documents(spark, sf))
    return docs.select(
        "doc_id", F.md5(redact.annotate_pii(F.col("normalised")).cast("binary")).alias("digest")
    )


@register(
    "safe_copy",
    f"WITH {_SAFE} SELECT doc_id, md5(regexp_replace({_TAGGED}, '^\\s+|\\s+$', '', 'g')) AS digest "
    "FROM swept",
)
def safe_copy(spark, sf):
    copies = redact.add_safe_copy(detect.normalise(ds.documents(spark, sf)))
    return copies.select("doc_id", F.md5(F.col("safe_copy_text").cast("binary")).alias("digest"))


@register("scan_corpus")
def scan_corpus(spark, sf):
    found = redact.add_safe_copy(detect.detect(detect.normalise(ds.documents(spark, sf))))
    full = profile.analyse_corpus(found.drop(*detect.WORK_COLUMNS))
    return full.select(
        "doc_id", "risk_level", F.col("risk_score").cast("long"), "summary",
        F.length("safe_copy_text").cast("long").alias("safe_chars"),
        F.col("match_analysis.summary").alias("candidate_summary"),
        F.col("match_analysis.completeness.score").cast("long").alias("completeness"),
    )


@register(
    "hidden_surfaces",
    "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'PR-01-A|PR-01-H' WHEN 1 THEN 'PR-01-B' "
    "WHEN 2 THEN 'PR-01-G' WHEN 3 THEN 'PR-01-F' ELSE '' END AS families FROM pages",
)
def hidden_surfaces(spark, sf):
    shown = hidden.hidden_surfaces(ds.pages(spark, sf))
    found = detect.normalise(shown.select("page_id", "text"))  # visible and hidden text together
    return found.select("page_id", joined("families").alias("families"))


@register(
    "nested_hidden_surfaces",
    "SELECT page_id, CASE page_id % 6 WHEN 1 THEN '' WHEN 3 THEN 'a' ELSE url END AS hidden_text FROM pages",
)
def nested_hidden_surfaces(spark, sf):
    return hidden.hidden_surfaces(ds.nested_pages(spark, sf)).select("page_id", "hidden_text")


# ================================================================ profile


@register("extract_skills", f"WITH {o.SKILLS} SELECT doc_id, category, skill FROM dskills")
def extract_skills(spark, sf):
    return profile.doc_skills(ds.skills_of_documents(spark, sf), "doc_id")


def _facts(spark, sf):
    return profile.extract_facts(ds.documents(spark, sf))


@register(
    "year_claims",
    f"WITH {o.DOCS}, {o.YEARS} SELECT doc_id, list_max(ys) AS max_years, "
    "array_to_string(list_sort(list_distinct(ys)), '|') AS distinct_years FROM years "
    "WHERE len(ys) > 0",
)
def year_claims(spark, sf):
    docs = ds.documents(spark, sf).withColumn("ys", profile.year_claims(F.col("text")))
    return docs.filter(F.size("ys") > 0).select(
        "doc_id", profile.max_years(F.col("ys")).alias("max_years"),
        joined(F.array_sort(F.array_distinct("ys")).cast("array<string>")).alias("distinct_years"),
    )


@register(
    "seniority_score", f"WITH {o.DOCS}, {o.YEARS} SELECT doc_id, seniority FROM years"
)
def seniority_score(spark, sf):
    docs = ds.documents(spark, sf).withColumn("low", F.lower("text"))
    return docs.select("doc_id", profile.seniority_score("low").alias("seniority"))


@register(
    "experience_tier",
    f"WITH {o.DOCS}, {o.YEARS}, {o.TIER} SELECT doc_id, tier, CASE WHEN coalesce(max_years, 0) >= 10 "
    "THEN 'Principal / Lead' WHEN max_years >= 5 THEN 'Senior' WHEN max_years >= 2 THEN 'Mid-level' "
    "ELSE 'Entry' END AS by_years FROM tier",
)
def experience_tier(spark, sf):
    return _facts(spark, sf).select(
        "doc_id", F.col("experience_tier").alias("tier"),
        profile.years_to_tier(F.col("years_experience")).alias("by_years"),
    )


@register(
    "education_section",
    f"WITH {o.DOCS}, {o.EDU} SELECT doc_id, section FROM edu WHERE section IS NOT NULL",
)
def education_section(spark, sf):
    docs = ds.documents(spark, sf)
    found = docs.select("doc_id", profile.education_section(F.col("text")).alias("section"))
    return found.filter(F.col("section").isNotNull())


@register("education_level", f"WITH {o.DOCS}, {o.EDU} SELECT doc_id, level FROM edu")
def education_level(spark, sf):
    return _facts(spark, sf).select("doc_id", F.col("education_level").alias("level"))


@register("key_claims", f"WITH {o.DOCS}, {o.CLAIMS} SELECT doc_id, pos, c AS claim FROM claims")
def key_claims(spark, sf):
    docs = profile.add_key_claims(ds.documents(spark, sf).select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode("key_claims").alias("pos", "claim")).withColumn(
        "pos", (F.col("pos") + 1).cast("long")
    )


@register(
    "completeness",
    f"WITH {o.DOCS}, {o.COMPLETE} SELECT doc_id, CAST(score AS BIGINT) AS score, missing FROM comp",
)
def completeness(spark, sf):
    docs = ds.documents(spark, sf).withColumns(
        {"low": rx.fold_case(F.col("text")), "words": tx.word_count(F.col("text"))}
    )
    staged = docs.withColumn("b", profile.completeness_breakdown("text", "low", F.col("words")))
    order = [label for label, *_ in lx.COMPLETENESS]
    missing = F.filter(
        F.array(*[F.lit(x) for x in order]),
        lambda x: F.array_contains(profile.missing_signals(F.col("b")), x),
    )
    return staged.select(
        "doc_id", profile.completeness_score(F.col("b")).cast("long").alias("score"),
        joined(missing, ", ").alias("missing"),
    )


_SHORT_EDU = " ".join(f"WHEN {o.q(k)} THEN {o.q(v)}" for k, v in lx.EDUCATION_SHORT.items())
_SUMMARY = f"""WITH {o.SKILLS}, {o.YEARS}, {o.TIER}, {o.EDU}, {o.CLAIMS},
sizes AS (SELECT doc_id, c_ord, count(*) AS n FROM dskills GROUP BY 1, 2),
tops AS (SELECT doc_id, string_agg(skill, ' · ' ORDER BY r) AS top FROM (
  SELECT d.doc_id, skill, row_number() OVER (PARTITION BY d.doc_id
    ORDER BY s.n DESC, d.c_ord, d.s_ord) AS r FROM dskills d JOIN sizes s USING (doc_id, c_ord))
  WHERE r <= 3 GROUP BY 1),
nc AS (SELECT doc_id, count(*) AS n FROM claims GROUP BY 1),
ns AS (SELECT doc_id, sum(n) AS n FROM sizes GROUP BY 1)"""


@register(
    "candidate_summary",
    f"{_SUMMARY} SELECT t.doc_id, t.tier || coalesce(' ' || top || ' engineer', ' candidate') || "
    "coalesce(' (' || CAST(max_years AS VARCHAR) || 'y exp)', '') || ' | ' || "
    f"CASE level {_SHORT_EDU} END || ' | ' || CAST(coalesce(nc.n, 0) AS VARCHAR) || "
    "CASE WHEN nc.n = 1 THEN ' verifiable claim' ELSE ' verifiable claims' END AS summary "
    "FROM tier t JOIN edu USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN nc USING (doc_id)",
)
def candidate_summary(spark, sf):
    full = profile.analyse_corpus(ds.documents(spark, sf).select("doc_id", "text"))
    return full.select("doc_id", F.col("match_analysis.summary").alias("summary"))


ORACLES["scan_corpus"] = (
    f"WITH {o.SCAN_CTES}, {_LINES}, " + _SUMMARY.removeprefix("WITH ").removeprefix(o.DOCS + ",") + f", {o.COMPLETE}, "
    "risk AS (" + ORACLES["scan_summary"].removeprefix(f"WITH {o.SCAN_CTES} ") + "), people AS ("
    + ORACLES["candidate_summary"].removeprefix(f"{_SUMMARY} ") + ") SELECT s.doc_id, s.risk_level, s.risk_score, "
    f"risk.summary, CAST(len(regexp_replace({_TAGGED}, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS safe_chars, "
    "people.summary AS candidate_summary, CAST(comp.score AS BIGINT) AS completeness FROM scan s "
    "JOIN swept USING (doc_id) JOIN risk USING (doc_id) JOIN people USING (doc_id) JOIN comp USING (doc_id)"
)
_RF = lx.RED_FLAGS


@register(
    "red_flags",
    f"{_SUMMARY} SELECT t.doc_id, concat_ws('|', "
    f"CASE WHEN coalesce(ns.n, 0) >= 15 AND max_years < 3 THEN {o.q(_RF['broad'])} END, "
    f"CASE WHEN coalesce(ns.n, 0) = 0 AND max_years >= 5 THEN {o.q(_RF['unskilled'])} END, "
    f"CASE WHEN len(list_distinct(ys)) >= 2 THEN {o.q(_RF['inconsistent'])} END, "
    f"CASE WHEN {o.WORDS} < 150 THEN {o.q(_RF['short'])} END, "
    f"CASE WHEN len(list_distinct(regexp_extract_all(text, {o.q(lx.EMPLOYER)}, 1))) > 3 "
    f"AND max_years < 2 THEN {o.q(_RF['hopping'])} END) AS flags "
    "FROM tier t LEFT JOIN ns USING (doc_id)",
)
def red_flags(spark, sf):
    full = profile.analyse_corpus(ds.documents(spark, sf).select("doc_id", "text"))
    return full.select("doc_id", joined("match_analysis.red_flags").alias("flags"))


_PROBE_ROWS = ", ".join(
    f"({i * 10 + j}, {o.q(key)}, {o.q(text)})"
    for i, (key, texts) in enumerate(lx.PROBES.items())
    for j, text in enumerate(texts)
)
_GENERAL_ROWS = ", ".join(f"({i}, {o.q(t)})" for i, t in enumerate(lx.GENERAL_PROBES))


@register(
    "interview_probes",
    f"{_SUMMARY}, bank(ord, key, probe) AS (VALUES {_PROBE_ROWS}), "
    f"gen(ord, probe) AS (VALUES {_GENERAL_ROWS}), "
    "hits AS (SELECT doc_id, ord, probe FROM (SELECT DISTINCT d.doc_id, b.ord, b.probe FROM dskills d, "
    "bank b WHERE contains(replace(lower(d.skill), '.', ''), b.key)) "
    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 4), "
    "every AS (SELECT doc_id, ord, probe FROM hits UNION ALL SELECT doc_id, 1000, "
    f"CASE WHEN tier IN ('Senior', 'Principal / Lead') THEN {o.q(lx.MENTOR_PROBE)} "
    f"WHEN tier = 'Mid-level' THEN {o.q(lx.PUSHBACK_PROBE)} ELSE {o.q(lx.LEARNING_PROBE)} END FROM tier "
    "UNION ALL SELECT doc_id, 2000 + ord, probe FROM docs, gen) "
    "SELECT doc_id, string_agg(probe, '|' ORDER BY ord) AS probes FROM (SELECT * FROM every "
    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 5) GROUP BY 1",
)
def interview_probes(spark, sf):
    facts = _facts(spark, sf)
    return facts.select(
        "doc_id",
        joined(
            profile.interview_probes(F.col("skills"), F.col("experience_tier"))
        ).alias("probes"),
    )


@register(
    "headline_from_match",
    f"WITH {o.DOCS}, {o.YEARS}, {o.TIER} SELECT doc_id, CASE WHEN max_years > 0 THEN tier || ' · ' || "
    "CAST(max_years AS VARCHAR) || ' yrs experience' ELSE tier END AS headline FROM tier",
)
def headline_from_match(spark, sf):
    return _facts(spark, sf).select(
        "doc_id",
        profile.headline(F.col("experience_tier"), F.col("years_experience")).alias("headline"),
    )


@register("analyse_corpus")
def analyse_corpus(spark, sf):
    full = profile.analyse_corpus(ds.documents(spark, sf).select("doc_id", "text"), engine="other")
    return full.select("doc_id", F.to_json("match_analysis").alias("analysis"))


# Model responses derived from the document id, in every shape the reader must handle.
_RAW = {
    0: '{{"education_level": "PhD", "years_experience": {n}}}',
    1: '<think>hm</think>Here: {{"education_level": "Master\'s", "years_experience": {n}.9}} done',
    2: '{{"education_level": "Bachelor\'s", "years_experience": true}}',
    3: '{{"education_level": "Wizard", "years_experience": {n}}}',
    4: "no json {n}",
    5: '{{"education_level": "Not specified", "years_experience": null, "n": {n}}}',
    6: '{{"education_level": "High School", "years_experience": "{n}"}}',
    7: '{{"education_level": "High School", "years_experience": 1{n}0}}',
}


def _model_responses(spark, sf):
    n = F.pmod(F.col("doc_id"), F.lit(31)).cast("string")
    cases = {k: v.replace("{{", "{").replace("}}", "}") for k, v in _RAW.items()}
    text = F.replace(ds.pick(F.col("doc_id"), cases), F.lit("{n}"), n)
    return ds.table(spark, sf, "documents").select("doc_id", text.alias("raw"))


_FACTS = (
    "facts AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'PhD' WHEN 1 THEN 'Master''s' "
    "ELSE 'Not specified' END AS education_level, CASE WHEN doc_id % 8 < 2 "
    "THEN CAST(doc_id % 31 AS INTEGER) END AS years_experience FROM documents "
    "WHERE doc_id % 8 IN (0, 1, 5))"
)


@register(
    "validate_model_facts",
    f"WITH {_FACTS} SELECT doc_id, education_level, CAST(years_experience AS VARCHAR) AS years "
    "FROM facts",
)
def validate_model_facts(spark, sf):
    facts = prompts.validate_model_facts(_model_responses(spark, sf))
    return facts.select(
        "doc_id", "education_level", F.col("years_experience").cast("string").alias("years")
    )


@register(
    "merge_model_facts",
    f"WITH {o.DOCS}, {o.YEARS}, {o.TIER}, {o.EDU}, {_FACTS} SELECT t.doc_id, "
    "coalesce(f.education_level, e.level) AS education_level, CASE WHEN f.years_experience IS NULL "
    "THEN t.tier WHEN f.years_experience >= 10 THEN 'Principal / Lead' WHEN f.years_experience >= 5 "
    "THEN 'Senior' WHEN f.years_experience >= 2 THEN 'Mid-level' ELSE 'Entry' END AS tier, "
    "CASE WHEN f.doc_id IS NULL THEN 'regex' ELSE 'llm' END AS match_engine "
    "FROM tier t JOIN edu e USING (doc_id) LEFT JOIN facts f USING (doc_id)",
)
def merge_model_facts(spark, sf):
    model = prompts.validate_model_facts(_model_responses(spark, sf))
    merged = profile.merge_model_facts(_facts(spark, sf), model)
    return merged.select(
        "doc_id", "education_level", F.col("experience_tier").alias("tier"), "match_engine"
    )


@register("signals")
def signals(spark, sf):
    found = detect.scan_risk(ds.documents(spark, sf))
    full = profile.analyse_corpus(
        found.select(
            "doc_id", "text", "risk_level", "risk_score", "ai_text_likelihood",
            "prompt_injection_findings",
        )
    )
    return prompts.signals(full).select("doc_id", "signals")


def _escaped(expr: str) -> str:
    return f"replace(replace(replace({expr}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _data(tag: str, expr: str) -> str:
    return f"'<{tag}>' || chr(10) || {_escaped(expr)} || chr(10) || '</{tag}>'"


_GAP = " || chr(10) || chr(10) || "
_SIGNAL = "'{\"lang\":\"' || lang || '\"}'"
_ROLE = "CASE WHEN doc_id % 3 = 0 THEN '(none provided)' ELSE source END"


@register(
    "build_prompts",
    " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, md5(" + _GAP.join(["'Open.'", *blocks, "'Respond with JSON.'"])
        + ") AS digest FROM documents"
        for kind, blocks in (
            ("facts", [_data("cv", "text")]),
            ("assessment", [_data("signals", _SIGNAL), _data("cv", "text"), _data("role", _ROLE)]),
            ("followup", [_data("signals", _SIGNAL), _data("cv", "text"), _data("question", "source")]),
        )
    ),
)
def build_prompts(spark, sf):
    docs = ds.table(spark, sf, "documents").withColumns(
        {
            "signals": F.to_json(F.struct("lang")),
            "safe_copy_text": F.col("text"),
            "role": F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(""),
        }
    )
    made = [
        prompts.build_prompts(docs, kind, "Open.", "Respond with JSON.", ask).select(
            "doc_id", F.lit(kind).alias("kind"), F.md5(F.col("prompt").cast("binary")).alias("digest")
        )
        for kind, ask in (("facts", None), ("assessment", "role"), ("followup", "source"))
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@register(
    "parse_assessments",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Doc ' || CAST(doc_id AS VARCHAR) END "
    "AS headline, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 101 END AS INTEGER) "
    "AS overall_score, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'call|' || source END AS next_steps, "
    "'Candidate assessment' AS framework FROM documents",
)
def parse_assessments(spark, sf):
    docs = ds.table(spark, sf, "documents")
    d = F.col("doc_id")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("<think>x</think> Doc "), d.cast("string")).alias("headline"),
            (d % 101).alias("overall_score"),
            F.array(F.lit("call"), F.col("source")).alias("next_steps"),
        )
    )
    raw = docs.select("doc_id", F.when(d % 3 == 0, "{bad").otherwise(body).alias("raw"))
    return prompts.parse_assessments(raw).select(
        "doc_id", "headline", "overall_score", joined("next_steps").alias("next_steps"), "framework"
    )


_GREEN, _RED = o.arr(lx.GREEN_WORDS), o.arr(lx.RED_WORDS)
_NS = lx.NEXT_STEPS
_SIGNS = f"""notes AS (SELECT conv_id, turn, text || chr(10) || {o.pick('conv_id', ds.NOTES)} AS notes
  FROM conversations),
sents AS (SELECT conv_id, turn, i, s, len(list_intersect(w, {_GREEN})) AS g,
                 len(list_intersect(w, {_RED})) AS r FROM (
  SELECT conv_id, turn, i, s, list_distinct(regexp_extract_all(lower(s), '[a-z'']+')) AS w FROM (
    SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
      SELECT conv_id, turn, list_filter(list_transform(string_split_regex(notes, '[.!?\\n]+'),
             lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM notes))))"""


@register(
    "sentence_signal",
    f"WITH {_SIGNS} SELECT conv_id, turn, CAST(sum(CASE WHEN g > r THEN 1 ELSE 0 END) AS BIGINT) AS "
    "positive, CAST(sum(CASE WHEN r > g THEN 1 ELSE 0 END) AS BIGINT) AS negative FROM sents "
    "GROUP BY 1, 2",
)
def sentence_signal(spark, sf):
    sents = ds.notes(spark, sf).select(
        "conv_id", "turn", F.explode(tx.split_sentences(F.col("notes"))).alias("s")
    )
    signed = sents.withColumn("sign", notes.sentence_signal(F.col("s")))
    return signed.groupBy("conv_id", "turn").agg(
        F.count_if(F.col("sign") > 0).alias("positive"),
        F.count_if(F.col("sign") < 0).alias("negative"),
    )


@register(
    "summarise_notes",
    f"WITH {_SIGNS}, flags AS (SELECT conv_id, turn, "
    "count(*) FILTER (g > r) AS ng, count(*) FILTER (r > g) AS nr, "
    "coalesce(string_agg(s, '|' ORDER BY i) FILTER (g > r), '') AS green, "
    "coalesce(string_agg(s, '|' ORDER BY i) FILTER (r > g), '') AS red "
    "FROM sents GROUP BY 1, 2) SELECT conv_id, turn, green, red, CASE WHEN ng = 0 AND nr = 0 THEN "
    f"{o.q(_NS['neutral'])} WHEN nr = 0 THEN {o.q(_NS['strong'])} WHEN ng > nr THEN "
    f"{o.q(_NS['positive'])} WHEN nr > ng THEN {o.q(_NS['negative'])} ELSE {o.q(_NS['mixed'])} END "
    "AS step FROM flags",
)
def summarise_notes(spark, sf):
    done = notes.summarise_notes(ds.notes(spark, sf))
    return done.select(
        "conv_id", "turn", joined("green_flags").alias("green"), joined("red_flags").alias("red"),
        F.col("recommended_step").alias("step"),
    )


def _outreach_sql() -> str:
    def fill(t: str) -> str:
        parts = o.q(t)
        for slot, col in (("{first}", "first"), ("{role}", "role"), ("{context}", "ctx")):
            parts = f"replace({parts}, '{slot}', {col})"
        return parts

    cases = " ".join(f"WHEN {o.q(k)} THEN {fill(v[1])}" for k, v in lx.OUTREACH.items())
    subjects = " ".join(f"WHEN {o.q(k)} THEN {o.q(v[0])}" for k, v in lx.OUTREACH.items())
    return f"""WITH {o.CAND}, base AS (
      SELECT candidate_id, {o.pick('candidate_id', dict(enumerate(ds.OUTREACH_STAGES)))} AS stage0,
             CASE WHEN candidate_id % 3 <> 0 THEN 'Analyst ' || CAST(candidate_id % 10 AS VARCHAR) END
               AS title,
             string_split(full_name, ' ')[1] AS first, headline,
             CASE WHEN candidate_id % 2 = 0 THEN 'Sam' END AS sender FROM cand),
    prep AS (SELECT *, CASE WHEN stage0 = 'someday' THEN 'sourced' ELSE stage0 END AS stage,
             coalesce('the ' || title || ' role', 'an opportunity I think fits well') AS role,
             coalesce(' Your background in ' || lower(headline) || ' stood out.', '') AS ctx FROM base)
    SELECT candidate_id, CASE WHEN stage0 = 'sourced' AND title IS NOT NULL
             THEN title || ' opportunity' ELSE CASE stage {subjects} END END AS subject,
           md5(replace(CASE stage {cases} END, 'The hiring team', coalesce(sender, 'The hiring team')))
             AS body FROM prep"""


@register("draft_outreach", _outreach_sql())
def draft_outreach(spark, sf):
    k = F.col("candidate_id")
    people = ds.candidates(spark, sf).withColumns(
        {
            "stage": ds.pick(k, dict(enumerate(ds.OUTREACH_STAGES))),
            "job_title": F.when(k % 3 != 0, F.concat(F.lit("Analyst "), (k % 10).cast("string"))),
            "recruiter_name": F.when(k % 2 == 0, "Sam"),
        }
    )
    return notes.draft_outreach(people).select(
        "candidate_id", "subject", F.md5(F.col("body").cast("binary")).alias("body")
    )
