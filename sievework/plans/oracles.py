"""SQL building blocks for the side-by-side checks.

Written for an engine without Unicode classes, look-around or NFKC: word
boundaries become explicit classes where accented text matters.
"""

from __future__ import annotations

from sievework.functions import lexicon as lx
from sievework.plans import dataset as ds

T0 = "TIMESTAMP '2024-01-01 00:00:00'"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values: list[str]) -> str:
    return "CAST([" + ", ".join(q(v) for v in values) + "] AS VARCHAR[])"


def pick(number: str, values: dict) -> str:
    cases = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in values.items())
    return f"CASE ({number}) % {len(values)} {cases} END"


def user_of(n: str) -> str:
    return f"'u' || CAST(({n}) % 7 AS VARCHAR)"


def org_of(n: str) -> str:
    return f"CASE WHEN ({n}) % 5 <> 0 THEN 'o' || CAST(({n}) % 3 AS VARCHAR) END"


def minutes(n: str) -> str:
    return f"({T0} + to_minutes(CAST({n} AS INTEGER)))"


def ci(body: str) -> str:
    return q("(?i)" + body)


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


INVISIBLE = (
    r"[\x{00ad}\x{034f}\x{115f}-\x{1160}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{2028}-\x{2029}"
    r"\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}]"
)
FOLD_FROM, FOLD_TO = "".join(lx.LOOKALIKES), "".join(lx.LOOKALIKES.values())

DOCS = f"""docs AS MATERIALIZED (
  SELECT doc_id, lang, source, text || chr(10) || {pick('doc_id', ds.PLANTED)} AS text,
         {user_of('doc_id')} AS user_id, {org_of('doc_id')} AS org_id,
         'cv ' || CAST(doc_id AS VARCHAR) || '.v1.txt' AS upload_name,
         {minutes('doc_id')} AS created_at
  FROM documents)"""
NORM = f"""norm AS MATERIALIZED (
  SELECT *, translate(stripped, {q(FOLD_FROM)}, {q(FOLD_TO)}) AS normalised FROM (
    SELECT *, regexp_replace(text, {q(INVISIBLE)}, '', 'g') AS stripped FROM docs))"""
# A run over the alphabet plus '=' holds at most one token, at its end.
BASE64 = """runs AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(stripped, '[A-Za-z0-9+/_=-]{20,}')) AS run FROM norm),
b64 AS MATERIALIZED (
  SELECT doc_id, decoded FROM (
    SELECT doc_id, TRY(decode(from_base64(body || repeat('=', CAST((4 - len(body) % 4) % 4 AS INT)))))
           AS decoded
    FROM (SELECT doc_id, rtrim(translate(regexp_extract(run, '[A-Za-z0-9+/_-]{20,}={0,2}$'),
                 '-_', '+/'), '=') AS body
          FROM runs) WHERE body <> '' AND len(body) % 4 <> 1)
  WHERE decoded IS NOT NULL AND len(decoded) >= 8
    AND NOT regexp_matches(decoded, '[\\p{Cc}\\p{Cf}\\p{Co}\\p{Zl}\\p{Zp}]'))"""


def spans(name: str, source: str, key: str, text: str, patterns: list[tuple[str, str]]) -> str:
    """CTE of (key, prio, kind, m, s, e): every match with offsets."""
    parts = " UNION ALL ".join(
        f"SELECT {key}, {i} AS prio, {q(kind)} AS kind, string_split_regex({text}, {q(p)}) AS g, "
        f"regexp_extract_all({text}, {q(p)}) AS ms FROM {source} WHERE regexp_matches({text}, {q(p)})"
        for i, (kind, p) in enumerate(patterns)
    )
    return f"""{name} AS MATERIALIZED (
  SELECT {key}, prio, kind, m, e - len(m) AS s, e FROM (
    SELECT {key}, prio, kind, m,
           CAST(sum(len(g) + len(m)) OVER (PARTITION BY {key}, prio ORDER BY i) AS BIGINT) AS e
    FROM (SELECT {key}, prio, kind, unnest(g[1:len(ms)]) AS g, unnest(ms) AS m,
                 generate_subscripts(ms, 1) AS i FROM ({parts}))))"""


INJ_PATTERNS = [(pid, "(?i)" + body) for pid, body in lx.INJECTION_FAMILIES]
PII_PATTERNS = [(kind, ("(?i)" if c else "") + body) for kind, body, c in lx.PII_TYPES]
ANY_INJ = "(?i)" + "|".join(f"(?:{b})" for _, b in lx.INJECTION_FAMILIES)

INJ = spans("inj", "norm", "doc_id", "normalised", INJ_PATTERNS)
PII = spans("pii", "norm", "doc_id", "stripped", PII_PATTERNS)


def _kept() -> str:
    out = ["k0 AS MATERIALIZED (SELECT * FROM pii WHERE prio = 0)"]
    for i in range(1, len(PII_PATTERNS)):
        out.append(
            f"""k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} UNION ALL
  SELECT * FROM pii p WHERE prio = {i} AND NOT EXISTS (SELECT 1 FROM k{i - 1} k
    WHERE k.doc_id = p.doc_id
      AND ((k.s <= p.s AND p.s < k.e) OR (k.s < p.e AND p.e <= k.e))))"""
        )
    return ",\n".join(out)


KEPT = _kept()
LAST = f"k{len(PII_PATTERNS) - 1}"
B64_INJ = "b64inj AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id, {q(pid)} AS kind, decoded, unnest(regexp_extract_all("
    f"translate(decoded, {q(FOLD_FROM)}, {q(FOLD_TO)}), {q(p)})) AS m FROM b64"
    for pid, p in INJ_PATTERNS
) + ")"
BUZZ = " + ".join(f"CAST(regexp_matches(stripped, {ci(b)}) AS INT)" for b in lx.BUZZ_PHRASES)
SENSITIVE = ", ".join(q(k) for k in lx.SENSITIVE_PII)
SCAN = f"""ai AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(regexp_extract_all(stripped, '\\S+')) > 50
         THEN least(1.0, ({BUZZ}) / 10.0) ELSE 0.0 END AS ai_score FROM norm),
scan AS MATERIALIZED (
  SELECT *, CASE WHEN n_inj > 0 OR risk_score >= 70 THEN 'RED' WHEN risk_score >= 30 THEN 'ORANGE'
            ELSE 'GREEN' END AS risk_level FROM (
    SELECT *, CAST(least(100, CASE WHEN n_inj > 0 THEN 60 + least(20, n_inj * 5) ELSE 0 END
         + least(40, n_sens * 8 + (n_pii - n_sens) * 2)
         + CASE WHEN ai_score >= 0.6 THEN 10 WHEN ai_score >= 0.3 THEN 5 ELSE 0 END) AS BIGINT)
         AS risk_score,
         CASE WHEN ai_score >= 0.6 THEN 'LIKELY' WHEN ai_score >= 0.3 THEN 'POSSIBLE'
              ELSE 'UNLIKELY' END AS ai_label
    FROM (
      SELECT d.doc_id, d.source, d.user_id, d.org_id, d.upload_name, d.created_at, a.ai_score,
             coalesce(i.n, 0) + coalesce(b.n, 0) AS n_inj, coalesce(p.n, 0) AS n_pii,
             coalesce(p.n_sens, 0) AS n_sens
      FROM docs d JOIN ai a USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM inj GROUP BY 1) i USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM b64inj GROUP BY 1) b USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (kind IN ({SENSITIVE})) AS n_sens
                 FROM {LAST} GROUP BY 1) p USING (doc_id))))"""
TEXT_CTES = f"{DOCS},\n{NORM}"
INJ_CTES = f"{TEXT_CTES},\n{INJ}"
B64_CTES = f"{TEXT_CTES},\n{BASE64},\n{B64_INJ}"
PII_CTES = f"{TEXT_CTES},\n{PII},\n{KEPT}"
SCAN_CTES = f"{TEXT_CTES},\n{INJ},\n{BASE64},\n{B64_INJ},\n{PII},\n{KEPT},\n{SCAN}"

# ------------------------------------------------------------------ profile

EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _skill_pattern(skill: str) -> str:
    esc = "".join(c if c.isalnum() or c in " &/#-" else "\\" + c for c in skill)
    tail = EDGE_R if (skill[-1].isalnum()) else r"[\p{L}\p{N}_]"
    return "(?i)" + EDGE_L + esc + tail


def doc_skills(name: str, source: str, key: str, text: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, {c} AS c_ord, {i} AS s_ord, {q(category)} AS category, {q(s)} AS skill "
        f"FROM {source} WHERE regexp_matches({text}, {q(_skill_pattern(s))})"
        for c, (category, skills) in enumerate(lx.SKILLS.items())
        for i, s in enumerate(skills)
    )
    return f"{name} AS MATERIALIZED ({parts})"


SKILLS = f"{DOCS},\n{doc_skills('dskills', 'docs', 'doc_id', 'text')}"
_SEN = " ".join(
    f"WHEN regexp_matches(lower(text), {q(EDGE_L + '(?:' + '|'.join(words) + ')')}) THEN {score}"
    for score, words in lx.SENIORITY.items()
)
YEARS = f"""years AS MATERIALIZED (
  SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, {ci(lx.YEARS)}, 1),
         lambda y: TRY_CAST(y AS INTEGER)), lambda y: y > 0 AND y <= 50) AS ys,
         CASE {_SEN} ELSE 0 END AS seniority FROM docs)"""
TIER = """tier AS MATERIALIZED (
  SELECT doc_id, text, ys, max_years, seniority, CASE WHEN max_years IS NULL THEN 'Entry' ELSE
    CASE greatest(CASE WHEN max_years >= 10 THEN 4 WHEN max_years >= 5 THEN 3
                       WHEN max_years >= 2 THEN 2 ELSE 1 END, seniority)
         WHEN 4 THEN 'Principal / Lead' WHEN 3 THEN 'Senior' WHEN 2 THEN 'Mid-level'
         ELSE 'Entry' END END AS tier
  FROM (SELECT *, list_max(ys) AS max_years FROM years))"""


def _edu(body: str) -> str:
    return "(?i)" + EDGE_L + body.removeprefix(r"\b").removesuffix(r"\b") + EDGE_R


_EDU_CASES = " ".join(
    f"WHEN regexp_matches(scope, {q(_edu(b))}) THEN {q(label)}" for label, b in lx.EDUCATION_LEVELS
)
EDU = f"""lined AS MATERIALIZED (
  SELECT doc_id, text, lines, list_position(list_transform(lines,
         lambda l: regexp_matches(trim(l), {ci(lx.EDUCATION_HEADER)})), true) AS h
  FROM (SELECT doc_id, text, string_split_regex(text, '\\r\\n|[\\n\\r]') AS lines FROM docs)),
bodies AS MATERIALIZED (
  SELECT doc_id, text, h, body, list_position(list_transform(body,
         lambda l: regexp_matches(trim(l), {ci(lx.OTHER_HEADER)})), true) AS stop
  FROM (SELECT *, CASE WHEN h > 0 THEN lines[h + 1 :] END AS body FROM lined)),
edu AS MATERIALIZED (
  SELECT doc_id, section, CASE {_EDU_CASES} ELSE 'Not specified' END AS level FROM (
    SELECT doc_id, section, coalesce(section, text) AS scope FROM (
      SELECT doc_id, text, CASE WHEN h > 0 THEN nullif(trim(array_to_string(
             CASE WHEN stop > 0 THEN body[1 : stop - 1] ELSE body END, chr(10)),
             ' ' || chr(9) || chr(10) || chr(13)), '') END AS section FROM bodies)))"""
CLAIMS = "rawclaims AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS prio, generate_subscripts(c, 1) AS i, unnest(c) AS c FROM "
    f"(SELECT doc_id, regexp_extract_all(text, {ci(b)}) AS c FROM docs)"
    for i, b in enumerate(lx.CLAIM_PATTERNS)
) + f"""),
claims AS MATERIALIZED (
  SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY prio, i) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY prio, i) AS dup FROM (
      SELECT doc_id, prio, i, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS c FROM rawclaims)
    WHERE NOT regexp_matches(c, {q(ANY_INJ)})) WHERE dup = 1)"""
WORDS = r"len(regexp_extract_all(text, '\S+'))"
_COMP = {
    label: (
        f"regexp_matches(text, {q(('(?i)' if c else '') + b)})" if b
        else f"{WORDS} >= {label.rsplit(' ', 1)[1]}" if label.startswith("Word")
        else "(" + " OR ".join(f"regexp_matches(text, {ci(x)})" for x in lx.CLAIM_PATTERNS) + ")"
    )
    for label, _, b, c in lx.COMPLETENESS
}
COMPLETE = (
    "comp AS MATERIALIZED (SELECT doc_id, "
    + " + ".join(
        f"CASE WHEN {_COMP[label]} THEN {pts} ELSE 0 END" for label, pts, _, _ in lx.COMPLETENESS
    )
    + " AS score, concat_ws(', ', "
    + ", ".join(f"CASE WHEN NOT {_COMP[label]} THEN {q(label)} END" for label in _COMP)
    + ") AS missing FROM docs)"
)

# -------------------------------------------------------------- store tables

CAND = f"""cand AS MATERIALIZED (
  SELECT c_custkey AS candidate_id, {user_of('c_nationkey')} AS user_id,
         {org_of('c_nationkey')} AS org_id,
         CASE WHEN c_custkey % 11 <> 0 THEN c_custkey END AS scan_id, c_name AS full_name,
         CASE WHEN c_custkey % 6 <> 0 THEN 'Cust' || CAST(c_custkey % 500 AS VARCHAR)
              || '@Example.org' END AS email,
         CASE WHEN c_custkey % 4 = 0 THEN '021 555 ' || CAST(1000 + c_custkey % 9000 AS VARCHAR) END
              AS phone,
         CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS headline,
         {pick('c_custkey', dict(enumerate(ds.CANDIDATE_STATUSES)))} AS status,
         {minutes('c_custkey % 1000')} AS created_at FROM customer)"""
_REQ = " ".join(f"WHEN {i} THEN {arr(v)}" for i, v in ds.REQUIRED.items())
JOBS = f"""jobs AS MATERIALIZED (
  SELECT p_partkey AS job_id, {user_of('p_partkey')} AS user_id, {org_of('p_partkey')} AS org_id,
         p_name AS title, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS client_name,
         CASE p_partkey % {len(ds.REQUIRED)} {_REQ} END AS required_skills,
         {pick('p_size', {0: 'open', 1: 'on_hold', 2: 'closed', 3: 'filled'})} AS status,
         {minutes('p_partkey % 1000')} AS created_at FROM part)"""
STAGES = f"""{JOBS},
stages AS MATERIALIZED (
  SELECT job_id * 10 + n.n AS stage_id, job_id, user_id, org_id,
         CASE n.n WHEN 0 THEN 'Sourced' WHEN 1 THEN 'Phone' ELSE 'Onsite' END AS name,
         CAST(9 - n.n AS INTEGER) AS position
  FROM jobs, (VALUES (0), (1), (2)) n(n) WHERE n.n < job_id % 4)"""
REQUESTS = """reqs AS MATERIALIZED (
  SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS row_no, l_partkey AS job_id, o_custkey AS candidate_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PAIRS = f"""{REQUESTS},
prs AS MATERIALIZED (
  SELECT job_id, candidate_id, min(row_no) AS row_no FROM reqs GROUP BY 1, 2)"""
PLACE = f"""{PAIRS},
place AS MATERIALIZED (
  SELECT row_no AS placement_id, job_id, candidate_id,
         CASE row_no % 3 WHEN 0 THEN job_id * 10 WHEN 1 THEN (job_id + 1) * 10 END AS stage_id,
         {user_of('job_id')} AS user_id, {org_of('job_id')} AS org_id,
         {minutes('row_no % 5000')} AS created_at FROM prs)"""
SHORT = f"""shortl AS MATERIALIZED (
  SELECT row_no AS entry_id, job_id, candidate_id, {user_of('job_id')} AS user_id,
         {org_of('job_id')} AS org_id, {minutes('row_no % 7000')} AS created_at FROM prs)"""
OUTCOMES = f"""outc AS MATERIALIZED (
  SELECT (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS outcome_id, l_partkey AS job_id,
         o_custkey AS candidate_id, {user_of('l_partkey')} AS user_id, {org_of('l_partkey')} AS org_id,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'interviewed' WHEN 'AO' THEN 'offered'
              WHEN 'NF' THEN 'hired' WHEN 'NO' THEN 'rejected' WHEN 'RF' THEN 'withdrawn'
              ELSE 'placed' END AS type, l_shipdate AS occurred_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
NOTIF = f"""notif AS MATERIALIZED (
  SELECT event_id AS notification_id, {user_of('user_id')} AS user_id, {org_of('user_id')} AS org_id,
         'Error for ' || CAST(user_id AS VARCHAR) AS title,
         CAST(event_id % 2 AS INTEGER) AS "read", ts AS created_at
  FROM events WHERE event_type = 'error')"""
PRINCIPALS = f"""ps AS MATERIALIZED (
  SELECT DISTINCT {user_of('p_partkey')} AS u, {org_of('p_partkey')} AS g FROM part
  UNION ALL SELECT 'nobody', NULL)"""


def seen(table: str, alias: str) -> str:
    """Principals with every row they may see, and one empty row where they see none."""
    return f"ps LEFT JOIN {table} {alias} ON {alias}.user_id = ps.u OR {alias}.org_id = ps.g"


USAGE = """usage AS MATERIALIZED (
  SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, ts,
         CASE WHEN event_type = 'view' THEN 'scan' ELSE 'assessment' END AS kind
  FROM events WHERE event_type IN ('view', 'click'))"""
SHARES = f"""shares AS MATERIALIZED (
  SELECT job_id, user_id, 'tok' || CAST(job_id AS VARCHAR) AS token,
         CASE WHEN job_id % 3 <> 0 THEN created_at + to_days(CAST(job_id % 30 + 1 AS INTEGER)) END
           AS expires_at
  FROM jobs WHERE status = 'open')"""


def funnel(keys: str) -> str:
    counts = ", ".join(f"count(*) FILTER (type = {q(t)}) AS {t}" for t in lx.OUTCOME_TYPES)
    placed = ", ".join(q(t) for t in lx.PLACED_TYPES)
    return f"{counts}, count(*) AS total, count(*) FILTER (type IN ({placed})) AS placed"
