"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.mixing import copies

    return copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source"
    )


@query(
    "op9_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, no, line, string_split_regex(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                                                  '[ \t\x0B\f\r]+') AS w
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
    ), leaves AS (
      SELECT doc_id, no, line, CASE WHEN w[1] = '' THEN 0 ELSE len(w) END AS n,
             list_transform(w[1:6], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS path
      FROM lines
    ), recurring AS (
      SELECT n, path, min(doc_id) AS keeper FROM leaves WHERE n >= 3
      GROUP BY n, path HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
      SELECT l.doc_id, l.no, l.line, coalesce(l.doc_id > r.keeper, false) AS gone
      FROM leaves l LEFT JOIN recurring r ON l.n = r.n AND l.path = r.path
    ), kept AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
      FROM marked GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
           CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.lines import drop_recurring

    return drop_recurring(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


@query(
    "op6_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.decontaminate import leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") == 0).alias("kept"),
        F.size("leaks").cast("long").alias("n_items"),
        F.coalesce(F.array_max("leaks.similarity"), F.lit(0.0)).alias("similarity"),
        "leaks",
    )


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.personal import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality import judged, measured, train

    rows = measured(table(spark, sf_dir, "documents"))
    model = train(rows, table(spark, sf_dir, "labels"))
    return judged(rows, model).select("doc_id", "kept", "evidence", "posterior")


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query(
    "op4_chat",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
             AS loss_sha256,
           sum(length('<s>[] </s>' || regexp_replace(role || text, '([\\<\[\]])', '\\\1', 'g')))::BIGINT
             AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.chat import prefix_forest, read_back

    awkward = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", awkward), (-1, 1, "assistant", awkward)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(prefix_forest(turns.unionByName(extra)))


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.jaccard import components_of

    return components_of(table(spark, sf_dir, "documents"))


@query(
    "op10_phrase_dedup",
    r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), windows AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
    ), firsts AS (
      SELECT k, min(doc_id) AS owner FROM windows GROUP BY k HAVING min(doc_id) <> max(doc_id)
    ), gone AS (
      SELECT DISTINCT doc_id, i + j AS pos
      FROM windows JOIN firsts USING (k), (SELECT unnest(range(0, 13)) AS j) WHERE doc_id > owner
    ), words AS (
      SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
    ), kept AS (
      SELECT words.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (gone.pos IS NULL), '') AS kept
      FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id
    )
    SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
)
def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.phrases import cut_phrases

    return cut_phrases(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


@query(
    "op11_divergence",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
      FROM documents
    ), occurring AS (SELECT no, lang, source, unnest(ts) AS term FROM docs),
    kept AS (
      SELECT lang, term, count(*) AS n FROM occurring GROUP BY lang, term HAVING count(DISTINCT no) >= 30
    ), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    cells AS (
      SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL
    ), totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
    groups AS (
      SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t USING (lang, source)
    ), shares AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
      LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), apart AS (
      SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    ), terms AS (
      SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    QUALIFY part = 'pair' OR rank <= 50
    """,
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def _clustering_sql() -> str:
    """Five rounds and the last assignment, one after the other."""
    near = """
    near{0} AS MATERIALIZED (
      SELECT no, vec_id, v, c AS cluster, d AS distance FROM (
        SELECT k.no, k.vec_id, k.v, c.c,
               list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM kept k, centroids{0} c)
      QUALIFY row_number() OVER (PARTITION BY no ORDER BY d, c) = 1
    )"""
    move = """
    sums{0} AS (
      SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{0}) GROUP BY cluster, pos
    ), means{0} AS (
      SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM sums{0} GROUP BY cluster
    ), centroids{1} AS MATERIALIZED (
      SELECT c.c, coalesce(m.v, c.v) AS v FROM centroids{0} c LEFT JOIN means{0} m ON c.c = m.cluster
    )"""
    steps = [near.format(0)]
    for k in range(5):
        steps += [move.format(k, k + 1), near.format(k + 1)]
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), centroids0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
      FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT 40)
    ), {", ".join(steps)}
    SELECT n.vec_id, n.cluster::INT AS cluster, n.distance,
           (sum(n.distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia,
           (sum(n.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM near5 n JOIN centroids5 c ON n.cluster = c.c
    """


@query("op12_centroids", _clustering_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


@query("op13_licenses")
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.licenses import license_labels

    return license_labels(table(spark, sf_dir, "documents"))
