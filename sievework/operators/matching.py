"""CV against job description, candidate against job, free text against talent pool.

Scores depend only on the two skill sets, so each distinct pair of sets is scored
once and the scores are joined back.  Pairs are found through equi-joins on
tokens; nothing is compared that shares no token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import text as tx
from sievework.operators.profile import STRINGS, flat_skills
from sievework.operators.scope import visible_to
from sievework.operators.skew import cell_by_cell, evenly, in_blocks, rank_top, split_join
from sievework.session import materialise


def category_weight(category: Column) -> Column:
    out = F
    for name, weight in lx.CATEGORY_WEIGHTS.items():
        out = out.when(category == name, weight)
    return out.otherwise(lx.DEFAULT_CATEGORY_WEIGHT)


def _flat(skills: Column) -> Column:
    return F.array_distinct(
        F.coalesce(F.flatten(F.map_values(skills)), F.array().cast(STRINGS))
    )


def coverage_note(n: Column) -> Column:
    plural = F.when(n != 1, "s").otherwise("")
    return F.when(
        n < lx.MIN_JD_SKILLS,
        F.concat(
            F.lit("Only "), n.cast("string"), F.lit(" recognisable skill"), plural,
            F.lit(" found in the JD — score is capped at "),
            F.lit(f"{lx.SPARSE_JD_CAP}/100 until the JD lists more requirements."),
        ),
    ).otherwise("")


def jd_match(pairs: DataFrame, cv: str = "cv_skills", jd: str = "jd_skills") -> DataFrame:
    """Score given (CV, JD) pairs of skill maps.  Narrow: no shuffle."""
    cv_flat, jd_flat = _flat(F.col(cv)), _flat(F.col(jd))
    entries = F.filter(F.map_entries(jd), lambda e: F.size(e["value"]) > 0)
    total = F.aggregate(
        entries, F.lit(0.0), lambda acc, e: acc + category_weight(e["key"]).cast("double")
    )

    def share(e: Column) -> Column:
        has = F.coalesce(F.try_element_at(F.col(cv), e["key"]), F.array().cast(STRINGS))
        return F.size(F.array_intersect(e["value"], has)) / F.size(e["value"])

    earned = F.aggregate(
        entries, F.lit(0.0), lambda acc, e: acc + category_weight(e["key"]) * share(e)
    )
    raw = F.when(total > 0, F.bround(100 * earned / total)).otherwise(F.lit(0.0)).cast("int")
    n = F.size(jd_flat)
    return pairs.withColumns(
        {
            "match_score": F.when(
                n < lx.MIN_JD_SKILLS, F.least(raw, F.lit(lx.SPARSE_JD_CAP))
            ).otherwise(raw),
            "matched_skills": F.array_sort(F.array_intersect(cv_flat, jd_flat)),
            "missing_skills": F.array_sort(F.array_except(jd_flat, cv_flat)),
            "bonus_skills": F.array_sort(F.array_except(cv_flat, jd_flat)),
            "coverage_note": coverage_note(n),
        }
    )


def jd_match_corpus(cvs: DataFrame, jds: DataFrame) -> DataFrame:
    """Every (CV, JD) pair that shares a skill, scored.

    ``cvs``: ``doc_id, skills``; ``jds``: ``jd_id, skills`` (skill maps).  Distinct
    skill maps are scored against each other; documents only join at the end.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.array_join(F.array_sort(_flat(F.col("skills"))), _SEP))

    cv_rows, jd_rows = keyed(cvs, "_cv_set"), keyed(jds, "_jd_set")
    # A skill belongs to one category, so equal sets have equal maps.
    cv_sets = cv_rows.groupBy("_cv_set").agg(F.first("skills").alias("cv_skills"))
    jd_sets = jd_rows.groupBy("_jd_set").agg(F.first("skills").alias("jd_skills"))

    def exploded(df: DataFrame, key: str, skills: str) -> DataFrame:
        return df.select(key, F.explode(_flat(F.col(skills))).alias("skill"))

    sharing = (
        exploded(jd_sets, "_jd_set", "jd_skills")
        .join(exploded(cv_sets, "_cv_set", "cv_skills"), "skill")
        .select("_cv_set", "_jd_set")
        .distinct()
    )
    scored = jd_match(sharing.join(cv_sets, "_cv_set").join(jd_sets, "_jd_set"))
    scored = scored.drop("cv_skills", "jd_skills")
    return (
        scored.join(jd_rows.select("jd_id", "_jd_set"), "_jd_set")
        .join(cv_rows.select("doc_id", "_cv_set"), "_cv_set")
        .drop("_cv_set", "_jd_set")
    )


JD_BLOCK = 1_000
SET_ROWS = 256


class _Wanted:
    """Job descriptions as numbers: per category its weight, size and skills, in the order of the map."""

    def __init__(self, rows: list):
        skills = {s: k for k, s in enumerate(sorted({s for r in rows for v in r.skills.values() for s in v}))}
        self.number = skills
        self.jds = []
        for r in rows:
            parts = [
                (float(lx.CATEGORY_WEIGHTS.get(c, lx.DEFAULT_CATEGORY_WEIGHT)), len(v), np.array([skills[s] for s in v]))
                for c, v in r.skills.items() if v
            ]
            own = np.unique(np.concatenate([p[2] for p in parts]))
            self.jds.append((r.jd_id, parts, own, sum(p[0] for p in parts)))

    def scores(self, parts: list, total: float, n: int, has: np.ndarray) -> np.ndarray:
        """``match_score`` of rows of ``has`` (which skills are there): the arithmetic of ``jd_match``."""
        earned = np.zeros(len(has))
        for weight, size, own in parts:
            earned += weight * (has[:, own].sum(axis=1) / size)
        raw = np.rint(100 * earned / total).astype(np.int64)
        return np.minimum(raw, lx.SPARSE_JD_CAP) if n < lx.MIN_JD_SKILLS else raw


def _best_sets(batches: Iterator[pa.RecordBatch], wanted: _Wanted, k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` skill sets of a task per job description, by score and smallest document.

    Sets come sorted, so neighbours have skills in common.  Of a block of sets, the skills that any of them has
    bound every category's share; a block whose bound is below a description's k-th best is passed over.
    """
    best: list[list[tuple[int, int, str]]] = [[] for _ in wanted.jds]
    for batch in batches:
        for at in range(0, len(batch), SET_ROWS):
            part = batch.slice(at, SET_ROWS)
            docs, keys = part["first_doc"].to_numpy(), part["cv_set"].to_pylist()
            has = np.zeros((len(part), len(wanted.number)), dtype=bool)
            for row, skills in enumerate(part["flat"].to_pylist()):
                has[row, [wanted.number[s] for s in skills if s in wanted.number]] = True
            any_has = has.any(axis=0)[None]
            for j, (_, parts, own, total) in enumerate(wanted.jds):
                held = best[j]
                if not any_has[0, own].any():
                    continue
                if len(held) == k and wanted.scores(parts, total, len(own), any_has)[0] < -held[-1][0]:
                    continue
                rows = np.flatnonzero(has[:, own].any(axis=1))
                scores = wanted.scores(parts, total, len(own), has[rows])
                order = np.lexsort((docs[rows], -scores))[:k]
                held += [(-int(scores[i]), int(docs[rows[i]]), keys[rows[i]]) for i in order]
                held.sort()
                del held[k:]
    rows = [(wanted.jds[j][0], key, -score, doc) for j, held in enumerate(best) for score, doc, key in held]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = {"jd_id": pa.int64(), "cv_set": pa.string(), "score": pa.int64(), "first_doc": pa.int64()}
    yield pa.record_batch({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})


def jd_top(cvs: DataFrame, jds: DataFrame, k: int) -> DataFrame:
    """The best ``k`` CVs per job description, of those that share a skill: score, then ``doc_id``; with ``rank``.

    ``cvs`` and ``jds`` as for ``jd_match_corpus``.  Each distinct skill set is looked at once with its smallest
    documents; a task keeps ``k`` sets per description, and only those become pairs.  ``k`` sets of a
    higher score, or of an equal one and smaller documents, leave no place for another set's documents.
    Descriptions go to the tasks ``JD_BLOCK`` at a time.
    """
    key = F.array_join(F.array_sort(_flat(F.col("skills"))), _SEP)
    people = materialise(cvs.select("doc_id", "skills", key.alias("cv_set")).filter("cv_set <> ''"), "cv-skills")
    few = rank_top(people, ["cv_set"], [F.asc("doc_id")], k).select("doc_id", "cv_set")
    sets = people.groupBy("cv_set").agg(F.min("doc_id").cast("long").alias("first_doc"))
    sets = sets.repartitionByRange("cv_set").sortWithinPartitions("cv_set").select(
        "cv_set", "first_doc", F.split("cv_set", _SEP).alias("flat")
    )
    sets = materialise(sets, "skill-sets")
    kept = F.filter(F.map_entries("skills"), lambda e: F.size(e["value"]) > 0)
    asked = jds.select(F.col("jd_id").cast("long").alias("jd_id"), "skills").filter(F.size(kept) > 0)
    n = -(-asked.count() // JD_BLOCK)
    chosen = []
    for block in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("jd_id"), F.lit(n)) == block).toLocalIterator()
        wanted = _Wanted(list(rows))
        found = sets.mapInArrow(
            lambda b, w=wanted: _best_sets(b, w, k), "jd_id long, cv_set string, score long, first_doc long"
        )
        chosen.append(rank_top(found, ["jd_id"], [F.desc("score"), F.asc("first_doc")], k))
    if not chosen:
        chosen = [few.select(F.lit(None).cast("long").alias("jd_id"), "cv_set").limit(0)]
    pairs = reduce(DataFrame.unionByName, chosen).select("jd_id", "cv_set").join(few, "cv_set")
    maps = people.groupBy("cv_set").agg(F.first("skills").alias("cv_skills"))
    scored = jd_match(
        pairs.join(maps, "cv_set").join(asked.withColumnRenamed("skills", "jd_skills"), "jd_id")
    ).drop("cv_skills", "jd_skills", "cv_set")
    return rank_top(scored, ["jd_id"], [F.desc("match_score"), F.asc("doc_id")], k)


# --------------------------------------------------------------------- auto-match


def _required(jobs: DataFrame) -> DataFrame:
    kept = F.filter(F.transform("required_skills", tx.normalise_skill), lambda s: s != "")
    return jobs.withColumn("_req", kept).withColumn("_req_key", F.array_join("_req", _SEP))


def score_profiles(req_sets: DataFrame, skill_sets: DataFrame) -> DataFrame:
    """Score distinct requirement lists against distinct skill sets.

    ``req_sets``: ``_req_key, _req``; ``skill_sets``: ``_skill_key, _skills``.
    """
    wanted = req_sets.select("_req_key", F.explode(F.array_distinct("_req")).alias("token"))
    parts = F.array_distinct(F.flatten(F.transform("_skills", tx.skill_parts)))
    offered = skill_sets.select("_skill_key", F.explode(parts).alias("token"))
    return (
        wanted.join(offered, "token")
        .groupBy("_req_key", "_skill_key")
        .agg(F.collect_set("token").alias("_hit"))  # at most one requirement list long
        .join(req_sets, "_req_key")
        .withColumns(
            {
                "matched_skills": F.filter("_req", lambda r: F.array_contains("_hit", r)),
                "missing_skills": F.filter("_req", lambda r: ~F.array_contains("_hit", r)),
            }
        )
        .withColumn(
            "score", F.bround(100 * F.size("matched_skills") / F.size("_req")).cast("int")
        )
        .drop("_hit", "_req")
    )


def auto_match(jobs: DataFrame, candidates: DataFrame, told: dict[str, Column] | None = None) -> DataFrame:
    """Candidates with at least one required skill, per job, within tenant scope.

    ``jobs``: ``job_id, user_id, org_id, required_skills``;
    ``candidates``: ``candidate_id, user_id, org_id, full_name, skills`` (skill map).
    ``told``: further columns made of ``score, matched_skills, missing_skills``, once per pair of skill lists.

    Jobs of one tenant cell and requirement list, and people of one cell and skill set, meet in blocks; pairs
    are formed last and never shuffled.
    """
    told = told or {}
    job_rows, people, scores = _scored(jobs, candidates)
    scores = scores.withColumns(told)
    asked = in_blocks(job_rows, ["user_id", "org_id", "_req_key"], F.struct("job_id"), "job_id", "_jobs").select(
        F.col("user_id").alias("p_user"), F.col("org_id").alias("p_org"), "_req_key", F.col("_block").alias("_jb"), "_jobs"
    )
    # Names travel apart from ids, so that callers without use for them do not carry them.
    seen = in_blocks(
        people, ["user_id", "org_id", "_skill_key"], F.struct("candidate_id", "full_name"), "candidate_id", "_people"
    ).select(
        F.col("user_id").alias("c_user"), F.col("org_id").alias("c_org"), "_skill_key", F.col("_block").alias("_cb"),
        F.col("_people")["candidate_id"].alias("_ids"), F.col("_people")["full_name"].alias("_names"),
    )
    wanted = _scoped(
        asked.select("p_user", "p_org", "_req_key", "_jb", F.col("p_org").alias("org_id")).join(
            scores.select("_req_key", "_skill_key"), "_req_key"
        ),
        "p_user",
    )
    offered = _scoped(seen.select("c_user", "c_org", "_skill_key", "_cb", F.col("c_org").alias("org_id")), "c_user")
    # A pair that meets through its user is not listed again through its organisation.
    met = wanted.join(offered, ["_skill_key", "_scope", "_by_org"]).filter(
        ~F.col("_by_org") | ~F.col("c_user").eqNullSafe(F.col("p_user"))
    )
    met = met.drop("_scope", "_by_org").join(scores, ["_req_key", "_skill_key"])
    job_block, people_block = ["p_user", "p_org", "_req_key", "_jb"], ["c_user", "c_org", "_skill_key", "_cb"]
    cells = _attached(_attached(met, asked, job_block), seen, people_block)
    found = ["score", "matched_skills", "missing_skills", *told]
    each = evenly(cells, *job_block, *people_block).select(F.inline("_jobs"), "_ids", "_names", *found)
    each = cell_by_cell(each).select("job_id", F.posexplode("_ids").alias("_at", "candidate_id"), "_names", *found)
    return each.select("job_id", "candidate_id", F.get("_names", F.col("_at")).alias("full_name"), *found)


def _attached(cells: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with the arrays of the block that ``keys`` name; a null key is a value like others."""
    arrays = [c for c in blocks.columns if c not in keys]
    named = blocks.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], *arrays)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)])
    return cells.join(named, on).drop(*[f"_of{i}" for i in range(len(keys))])


def _scored(jobs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs with ``_req_key``, people with ``_skill_key``, and the scores of their distinct pairs."""
    job_rows = _required(jobs).select("job_id", "user_id", "org_id", "_req_key")
    people = candidates.select(
        "candidate_id", "full_name", "user_id", "org_id",
        F.array_join(F.array_sort(flat_skills(F.col("skills"))), _SEP).alias("_skill_key"),
    ).filter(F.col("_skill_key") != "")
    scores = score_profiles(
        _sets(job_rows, "_req_key", "_req"), _sets(people, "_skill_key", "_skills")
    )
    return job_rows, people, scores


def best_matches(jobs: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The best ``k`` candidates per job, found before any pair is formed.

    People of one tenant cell with the same skill set differ only by name, so ``k`` of them are
    enough.  Per principal and requirement list, cells are ranked by score and taken until ``k``
    people are surely better than the rest; only these meet, and only ``k`` rows meet the jobs.
    """
    job_rows, people, scores = _scored(jobs, candidates)
    cell = ["user_id", "org_id", "_skill_key"]
    few = rank_top(people, cell, [F.lower("full_name"), F.asc("candidate_id")], k).drop("rank")
    sizes = few.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    wanted = job_rows.select(
        F.col("user_id").alias("p_user"), F.col("org_id").alias("p_org"), "_req_key"
    ).distinct()
    principals = wanted.select("p_user", "p_org").distinct()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    seen = visible_to(sizes, principals, "user_id", "org_id").withColumnsRenamed(
        {"p_user": "_u", "p_org": "_o"}
    )
    value = F.col("score") * 1000 + F.size("matched_skills")
    better = (
        Window.partitionBy("p_user", "p_org", "_req_key")
        .orderBy(F.desc("_value"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    chosen = (
        wanted.join(seen, (F.col("p_user") == F.col("_u")) & same("p_org", "_o"))
        .drop("_u", "_o")
        .join(scores, ["_req_key", "_skill_key"])
        .withColumn("_value", value)
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(better), F.lit(0)))
        .filter(F.col("_ahead") < k)
        .drop("_n", "_value", "_ahead")
    )
    there = few.withColumnsRenamed({"user_id": "_u", "org_id": "_o", "_skill_key": "_s"})
    on = (F.col("user_id") == F.col("_u")) & same("org_id", "_o") & (F.col("_skill_key") == F.col("_s"))
    ranked = rank_top(
        chosen.join(there, on), ["p_user", "p_org", "_req_key"], match_order(), k
    ).select("p_user", "p_org", F.col("_req_key").alias("_r"), "candidate_id", "full_name", "score",
             "matched_skills", "missing_skills", "rank")
    at = (F.col("user_id") == F.col("p_user")) & same("org_id", "p_org") & (F.col("_req_key") == F.col("_r"))
    return job_rows.join(ranked, at).drop("p_user", "p_org", "_r", "_req_key", "user_id", "org_id")


_SEP = "\x1f"


def _sets(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct keys and the array each stands for (a hash aggregate on strings only)."""
    items = F.filter(F.split(F.col(key), _SEP, -1), lambda s: s != "")
    return rows.select(key).distinct().withColumn(out, items)


def _scoped(rows: DataFrame, user: str) -> DataFrame:
    """Each row under its user and under its organisation, for one equi-join on scope."""
    scopes = F.array(
        F.struct(F.col(user).alias("_scope"), F.lit(False).alias("_by_org")),
        F.struct(F.col("org_id").alias("_scope"), F.lit(True).alias("_by_org")),
    )
    return rows.select("*", F.inline(scopes)).filter(F.col("_scope").isNotNull()).drop("org_id")


def match_order() -> list[Column]:
    return [
        F.desc("score"), F.desc(F.size("matched_skills")), F.lower("full_name"), "candidate_id",
    ]


def rank_matches(matches: DataFrame, k: int | None = None) -> DataFrame:
    """Best first.  With ``k``, the top ``k`` per job; else one range-sorted table."""
    if k is None:
        return matches.orderBy("job_id", *match_order())
    return rank_top(matches, ["job_id"], match_order(), k)


# ------------------------------------------------------------------- talent search


def talent_search(queries: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Share of a query's distinct terms found in skills, headline or name, within tenant scope.

    ``queries``: ``query_id, query, user_id, org_id``; ``candidates``: ``candidate_id, full_name,
    headline, skills, user_id, org_id``.  Each list of terms is scored once per principal; with ``k``,
    the best ``k`` are kept before they meet the queries.
    """
    asked = queries.select(
        "query_id", F.col("user_id").alias("q_user"), "org_id",
        F.array_sort(F.array_distinct(tx.search_tokens(F.col("query")))).alias("_terms"),
    ).withColumn("_org", F.coalesce("org_id", F.lit("")))
    lists = asked.select("q_user", "org_id", "_org", "_terms").distinct()
    wanted = _scoped(lists, "q_user").select(
        "q_user", "_org", "_terms", "_scope", "_by_org", F.explode("_terms").alias("token")
    )
    skills = flat_skills(F.col("skills"))
    tokens = reduce(
        F.array_union,
        [
            skills,
            F.flatten(F.transform(skills, tx.search_tokens)),
            tx.search_tokens(F.col("headline")),
            tx.search_tokens(F.col("full_name")),
        ],
    )
    # array_union already makes tokens distinct within a candidate: no shuffle for that.
    offered = _scoped(
        candidates.select(
            "candidate_id", F.col("user_id").alias("c_user"), "org_id", F.explode(tokens).alias("token")
        ),
        "c_user",
    )
    hits = (
        split_join(offered, wanted, ["token", "_scope", "_by_org"], "candidate_id")
        .filter(~F.col("_by_org") | ~F.col("c_user").eqNullSafe(F.col("q_user")))
        .groupBy("q_user", "_org", "_terms", "candidate_id")
        .agg(F.count(F.lit(1)).alias("_hits"))
        .withColumn("score", F.bround(100 * F.col("_hits") / F.size("_terms")).cast("int"))
        .drop("_hits")
        .join(candidates.select("candidate_id", "full_name", "headline"), "candidate_id")
    )
    if k is not None:
        hits = rank_top(hits, ["q_user", "_org", "_terms"], search_order(), k)
    return asked.select("query_id", "q_user", "_org", "_terms").join(
        hits, ["q_user", "_org", "_terms"]
    ).drop("q_user", "_org", "_terms")


def search_order() -> list[Column]:
    return [F.desc("score"), F.lower("full_name"), "candidate_id"]
