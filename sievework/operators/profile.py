"""Skills, experience, education, claims and interview material per document.

Narrow projections only.  ``analyse`` stages shared intermediate values in their
own columns so that no expression is evaluated twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import marks as mk
from sievework.functions import regexes as rx
from sievework.functions import text as tx
from sievework.operators.fence import fence

STRINGS = "array<string>"
SKILL_MAP = "map<string,array<string>>"

_WORD_SKILLS = [
    s for skills in lx.SKILLS.values() for s in skills if s.replace("_", "").isalnum()
]
_OTHER_SKILLS = [
    s for skills in lx.SKILLS.values() for s in skills if not s.replace("_", "").isalnum()
]


# ------------------------------------------------------------------------- marks

_CLAIM_ANCHORS = [
    ["led", "managed", "built", "architected", "designed", "delivered"],
    ["increased", "reduced", "improved", "cut", "saved", "grew"],
    ["improvement", "increase", "reduction", "faster", "growth", "uplift"],
    ["team of", "managed"],
]
# Classes of the first characters of every match, in lower case.
_CLAIM_STARTS = [("lmbad", "eaur"), ("ircsg", "nemuar"), (r"\d",), ("tm", "ea")]
_LEVEL_ANCHORS = [
    ["phd", "ph.d", "doctor"], ["msc", "m.sc", "m.s", "master", "mba", "meng"],
    ["bsc", "b.sc", "b.s", "b.e", "beng", "bachelor", "b.a"], ["associate", "a.s", "a.a"],
    ["high school", "secondary school", "diploma", "ged"],
    ["bootcamp", "boot camp", "selftaught", "self-taught", "online course", "certification"],
]
_COMPLETENESS_ANCHORS = {
    "Has email": [["@"]],
    "Has LinkedIn": [["linkedin.com/in/"]],
    "Has GitHub": [["github.com/"]],
    "Has work-entry dates": [["20"]],
    "Has skills heading": [["skills", "technologies", "stack"]],
}
_WORD = "any word skill"
_SECTION = "education section"
_YEARS = "years"
_EMPLOYER = "employer"
_SENIOR = "seniority "
_EDGE = "(?:^|$|[^A-Za-z0-9_])"
_PHONE = rf"{mk.DIGIT}[{mk.DIGIT}{mk.SPACE}\-().]{{7}}"
# Bits of what a whole text may hold; see ``marks``.
TESTS = {
    _WORD: [_EDGE + mk.group([s.lower() for s in _WORD_SKILLS]) + _EDGE],
    **{s: [mk.group([s.lower()])] for s in _OTHER_SKILLS},
    **{body: [mk.group(words)] for body, words in zip(lx.CLAIM_PATTERNS, _CLAIM_ANCHORS)},
    **{label: [mk.group(words)] for (label, _), words in zip(lx.EDUCATION_LEVELS, _LEVEL_ANCHORS)},
    **{label: [mk.group(g) for g in groups] for label, groups in _COMPLETENESS_ANCHORS.items()},
    "Has phone": [_PHONE],
    _SECTION: [mk.group(["education", "academic", "qualification"])],
    _YEARS: [rf"{mk.DIGIT}\+?[{mk.SPACE}]*[yY]"],
    _EMPLOYER: [rf"(?:at|@)[{mk.SPACE}]+[A-Z]"],
    **{
        f"{_SENIOR}{score}": [_EDGE + mk.group([w.replace("\\", "") for w in words])]
        for score, words in lx.SENIORITY.items()
    },
}
_seen = mk.seen(TESTS, dict.fromkeys(_OTHER_SKILLS, mk.group([s.lower() for s in _OTHER_SKILLS])))


def with_marks(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_marks`` and the ``_words`` of the text."""
    look = docs.withColumn("_seen", _seen(F.col(text)))
    return look.withColumns({"_marks": F.col("_seen.marks"), "_words": F.col("_seen.n_words")}).drop("_seen")


def _may(name: str, marks: str | None) -> Column:
    """False only where the marks tell that a text does not hold this."""
    return F.lit(True) if marks is None else F.expr(mk.marked(marks, TESTS, name))


def _escape(literal: str) -> str:
    return "".join(c if c.isalnum() or c in " &/#-" else "\\" + c for c in literal)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(STRINGS)


# ------------------------------------------------------------------------ skills


def skill_hits(text: str, lowered: str, marks: str | None = None) -> Column:
    """Taxonomy skills present in the text column, as one flat array.

    A skill made of word characters is present exactly when it is one of the
    text's words, so one split and one hash intersection replace a hundred
    regex passes.  Only skills with other characters keep a pattern.
    ``lowered``: column holding ``regexes.fold_case`` of the text.
    ``marks``: column of ``with_marks``, here and below; without it, everything is searched for.
    """
    words = F.split(F.col(lowered), r"[^\p{L}\p{N}_]+", -1)
    found = F.when(
        _may(_WORD, marks), F.array_intersect(_strings([s.lower() for s in _WORD_SKILLS]), words)
    ).otherwise(F.array().cast(STRINGS))
    by_pattern = F.array_compact(
        F.array(
            *[
                F.when(
                    _may(s, marks) & rx.present(text, lowered, rf"\b{_escape(s)}\b", True, [[s.lower()]]), s.lower()
                )
                for s in _OTHER_SKILLS
            ]
        )
    )
    spelling = F.create_map(
        *[F.lit(x) for s in _WORD_SKILLS + _OTHER_SKILLS for x in (s.lower(), s)]
    )
    return F.transform(F.concat(found, by_pattern), lambda h: F.element_at(spelling, h))


def group_skills(hits: Column) -> Column:
    """Flat hits -> map<category, skills>; categories without a hit are left out."""
    pairs = [
        x
        for category, skills in lx.SKILLS.items()
        for x in (F.lit(category), F.array_intersect(_strings(skills), hits))
    ]
    empty = F.create_map().cast(SKILL_MAP)
    grouped = F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)
    return F.when(F.size(hits) > 0, grouped).otherwise(empty)


def flat_skills(skills: Column) -> Column:
    """Distinct, trimmed, lower-case skills of a skill map."""
    all_skills = F.flatten(F.map_values(skills))
    cleaned = F.filter(
        F.transform(F.coalesce(all_skills, F.array().cast(STRINGS)), tx.normalise_skill),
        lambda s: s != "",
    )
    return F.array_distinct(cleaned)


def doc_skills(docs: DataFrame, key: str, skills: str = "skills") -> DataFrame:
    """Long form: one row per (document, category, skill)."""
    return docs.select(key, F.explode(skills).alias("category", "in_category")).select(
        key, "category", F.explode("in_category").alias("skill")
    )


# -------------------------------------------------------------------- experience


def year_claims(text: Column, marks: str | None = None) -> Column:
    raw = F.when(
        rx.matches(text, r"\d\+?\s*y", True) if marks is None else _may(_YEARS, marks) & text.isNotNull(),
        F.regexp_extract_all(text, F.lit(rx.started(lx.YEARS, True, r"\d")), F.lit(1)),
    ).otherwise(F.array().cast(STRINGS))
    years = F.transform(raw, lambda y: y.try_cast("int"))
    return F.filter(years, lambda y: y.isNotNull() & (y > 0) & (y <= 50))


def distinct_years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(year_claims(text)))


def max_years(claims: Column) -> Column:
    return F.array_max(claims)


def seniority_score(lowered: str, marks: str | None = None) -> Column:
    """Highest score among words that start with a seniority keyword."""
    out = F
    for score, words in lx.SENIORITY.items():
        firsts = "".join(sorted({w[0] for w in words}))
        literals = [w.replace("\\", "") for w in words]
        out = out.when(
            _may(f"{_SENIOR}{score}", marks)
            & rx.present(lowered, lowered, rf"\b(?:{'|'.join(words)})", False, [literals], f"[{firsts}]"),
            score,
        )
    return out.otherwise(0)


def _years_bucket(years: Column) -> Column:
    return F.when(years >= 10, 4).when(years >= 5, 3).when(years >= 2, 2).otherwise(1)


def _tier_label(score: Column) -> Column:
    out = F
    for rank, label in lx.TIERS.items():
        out = out.when(score == rank, label)
    return out.otherwise("Entry")


def experience_tier(years: Column, seniority: Column) -> Column:
    """Larger of the years bucket and the seniority words; no years means Entry."""
    return F.when(years.isNull(), "Entry").otherwise(
        _tier_label(F.greatest(_years_bucket(years), seniority))
    )


def years_to_tier(years: Column) -> Column:
    return F.when(F.coalesce(years, F.lit(0)) == 0, "Entry").otherwise(
        _tier_label(_years_bucket(years))
    )


# --------------------------------------------------------------------- education


def education_section(text: Column, marks: str | None = None) -> Column:
    """Lines after the first education heading, up to another heading; null if none."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    stripped = F.transform(lines, tx.trim_space)
    start = F.array_position(
        F.transform(stripped, lambda s: rx.matches(s, lx.EDUCATION_HEADER, True)), True
    )
    body = F.slice(lines, start.cast("int") + 1, F.size(lines))
    stop = F.array_position(
        F.transform(body, lambda s: rx.matches(tx.trim_space(s), lx.OTHER_HEADER, True)), True
    ).cast("int")
    kept = F.when(stop > 0, F.slice(body, F.lit(1), stop - 1)).otherwise(body)
    section = F.nullif(tx.trim_space(F.array_join(kept, "\n")), F.lit(""))
    maybe = rx.matches(text, r"education|academic|qualification", True) if marks is None else _may(_SECTION, marks)
    return F.when(maybe, F.when(start > 0, section))


def education_level(scope: str, lowered_scope: str, marks: str | None = None) -> Column:
    """Highest level named in the section, or in the whole text when there is none.

    ``marks``: those of the whole text, whose lines the section is made of.
    """
    firsts = ["[pd]", "m", "b", "a", "[hsdg]", "[bsoc]"]
    out = F
    for (label, body), first in zip(lx.EDUCATION_LEVELS, firsts):
        out = out.when(_may(label, marks) & rx.present(scope, lowered_scope, body, True, None, first), label)
    return out.otherwise(lx.NO_EDUCATION)


# ------------------------------------------------------------------------ claims


def claim_present(text: str, lowered: str, marks: str | None = None) -> list[Column]:
    return [
        _may(body, marks)
        & rx.present(text, lowered, body, True, [anchors] if marks is None else None, "".join(f"[{s}]" for s in starts))
        for body, anchors, starts in zip(lx.CLAIM_PATTERNS, _CLAIM_ANCHORS, _CLAIM_STARTS)
    ]


def raw_claims(text: str, lowered: str, marks: str | None = None) -> Column:
    """Every claim-like phrase, pattern by pattern, trimmed."""
    none = F.array().cast(STRINGS)
    found = [
        F.when(
            there, F.regexp_extract_all(F.col(text), F.lit(rx.started(body, True, *starts)), F.lit(0))
        ).otherwise(none)
        for body, starts, there in zip(
            lx.CLAIM_PATTERNS,
            _CLAIM_STARTS,
            claim_present(text, lowered) if marks is None else [_may(body, marks) & F.col(text).isNotNull() for body in lx.CLAIM_PATTERNS],
        )
    ]
    return F.transform(F.concat(*found), tx.trim_space)


def ordered_claims(claims: Column) -> Column:
    """Claims with their lower-cased form and place, sorted by both."""
    return F.array_sort(
        F.transform(
            claims,
            lambda c, i: F.struct(F.lower(c).alias("low"), i.alias("at"), c.alias("claim")),
        )
    )


def first_claims(ordered: str) -> Column:
    """In text order, the claims that differ when lower-cased; linear in their number."""
    kept = F.filter(
        ordered, lambda x, i: (i == 0) | (F.get(F.col(ordered), i - 1)["low"] != x["low"])
    )
    by_place = F.array_sort(
        F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["claim"].alias("claim")))
    )
    return F.transform(by_place, lambda x: x["claim"])


def add_key_claims(docs: DataFrame, text: str = "text", out: str = "key_claims") -> DataFrame:
    """Add the verifiable claims; a claim that is itself an injection is dropped."""
    folded = F.transform(F.col("_claim_norm"), tx.fold_lookalikes)
    decoded_folded = F.transform(F.col("_decoded_norm"), tx.fold_lookalikes)
    low = docs.withColumn(
        "_claim_low", F.col("_low") if "_low" in docs.columns else rx.fold_case(F.col(text))
    )
    kept = (
        low.withColumn("_claims", raw_claims(text, "_claim_low", "_marks" if "_marks" in docs.columns else None))
        .withColumn("_stripped", F.transform("_claims", tx.strip_invisible))
        .withColumn(
            "_tokens",
            F.when(
                F.exists("_stripped", lambda c: c.rlike("[A-Za-z0-9+/_-]{20}")),
                F.transform("_stripped", lambda c: F.array_join(tx.decode_base64_tokens(c), "\n")),
            ).otherwise(F.transform("_stripped", lambda _: F.lit(""))),
        )
        .withColumns(
            {
                "_claim_norm": tx.nfkc_each(F.col("_stripped")),
                "_decoded_norm": tx.nfkc_each(F.col("_tokens")),
            }
        )
        .withColumn(
            "_bad",
            F.zip_with(
                folded,
                decoded_folded,
                lambda c, d: c.rlike(rx.ANY_INJECTION) | d.rlike(rx.ANY_INJECTION),
            ),
        )
        .withColumn(
            "_ordered",
            ordered_claims(F.filter("_claims", lambda c, i: ~F.get(F.col("_bad"), i))),
        )
        .withColumn(out, first_claims("_ordered"))
        .drop("_claims", "_ordered", "_claim_low", "_stripped", "_tokens", "_claim_norm", "_decoded_norm", "_bad")
    )
    return fence(kept, [out])


# ------------------------------------------------------------------ completeness


def completeness_breakdown(text: str, lowered: str, words: Column, marks: str | None = None) -> Column:
    """map<signal, boolean> over the nine signals."""
    pairs = []
    for label, _, body, ci in lx.COMPLETENESS:
        if body is not None:
            hit = _may(label, marks) & rx.present(text, lowered, body, ci, _COMPLETENESS_ANCHORS.get(label) if marks is None else None)
        elif label.startswith("Word count"):
            hit = words >= int(label.rsplit(" ", 1)[1])
        else:
            hit = reduce(lambda a, b: a | b, claim_present(text, lowered, marks))
        pairs += [F.lit(label), hit]
    return F.create_map(*pairs)


def completeness_score(breakdown: Column) -> Column:
    points = [
        F.when(F.try_element_at(breakdown, F.lit(label)), pts).otherwise(0)
        for label, pts, _, _ in lx.COMPLETENESS
    ]
    return reduce(lambda a, b: a + b, points)


def missing_signals(breakdown: Column) -> Column:
    return F.map_keys(F.map_filter(breakdown, lambda _, hit: ~hit))


# --------------------------------------------------------------- summary material


def top_skills(skills: Column) -> Column:
    """First three distinct skills, categories by size (equal sizes keep their order)."""
    entries = F.transform(
        F.map_entries(skills),
        lambda e, i: F.struct(
            (-F.size(e["value"])).alias("neg"), i.alias("ord"), e["value"].alias("v")
        ),
    )
    ordered = F.flatten(F.transform(F.array_sort(entries), lambda e: e["v"]))
    return F.slice(F.array_distinct(ordered), 1, 3)


def total_skills(skills: Column) -> Column:
    return F.size(F.flatten(F.map_values(skills)))


def candidate_summary(
    skills: Column, tier: Column, years: Column, education: Column, claims: Column
) -> Column:
    top = top_skills(skills)
    role = F.when(
        F.size(top) > 0,
        F.concat(tier, F.lit(" "), F.array_join(top, " · "), F.lit(" engineer")),
    ).otherwise(F.concat(tier, F.lit(" candidate")))
    exp = F.when(
        years.isNotNull(), F.concat(F.lit(" ("), years.cast("string"), F.lit("y exp)"))
    ).otherwise("")
    n = F.size(claims)
    noun = F.when(n == 1, " verifiable claim").otherwise(" verifiable claims")
    short = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in lx.EDUCATION_SHORT.items() for x in kv]), education
        ),
        F.lit("—"),
    )
    return F.concat_ws(
        " | ", F.concat(role, exp), short, F.concat(n.cast("string"), noun)
    )


def employers(text: Column, marks: str | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(rx.started(lx.EMPLOYER, False, "a@")), F.lit(1))
    return F.array_distinct(F.when(_may(_EMPLOYER, marks), found).otherwise(F.array().cast(STRINGS)))


def red_flags(
    total: Column, years: Column, n_distinct_years: Column, words: Column, n_employers: Column
) -> Column:
    flag = lx.RED_FLAGS
    return F.array_compact(
        F.array(
            F.when((total >= 15) & (years < 3), flag["broad"]),
            F.when((total == 0) & (years >= 5), flag["unskilled"]),
            F.when(n_distinct_years >= 2, flag["inconsistent"]),
            F.when(words < 150, flag["short"]),
            F.when((n_employers > 3) & (years < 2), flag["hopping"]),
        )
    )


def interview_probes(skills: Column, tier: Column) -> Column:
    """Up to four skill questions, one for the tier, filled to five with general ones."""
    spoken = F.transform(
        F.flatten(F.map_values(skills)),
        lambda s: F.replace(F.lower(s), F.lit("."), F.lit("")),
    )
    bank = F.array(
        *[
            F.struct(F.lit(key).alias("key"), _strings(questions).alias("questions"))
            for key, questions in lx.PROBES.items()
        ]
    )
    hit = F.filter(bank, lambda p: F.exists(spoken, lambda s: s.contains(p["key"])))
    chosen = F.slice(F.flatten(F.transform(hit, lambda p: p["questions"])), 1, 4)
    specific = F.when(F.size(skills) > 0, chosen).otherwise(F.array().cast(STRINGS))
    by_tier = (
        F.when(tier.isin("Senior", "Principal / Lead"), lx.MENTOR_PROBE)
        .when(tier == "Mid-level", lx.PUSHBACK_PROBE)
        .otherwise(lx.LEARNING_PROBE)
    )
    return F.slice(F.concat(specific, F.array(by_tier), _strings(lx.GENERAL_PROBES)), 1, 5)


def headline(tier: Column, years: Column) -> Column:
    return F.when(
        F.coalesce(years, F.lit(0)) > 0,
        F.concat(tier, F.lit(" · "), years.cast("string"), F.lit(" yrs experience")),
    ).otherwise(F.nullif(tier, F.lit("")))


# ----------------------------------------------------------------- DataFrame level

ANALYSIS_FIELDS = [
    "skills", "experience_tier", "years_experience", "education_level", "interview_probes",
    "key_claims", "total_skills_found", "summary", "completeness", "red_flags", "match_engine",
]


def extract_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Skills, years, tier and education columns, plus the working counts."""
    t = F.col(text)
    senior = reduce(lambda a, b: a | b, (_may(f"{_SENIOR}{score}", "_marks") for score in lx.SENIORITY))
    facts = (
        with_marks(docs, text)
        .withColumns(
            {
                "_low": rx.fold_case(t),
                "_plain_low": F.when(senior, F.lower(t)),
                "_scope": F.coalesce(education_section(t, "_marks"), t),
            }
        )
        .withColumns(
            {
                "_hits": skill_hits(text, "_low", "_marks"),
                "_years": year_claims(t, "_marks"),
                "_scope_low": F.when(F.col("_scope") == t, F.col("_low")).otherwise(
                    rx.fold_case(F.col("_scope"))
                ),
                "_seniority": seniority_score("_plain_low", "_marks"),
                "_employers": F.size(employers(t, "_marks")),
            }
        )
        .withColumns(
            {
                "skills": group_skills(F.col("_hits")),
                "years_experience": max_years(F.col("_years")),
                "education_level": education_level("_scope", "_scope_low", "_marks"),
            }
        )
        .withColumn(
            "experience_tier", experience_tier(F.col("years_experience"), F.col("_seniority"))
        )
        .drop("_scope", "_scope_low", "_plain_low", "_seniority", "_hits")
    )
    return fence(
        facts,
        ["_low", "_marks", "_years", "_words", "_employers", "skills", "years_experience",
         "education_level", "experience_tier"],
    )


def merge_model_facts(facts: DataFrame, model_facts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Let validated model facts override education and years where present.

    ``model_facts``: ``key, education_level, years_experience`` with one row per key.
    A document without a row keeps the values read by pattern.
    """
    overrides = model_facts.select(
        key,
        F.col("education_level").alias("_m_level"),
        F.col("years_experience").alias("_m_years"),
        F.lit(True).alias("_m_present"),
    )
    years = F.coalesce("_m_years", "years_experience")
    return (
        facts.join(overrides, key, "left")
        .withColumns(
            {
                "education_level": F.coalesce(
                    F.nullif(F.col("_m_level"), F.lit("")), "education_level"
                ),
                "years_experience": years,
                "experience_tier": F.when(
                    F.col("_m_years").isNotNull(), years_to_tier(F.col("_m_years"))
                ).otherwise(F.col("experience_tier")),
                "match_engine": F.when(F.col("_m_present"), "llm").otherwise("regex"),
            }
        )
        .drop("_m_level", "_m_years", "_m_present")
    )


def complete_analysis(facts: DataFrame, text: str = "text") -> DataFrame:
    """Add everything derived from the facts and fold it into ``match_analysis``."""
    t = F.col(text)
    total = total_skills(F.col("skills"))
    out = add_key_claims(facts, text)
    out = out.withColumn(
        "_breakdown", completeness_breakdown(text, "_low", F.col("_words"), "_marks")
    )
    analysis = F.struct(
        F.col("skills").alias("skills"),
        F.col("experience_tier").alias("experience_tier"),
        F.col("years_experience").alias("years_experience"),
        F.col("education_level").alias("education_level"),
        interview_probes(F.col("skills"), F.col("experience_tier")).alias("interview_probes"),
        F.col("key_claims").alias("key_claims"),
        total.alias("total_skills_found"),
        candidate_summary(
            F.col("skills"),
            F.col("experience_tier"),
            F.col("years_experience"),
            F.col("education_level"),
            F.col("key_claims"),
        ).alias("summary"),
        F.struct(
            completeness_score(F.col("_breakdown")).alias("score"),
            F.col("_breakdown").alias("breakdown"),
        ).alias("completeness"),
        red_flags(
            total,
            F.col("years_experience"),
            F.size(F.array_distinct("_years")),
            F.col("_words"),
            F.col("_employers"),
        ).alias("red_flags"),
        F.col("match_engine").alias("match_engine"),
    )
    done = out.withColumn("match_analysis", analysis).drop(
        "_low", "_marks", "_years", "_words", "_employers", "_breakdown", "skills", "experience_tier",
        "years_experience", "education_level", "key_claims", "match_engine",
    )
    return fence(done, ["match_analysis"])


def add_skills(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the skill map alone."""
    staged = with_marks(docs, text).withColumn("_low", rx.fold_case(F.col(text)))
    hits = staged.withColumn("_hits", skill_hits(text, "_low", "_marks"))
    return fence(
        hits.withColumn("skills", group_skills(F.col("_hits"))).drop("_low", "_hits", "_marks", "_words"), ["skills"]
    )


def analyse_corpus(
    docs: DataFrame,
    text: str = "text",
    engine: str = "regex",
    model_facts: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Add ``match_analysis``.  An unknown engine behaves like ``regex``."""
    facts = extract_facts(docs, text)
    if engine == "llm" and model_facts is not None:
        facts = merge_model_facts(facts, model_facts, key)
    else:
        facts = facts.withColumn("match_engine", F.lit("regex"))
    return complete_analysis(facts, text)
