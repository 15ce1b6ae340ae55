"""Interview notes and outreach drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import text as tx
from sievework.operators.fence import fence


def sentence_signal(sentence: Column) -> Column:
    """+1 when more distinct positive words than negative ones, -1 the other way, else 0."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit("[a-z']+"), F.lit(0))
    green = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in lx.GREEN_WORDS])))
    red = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in lx.RED_WORDS])))
    return F.signum(green - red).cast("int")


def recommended_step(green: Column, red: Column) -> Column:
    g, r = F.size(green), F.size(red)
    step = lx.NEXT_STEPS
    return (
        F.when((g == 0) & (r == 0), step["neutral"])
        .when((r == 0) & (g > 0), step["strong"])
        .when(g > r, step["positive"])
        .when(r > g, step["negative"])
        .otherwise(step["mixed"])
    )


def summarise_notes(notes: DataFrame, text: str = "notes") -> DataFrame:
    """Add ``green_flags``, ``red_flags`` (every such sentence) and ``recommended_step``."""

    def of_sign(sign: int) -> Column:
        picked = F.filter("_scored", lambda s: s["signal"] == sign)
        return F.transform(picked, lambda s: s["sentence"])

    flagged = (
        notes.withColumn(
            "_scored",
            F.transform(
                tx.split_sentences(F.col(text)),
                lambda s: F.struct(s.alias("sentence"), sentence_signal(s).alias("signal")),
            ),
        )
        .withColumns({"green_flags": of_sign(1), "red_flags": of_sign(-1)})
        .withColumn("recommended_step", recommended_step(F.col("green_flags"), F.col("red_flags")))
        .drop("_scored")
    )
    return fence(flagged, ["green_flags", "red_flags", "recommended_step"])


def draft_outreach(
    candidates: DataFrame,
    stage: str = "stage",
    job_title: str = "job_title",
    recruiter: str = "recruiter_name",
) -> DataFrame:
    """Add ``subject`` and ``body`` from the stage's template; unknown stages are first touches."""

    def lookup(position: int) -> Column:
        def as_format(t: str) -> str:
            return (
                t.replace("{first}", "%1$s").replace("{role}", "%2$s").replace("{context}", "%3$s")
            )

        return F.create_map(
            *[F.lit(x) for k, v in lx.OUTREACH.items() for x in (k, as_format(v[position]))]
        )

    title = F.nullif(F.col(job_title), F.lit(""))
    head = F.nullif(F.col("headline"), F.lit(""))
    known = F.when(F.col(stage).isin(list(lx.OUTREACH)), F.col(stage)).otherwise("sourced")
    sender = F.nullif(F.col(recruiter), F.lit(""))
    return (
        candidates.withColumns(
            {
                "_stage": known,
                "_first": tx.first_name(F.col("full_name")),
                "_role": F.coalesce(
                    F.concat(F.lit("the "), title, F.lit(" role")),
                    F.lit("an opportunity I think fits well"),
                ),
                "_context": F.coalesce(
                    F.concat(F.lit(" Your background in "), F.lower(head), F.lit(" stood out.")),
                    F.lit(""),
                ),
            }
        )
        .withColumns(
            {
                "_format": F.try_element_at(lookup(1), F.col("_stage")),
                "subject": F.when(
                    (F.col(stage) == "sourced") & title.isNotNull(),
                    F.concat(title, F.lit(" opportunity")),
                ).otherwise(F.try_element_at(lookup(0), F.col("_stage"))),
            }
        )
        .withColumn("body", F.expr("format_string(_format, _first, _role, _context)"))
        .withColumn(
            "body",
            F.when(
                sender.isNotNull(), F.replace("body", F.lit(lx.SIGN_OFF), sender)
            ).otherwise(F.col("body")),
        )
        .drop("_stage", "_first", "_role", "_context", "_format")
    )
