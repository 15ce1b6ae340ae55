"""Flags that give Java patterns the reference's matching rules, and cheap presence tests.

``d``: only a newline ends a line; ``U``: Unicode classes; ``iu``: Unicode
case-insensitivity.  Patterns are always literals, so each is compiled once
per task.

Presence is tested in two steps.  A byte search for literals that every match
must contain (``ANCHORS``) discards nearly all documents; only the rest meet the
regex, and then case-sensitively on lower-cased text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import lexicon as lx

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"


def pattern(body: str, ignore_case: bool = False) -> str:
    return ("(?iudU)" if ignore_case else "(?dU)") + body


def any_case(chars: str) -> str:
    """Letters in both cases, with the letters that match them regardless of case."""
    special = {"i": "\\u0130\\u0131", "s": "\\u017f", "k": "\\u212a"}
    return "".join(c + (c.upper() + special.get(c, "") if c.isalpha() else "") for c in chars)


def started(body: str, ignore_case: bool, *firsts: str) -> str:
    """``pattern`` with the classes of its first characters tried before anything dearer.

    ``firsts``: what stands inside the brackets of a class, in lower case where case is ignored.
    """
    hint = "".join(f"[{any_case(f) if ignore_case else f}]" for f in firsts)
    flags = "(?iu)" if ignore_case else ""
    return f"(?dU)(?={hint}){flags}{body}" if hint else pattern(body, ignore_case)


def matches(text: Column, body: str, ignore_case: bool = False) -> Column:
    return text.rlike(pattern(body, ignore_case))


def any_of(bodies: list[str]) -> str:
    """One alternation, for existence tests only."""
    return "|".join(f"(?:{b})" for b in bodies)


def fold_case(text: Column) -> Column:
    """Lower case under the one-to-one rules of case-insensitive matching."""
    ascii_only = F.length(text) == F.octet_length(text)
    rare = reduce(or_, [F.contains(text, F.lit(c)) for c in "\u0130\u0131\u017f\u212a"])
    return F.lower(
        F.when(ascii_only | ~rare, text).otherwise(
            F.translate(text, "ıİſK", "iisk")
        )
    )


def literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def present_sql(
    text: str,
    lowered: str,
    body: str,
    ignore_case: bool,
    anchors: list[list[str]] | None = None,
    first: str = "",
) -> str:
    """SQL test for a match of ``body`` in column ``text``.

    ``anchors``: groups of literals, each group with at least one in every match.
    ``first``: a character class for the first character, tried before anything dearer.

    Long conditions are written as SQL text: one call to the JVM instead of hundreds.
    """
    hint = f"(?={first})" if first else ""
    if ignore_case:
        test = f"{lowered} RLIKE {literal(pattern(hint + body.lower()))}"
    else:
        test = f"{text} RLIKE {literal(pattern(hint + body))}"
    groups = [
        "(" + " OR ".join(f"contains({lowered}, {literal(w)})" for w in group) + ")"
        for group in anchors or []
    ]
    return "(" + " AND ".join([*groups, test]) + ")"


def present(text: str, lowered: str, body: str, ignore_case: bool, anchors=None, first="") -> Column:
    return F.expr(present_sql(text, lowered, body, ignore_case, anchors, first))


def _names(tests: list[tuple[str, str]]) -> Column:
    """array<string>: the names whose SQL test holds."""
    cases = ", ".join(f"CASE WHEN {test} THEN {literal(name)} END" for name, test in tests)
    return F.expr(f"array_compact(array({cases}))")


_OVERRIDE = ["ignore", "disregard", "forget", "override", "bypass", "overrule"]
_OBJECTS = ["instruction", "guideline", "directive", "rule", "criteria", "constraint"]
_DECIDE = ["approve", "hire", "accept", "recommend"]
INJECTION_ANCHORS = {
    "PR-01-A": [_OVERRIDE, _OBJECTS + ["prompt", "context"]],
    "PR-01-B": [["now"], ["are", "will", "must", "should"], ["you"]],
    "PR-01-C": [["<|im_", "[inst]", "[/inst]", "<s>", "</s>", "<<sys>>", "<</sys>>",
                 "[system]", "###"]],
    "PR-01-D": [["candidate", "applicant", "cv", "resume"],
                ["rate", "score", "rank", "evaluate", "assess"],
                ["10", "perfect", "maximum", "highest", "top"]],
    "PR-01-E": [["directive", "instruction", "command", "system"], _DECIDE + ["pass"]],
    "PR-01-F": [_DECIDE, ["unconditionally", "immediately", "automatically", "without"]],
    "PR-01-G": [["mode"], ["evaluation", "override", "screening", "bypass", "debug"]],
    "PR-01-H": [_OVERRIDE, _OBJECTS, ["previous", "prior", "earlier", "original"]],
}
PII_ANCHORS = {
    "email": [["@"]],
    "nz_bank_account": [["-"]],
    "dob": [["dob", "birth", "born"]],
    "street_address": [["rd", "road", "st", "ave", "dr", "ln", "lane", "pl", "cres"]],
    "visa_status": [["visa", "permit", "residency", "citizen", "pr"]],
    "medical_info": [["health", "medical", "gp", "doctor", "smoker", "disability", "chronic"]],
    "marital_status": [["married", "single", "divorced", "widowed", "union", "facto", "spouse",
                        "husband", "wife"]],
}
# Classes of the first characters of every match, in lower case where case is ignored.
PII_FIRST = {
    "nz_bank_account": r"[\d][\d]",
    "nz_ird": r"[\d][\d]",
    "nz_passport": r"[A-Z][A-Z][\d]",
    "nz_drivers_licence": r"[A-Z][A-Z][\d]",
    "phone_nz": r"[+0][\s\-2-9]",
    "phone_generic": r"[+\d]",
    "dob": "[db][oa]",
    "street_address": r"[\d][\d\s]",
    "visa_status": "[vwrcp][ioer]",
    "medical_info": "[hmgdnsc][epomih]",
    "marital_status": "[msdwch][aiepu]",
}
# Classes of the first two characters of every match, in lower case.
INJECTION_STARTS = {
    "PR-01-A": ("idfob", "giovy"),
    "PR-01-B": ("y", "o"),
    "PR-01-C": (r"<\[#",),
    "PR-01-D": ("rsea", "acvs"),
    "PR-01-E": ("ns", "ey"),
    "PR-01-F": ("ahr", "pice"),
    "PR-01-G": ("eosbd", "vcye"),
    "PR-01-H": ("idfob", "giovy"),
}
BUZZ_ANCHORS = [
    "driven", "proven track record", "leverag", "synerg", "cross", "fast", "fast",
    "thought leadership", "paradigm", "laser focus", "unlock", "transformational", "edge",
    "spearheaded", "orchestrated", "fostered", "catalys", "holistic", "unprecedented", "driven",
]

INJECTIONS = [(pid, started(body, True, *INJECTION_STARTS[pid])) for pid, body in lx.INJECTION_FAMILIES]
ANY_INJECTION = any_of([regex for _, regex in INJECTIONS])
PII = [
    (kind, started(body, ci, *(PII_FIRST[kind].strip("[]").split("][") if kind in PII_FIRST else []))) for kind, body, ci in lx.PII_TYPES
]


def _where(marked: Callable[[str], str] | None, name: str, test: str) -> str:
    return test if marked is None else f"({marked(name)} AND {test})"


def families_present(text: str, lowered: str, marked: Callable[[str], str] | None = None) -> Column:
    """array<string>: hidden-instruction families with at least one match.

    ``marked``: SQL test by name that holds wherever there is a match, see ``marks``; here and below.
    """

    def test(pid: str, body: str) -> str:
        starts = "".join(f"[{s}]" for s in INJECTION_STARTS[pid])
        return present_sql(text, lowered, body, True, INJECTION_ANCHORS[pid] if marked is None else None, starts)

    return _names([(pid, _where(marked, pid, test(pid, body))) for pid, body in lx.INJECTION_FAMILIES])


def holds_any(text: str, lowered: str, families: str) -> Column:
    """Does any of these families match in the text?"""
    tests = [
        f"(array_contains({families}, '{pid}') AND "
        f"{present_sql(text, lowered, body, True, None, ''.join(f'[{s}]' for s in INJECTION_STARTS[pid]))})"
        for pid, body in lx.INJECTION_FAMILIES
    ]
    return F.expr(" OR ".join(tests))


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def pii_present(text: str, lowered: str, digits: str, marked: Callable[[str], str] | None = None) -> Column:
    """array<string>: personal-data types with at least one match.

    ``digits``: column telling whether the text holds any digit; most types need one.
    """

    def test(kind: str, body: str, ci: bool) -> str:
        if marked is not None:  # the mark holds the anchors and the digit
            return _where(marked, kind, present_sql(text, lowered, body, ci, None, PII_FIRST.get(kind, "")))
        sql = present_sql(text, lowered, body, ci, PII_ANCHORS.get(kind), PII_FIRST.get(kind, ""))
        return f"({digits} AND {sql})" if r"\d" in body else sql

    return _names([(kind, test(kind, body, ci)) for kind, body, ci in lx.PII_TYPES])


def buzz_hits(text: str, lowered: str, marked: Callable[[str], str] | None = None) -> Column:
    tests = [
        f"CAST({_where(marked, body, present_sql(text, lowered, body, True, [[anchor]] if marked is None else None))} AS INT)"
        for body, anchor in zip(lx.BUZZ_PHRASES, BUZZ_ANCHORS)
    ]
    return F.expr(" + ".join(tests))
