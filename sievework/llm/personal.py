"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers find the boundaries.

One automaton holds at-signs, plus-digit, digit-digit and digit-dot pairs, URL schemes and identifier
cues; texts without an anchor are done after one pass.  Every hit is handed to the parser of its
kind, which expands from the anchor to the left and right and validates what it finds.  Per kind, spans are
leftmost and do not overlap; a span that fails its validation is consumed all the same.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` are the base; the method adds ``url`` (scheme, host and
path) and ``account`` (a cue such as ``IBAN`` or ``account no.``, in any mixture of cases, and the identifier
behind it).

Defined cases: null text has no spans; repeated rows are judged alike; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
DIGITS = "0123456789"
CUES = ("iban", "account number", "account no", "account", "acct", "routing number", "passport no", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_ACCOUNT = re.compile(r"(?i:\.|:|#|\s|is\s|no\.?\s)*([A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){8,30}|[0-9](?:[ -]?[0-9]){5,17})\b")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for a in DIGITS:
        found.add_word("+" + a, ("phone", 2))
        found.add_word(a + ".", ("ip", 2))
        for b in DIGITS:
            for between in ("", " ", "-"):
                found.add_word(a + between + b, ("card", 2 + len(between)))
    for scheme in ("http://", "https://"):
        found.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    found.make_automaton()
    return found


_FOLD = {c: c + 32 for c in range(65, 91)}


def _folded(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    right = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, right.end(), True) if right else None


def _ip(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    while at > floor and text[at - 1] in DIGITS:
        at -= 1
    found = _IP.match(text, at)
    if found is None:
        return None
    return at, found.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.groups())


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _CARD.match(text, at)
    digits = found.group().replace(" ", "").replace("-", "")
    return at, found.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _PHONE.match(text, at)
    if found is None:
        return None
    return at, found.end(), 8 <= sum(c in DIGITS for c in found.group()) <= 15


def _url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _URL.match(text, at)
    return (at, found.end(), True) if found else None


def _account(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """``at`` is the end of the cue; the identifier must follow within punctuation."""
    found = _ACCOUNT.match(text, at)
    return (found.start(1), found.end(1), True) if found else None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account}


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Valid spans per kind, in order; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)
    for end, (kind, length) in automaton().iter(_folded(text)):
        at = end + 1 if kind == "account" else end + 1 - length
        if kind == "ip":
            at = end - 1  # the digit; the dot follows
        if at < floor[kind]:
            continue
        hit = _PARSERS[kind](text, at, floor[kind])
        if hit:
            start, floor[kind], valid = hit
            if valid:
                found[kind].append((start, floor[kind]))
    return found


def _listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, listed = [], []
        for value in batch["text"]:
            found = spans(value.as_py() or "")
            for column, kind in zip(counts, BASE, strict=True):
                column.append(len(found[kind]))
            digests.append(hashlib.sha256(_listed(found, BASE).encode()).hexdigest())
            listed.append(_listed(found, KINDS))
        yield pa.record_batch(
            [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, f"doc_id long, {counts}, base_sha256 string, spans string"
    )
