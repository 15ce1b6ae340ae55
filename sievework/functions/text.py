"""Text normalisation helpers (Column -> Column)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import lexicon as lx
from sievework.functions.regexes import NOT_SPACE, SPACE, pattern

_FOLD_FROM = "".join(lx.LOOKALIKES)
_FOLD_TO = "".join(lx.LOOKALIKES.values())

# Characters that NFKC leaves alone in any combination: ASCII, accented Latin
# letters without a compatibility form, basic Cyrillic, dashes, quotes, bullet.
# Text made only of these never reaches the Python worker.
STABLE = (
    r"\x00-\x7f\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e"
    r"\u0141-\u0148\u014a-\u017e\u0400-\u045f\u2010\u2012-\u2015\u2018-\u201b"
    r"\u201c-\u201f\u2022\u20ac"
)
_UNSTABLE = f"[^{STABLE}]"


_INVISIBLE = "".join(c for c in map(chr, range(0x80, 0x10000)) if re.match(lx.INVISIBLE_CLASS, c))
# White space and the separators beside it, as in ``regexes.SPACE``.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(r"[\s\x1c-\x1f]", c))
_LONG_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"


def is_ascii(text: Column) -> Column:
    """Byte length equals character length: a header read, not a regex scan."""
    return F.length(text) == F.octet_length(text)


def strip_invisible(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(F.translate(text, _INVISIBLE, ""))


def needs_nfkc(text: Column) -> Column:
    other = F.regexp_replace(text, r"[\x00-\x7f]+", "")
    return F.when(is_ascii(text), False).otherwise(other.rlike(_UNSTABLE))


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_array_udf(values: pd.Series) -> pd.Series:
    return values.map(
        lambda vs: None if vs is None else [unicodedata.normalize("NFKC", v) for v in vs]
    )


def nfkc(text: Column) -> Column:
    """Rows that NFKC cannot change are sent to Python as null and kept as they are."""
    return F.coalesce(_nfkc_udf(F.when(needs_nfkc(text), text)), text)


def nfkc_each(texts: Column) -> Column:
    return F.coalesce(_nfkc_array_udf(F.when(F.exists(texts, needs_nfkc), texts)), texts)


def fold_lookalikes(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(
        F.translate(text, _FOLD_FROM, _FOLD_TO)
    )


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(text, F.lit(SPACES))


def nonblank(text: Column) -> Column:
    return text.rlike(pattern(NOT_SPACE))


def shortened(text: Column, limit: int | None) -> Column:
    """The first ``limit`` characters; all of them without a limit."""
    return text if limit is None else F.left(text, F.lit(limit))


def decode_base64_tokens(text: Column, maybe: Column | None = None) -> Column:
    """Readable strings hidden in base64 runs, in text order, however many there are.

    ``maybe``: false only where the text is known to hold no long run.
    """
    tokens = F.regexp_extract_all(text, F.lit(lx.BASE64_TOKEN), F.lit(0))

    def body(token: Column) -> Column:
        return F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")

    def decode(token: Column) -> Column:
        padding = F.pmod(-F.length(body(token)), F.lit(4)).cast("int")
        blob = F.try_to_binary(
            F.concat(body(token), F.repeat(F.lit("="), padding)), F.lit("base64")
        )
        # Undecodable bytes are dropped, not kept as replacement characters.
        return F.replace(F.make_valid_utf8(blob.cast("string")), F.lit("\ufffd"), F.lit(""))

    def strict(token: Column) -> Column:
        # Padding written in the text may be short, never more than needed.
        rest = F.length(body(token)) % 4
        written = F.length(token) - F.length(body(token))
        return (rest == 2) | ((rest == 3) & (written <= 1)) | ((rest == 0) & (written == 0))

    decoded = F.transform(F.filter(tokens, strict), decode)
    readable = F.filter(
        decoded,
        lambda d: d.isNotNull()
        & (F.length(d) >= lx.MIN_DECODED_CHARS)
        & ~d.rlike(r"[\p{C}[\p{Z}&&[^ ]]]"),
    )
    return F.when(text.rlike(_LONG_RUN) if maybe is None else maybe, readable).otherwise(
        F.array().cast("array<string>")
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern(f"{NOT_SPACE}+")))


def escape_markup(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def strip_think(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"(?isu)<think>.*?</think>", ""))


def clean_cell(cell: Column, limit: int | None = None) -> Column:
    return F.nullif(shortened(trim_space(cell), limit), F.lit(""))


def first_alias(*cells: Column) -> Column:
    """First alias that is not empty; blanks made of white space do count."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cells])


def search_tokens(text: Column) -> Column:
    """Distinct lower-case search terms longer than one character."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(lx.SEARCH_TOKEN), F.lit(0)
    )
    longer = F.filter(found, lambda t: F.length(t) > 1)
    return F.array_except(longer, F.array(*[F.lit(w) for w in lx.SEARCH_STOP_WORDS]))


def normalise_skill(skill: Column) -> Column:
    return F.lower(trim_space(skill))


def skill_parts(skill: Column) -> Column:
    """The skill and its word parts; ``+`` and ``#`` are not separators."""
    parts = F.filter(F.split(skill, r"(?U)[.\s/,]+", -1), lambda p: p != "")
    return F.array_union(parts, F.array(skill))


def split_sentences(text: Column) -> Column:
    pieces = F.transform(F.split(text, r"[.!?\n]+", -1), trim_space)
    return F.filter(pieces, lambda s: s != "")


def split_skills(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), trim_space), lambda s: s != "")


def join_skills(skills: Column) -> Column:
    return F.array_join(skills, ", ")


def first_name(full_name: Column) -> Column:
    first = F.regexp_extract(
        F.coalesce(full_name, F.lit("")), pattern(rf"^{SPACE}*({NOT_SPACE}+)"), 1
    )
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("there"))


def filename_stem(filename: Column) -> Column:
    stem = F.regexp_replace(filename, r"(?s)\.[^.]*\z", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("Unnamed candidate"))


def safe_title(title: Column, limit: int | None = None) -> Column:
    return shortened(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), limit)


def sanitise_filename(name: Column, limit: int | None = None) -> Column:
    base = F.element_at(F.split(name, "/", -1), -1)
    safe = shortened(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), limit)
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("upload"))


def iso_timestamp(ts: Column) -> Column:
    """UTC ISO-8601; a zero fraction is left out."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.concat(whole, fraction, F.lit("+00:00"))


def expiry(ts: Column, days: Column) -> Column:
    return F.when(days.isNotNull(), ts + F.make_interval(days=days))


def label_of(code: Column, labels: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, code), code)
