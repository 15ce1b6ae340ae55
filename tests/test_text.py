"""Text core against Python's own engines."""

import base64
import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from sievework.functions import lexicon as lx
from sievework.functions import regexes as rx
from sievework.functions import spans as sp
from sievework.functions import text as tx
from sievework.operators import detect

ALPHABET = "ab1 2é\n  -@.\U0001f600Zz"


def random_texts(n, seed, alphabet=ALPHABET, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_spans_equal_finditer(spark):
    texts = random_texts(300, 1) + ["7 " * 900, "", "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for body in [r"\d+", r"[a-z]+\s", r"\b\w+\b", r"a.b"]:
        rows = df.select("t", sp.find_spans("t", rx.pattern(body)).alias("s")).collect()
        for row in rows:
            want = [(m.start(), m.end(), m.group()) for m in re.finditer(body, row.t)]
            assert [(s.start, s.end, s.match) for s in row.s] == want, (body, row.t)


def test_stable_class_is_closed_under_nfkc():
    stable = [
        chr(c) for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF and not re.match(tx._UNSTABLE, chr(c))
    ]
    assert len(stable) > 400
    assert all(unicodedata.normalize("NFKC", c) == c for c in stable)
    assert all(unicodedata.combining(c) == 0 for c in stable)
    joined = "".join(stable) + "".join(reversed(stable))
    assert unicodedata.normalize("NFKC", joined) == joined


def test_nfkc(spark):
    texts = ["plain", "ﬁne Ａ", "é", "naïve", "①½", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(tx.nfkc(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def expected_base64(text):
    out = []
    for m in list(re.finditer(lx.BASE64_TOKEN, text)):
        token = m.group().replace("-", "+").replace("_", "/")
        try:
            raw = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
        except ValueError:
            continue
        plain = raw.decode("utf-8", errors="ignore")
        if len(plain) >= lx.MIN_DECODED_CHARS and plain.isprintable():
            out.append(plain)
    return out


def test_base64_random_tokens(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        raw = bytes(rng.randrange(32, 126) for _ in range(rng.randrange(12, 40)))
        if rng.random() < 0.3:
            raw += "é☃".encode()[: rng.randrange(1, 6)]
        token = base64.b64encode(raw).decode().rstrip("=") + "=" * rng.randrange(0, 3)
        texts.append(f"x {token}{rng.choice([' y', '.', '=', 'é', ''])}")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tx.decode_base64_tokens(F.col("t")).alias("d")).collect():
        assert row.d == expected_base64(row.t), row.t


def test_base64_over_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for row in docs.select("text", tx.decode_base64_tokens(F.col("text")).alias("d")).collect():
        assert row.d == expected_base64(row.text)


def brute_pii(text):
    kept = []
    for kind, body, ci in lx.PII_TYPES:
        for m in re.finditer(body, text, re.IGNORECASE if ci else 0):
            a, b = m.span()
            if all(not (s <= a < e or s < b <= e) for _, s, e in kept):
                kept.append((kind, a, b))
    return kept


def test_pii_priority_rule(spark):
    rng = random.Random(9)
    bits = [
        "ada@example.org", "06-0273-0123456-00", "123-456-789", "NZ1234567", "021 555 1234",
        "+64 21 555 1234", "born: 14/03/1985", "12 Long View Road", "visa expires 2027", "smoker",
        "married", "(555) 123-4567 89", "é", " ", ", ", "-", "9",
    ]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(8)) for _ in range(300)]
    df = detect.normalise(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = df.withColumn("d", rx.has_digit(F.col("stripped"))).withColumn(
        "k", rx.pii_present("stripped", "lowered", "d")
    )
    for row in df.select("stripped", detect.pii_spans("stripped", "k").alias("p")).collect():
        assert [(x.pii_type, x.start, x.end) for x in row.p] == brute_pii(row.stripped), row.stripped


def test_small_helpers(spark):
    df = spark.createDataFrame([("  Ada Lovelace ", "../x/a b(1).PDF", "react.js/vue")], "n string, f string, s string")
    row = df.select(
        tx.first_name(F.col("n")).alias("first"),
        tx.sanitise_filename(F.col("f")).alias("safe"),
        tx.filename_stem(F.lit("a.b.txt")).alias("stem"),
        tx.skill_parts(F.col("s")).alias("parts"),
        tx.search_tokens(F.lit("The Senior C++ and c# dev, a C")).alias("tokens"),
        tx.iso_timestamp(F.to_timestamp(F.lit("2024-01-02 03:04:05"))).alias("iso"),
    ).first()
    assert row.first == "Ada" and row.safe == "a_b_1_.PDF" and row.stem == "a.b"
    assert set(row.parts) == {"react", "js", "vue", "react.js/vue"}
    assert row.tokens == ["c++", "c#", "dev"] and row.iso == "2024-01-02T03:04:05+00:00"
