"""Divergence audit, centroid clustering and licence scans against brute force, and their odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import centroids, decontaminate, divergence, jaccard, licenses

FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})
CLASHES = ["term", "n", "d", "row", "code", "group", "rank", "value", "part", "p", "q", "base", "cluster", "distance",
           "cell", "limb", "spans", "n_words", "start", "kept", "total", "item", "other", "block", "shard"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


# ------------------------------------------------------------------ 11 divergence


def brute_audit(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= divergence.MIN_DOCS)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in set(kept))
        sources = sorted({d[1] for d in mine})

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[s]) for s in sources}
        q = shares(sum((counts[s] for s in sources), Counter()))
        for s in sources:
            apart = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            above = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", apart, None), ("term", above, 50)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def random_corpus(n, sources, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Ärt", "foo", "BAR", "qu") for b in "abcdefghijklmnop"]
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        start = rng.randrange(len(vocabulary) // 2)
        text = rng.choice([" ", "-", "1"]).join(rng.choices(vocabulary[start : start + 20], k=rng.randrange(40)))
        rows.append((rng.choice(["en", "fr", None]), source, rng.choice([text, text, text, None, ""])))
    return rows


@pytest.mark.parametrize("terms,blocks", [(4096, 256), (7, 2)])
def test_divergence(spark, monkeypatch, terms, blocks):
    monkeypatch.setattr(divergence, "SHARD_TERMS", terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", blocks)
    rows = random_corpus(900, ["a", "b", "c", "", None, "é", "z"], 3)
    rows += [("de", "only", "wort"), ("nn", "x", None), ("nn", "y", "Ord")]
    df = clashing(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5))
    found = divergence.audit(df)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows)
    assert ("nn", "x", "pair", "y", 0, 1) in got and not any(r[0] == "de" for r in got)


def test_divergence_of_long_and_common(spark):
    """A text of several slices, one term in every document, and counts beyond what fits a long times 1e9."""
    rows = [("en", f"s{k % 3}", "the " * (1 + k)) for k in range(40)] + [("en", "s0", "the end " * 200_000)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect()}
    assert got == brute_audit(rows)
    big = spark.range(1).select(F.expr(divergence._probability("123456789012345L", "223456789012345L", "7L")).alias("p"))
    assert big.first().p == 1 + 10**9 * (123456789012345 + 5) // (223456789012345 + 35)
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


# ------------------------------------------------------------------ 12 centroids


def brute_clusters(rows, k=40, rounds=5):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(256 * x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    own, longest = Counter(), centroids.LONGEST
    for _, c, d in found:
        own[c] += min(d, longest)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, min(d, longest), min(own[c], longest), min(sum(own.values()), longest), digest[c]) for i, c, d in found)


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "large"])
def test_centroids(spark, kind):
    rng = random.Random(5)
    value = {"spread": lambda: rng.gauss(0, 0.2), "ties": lambda: rng.choice([0.0, 1 / 256]), "few": lambda: rng.random(),
             "large": lambda: rng.choice([-1e30, 2e9, 0.3, -0.3])}[kind]
    rows = [(i, [value() for _ in range(64)]) for i in range(10 if kind == "few" else 150)]
    if kind == "ties":
        rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1])] + [(500 + i, rows[0][1]) for i in range(60)]
    bad = rows[0][1]
    rows += [(900, None), (901, bad[:63]), (902, bad + [0.0]), (903, bad[:63] + [None]), (904, bad[:63] + [math.nan]),
             (905, bad[:63] + [math.inf]), (906, []), (907, bad[:63] + [1.7e308])]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(3))
    found = centroids.clustered(df)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == brute_clusters(rows)


def test_no_centroids(spark):
    assert centroids.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.clustered(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0


def test_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    centres = np.concatenate([rng.integers(-4, 5, (20, 64)) + 1000 * k for k in range(10)])
    centres = np.concatenate([centres, centres[::7]])
    tree = centroids.Tree(centres)
    x = np.concatenate([centres + rng.integers(-1, 2, centres.shape), centres])
    found, best = tree.nearest(x)
    every = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (found == every.argmin(axis=1)).all()
    seen = []
    visit = tree._visit
    tree._visit = lambda node, rows, *a: (seen.append((node, len(rows))), visit(node, rows, *a))
    tree.nearest(x)
    assert sum(n for _, n in seen) < 0.5 * len(x) * len(tree.points)


# ------------------------------------------------------------------ 13 licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_phrases(text, phrases):
    words = WORD.findall((text or "").translate(FOLD))
    found = []
    for phrase, label in phrases.items():
        own = phrase.split()
        found += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return len(words), found


def test_licenses(spark):
    rng = random.Random(2)
    parts = "gnu general public license apache LICENSE cc by by-nc mit mit é 2 lesser".split()
    texts = [" ".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "...", "MIT\x00License", "mit licenses", "cc-by/cc.by", "x" * 100, "Mit  \n license " * 30_000]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    rows = {r.doc_id: r for r in licenses.license_labels(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        n, base = brute_phrases(text, licenses.BASE)
        _, more = brute_phrases(text, licenses.PHRASES)
        starts = [s for s, _ in base]
        labels = ",".join(sorted({label for _, label in base}))
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(base), labels)
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.labels == ",".join(sorted({label for _, label in base + more}))
        assert r.score == float(bool(base + more))
    assert licenses.license_labels(df.limit(0)).count() == 0


def matching_statistics(words, texts):
    """Longest suffix at every word that some template contains."""
    joined = [" " + " ".join(t) + " " for t in texts]
    out = []
    for e in range(1, len(words) + 1):
        size = 0
        while size < e and any(" " + " ".join(words[e - size - 1 : e]) + " " in j for j in joined):
            size += 1
        out.append(size)
    return out


def test_automaton_against_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        found = [licenses.Template(str(k), str(k), rng.choices("abc", k=rng.randrange(1, 25)), False, False) for k in range(4)]
        known = licenses.Automaton(found)
        number = {w: k for k, w in enumerate(known.vocabulary)}
        text = [w for w in rng.choices("abc", k=60) if w in number]
        blocks = defaultdict(list)
        known.scan([number[w] for w in text], 0, [], blocks)
        ends = matching_statistics(text, [t.words for t in found])
        for k, t in enumerate(found):
            for s, e, ts, te in blocks[k]:
                assert text[s:e] == t.words[ts:te] and e - s >= licenses.MIN_WORDS
        # Every right-maximal match is a block of all places that hold it.
        for e, size in enumerate(ends, 1):
            if size >= licenses.MIN_WORDS and (e == len(text) or ends[e] != size + 1):
                for k, t in enumerate(found):
                    for ts in range(len(t.words) - size + 1):
                        if t.words[ts : ts + size] == text[e - size : e]:
                            assert (e - size, e, ts, ts + size) in blocks[k]


def test_notices(spark):
    notice = licenses.NOTICES["mit-permission"][1]
    words = WORD.findall(notice.translate(FOLD))
    edited = " ".join(["Copyright 2020 somebody"] + words[:30] + ["inserted", "words"] + words[30:70])
    half = " ".join(words[: len(words) // 2 - 5])
    docs = [(1, "code " * 5 + notice), (2, edited), (3, half), (4, "permission is hereby granted to nobody"), (5, notice + " and " + notice)]
    rows = {r.doc_id: r for r in licenses.license_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(s.label, s.start, s.end, s.coverage) for s in rows[1].spans] == [("mit", 5, 5 + len(words), 1.0)]
    (span,) = rows[2].spans
    assert (span.start, span.end) == (3, 3 + 70 + 2) and abs(span.coverage - 70 / len(words)) < 1e-9
    assert not rows[3].spans and not rows[4].spans
    assert [(s.start, s.end) for s in rows[5].spans] == [(0, len(words)), (len(words) + 1, 2 * len(words) + 1)]


# ------------------------------------------------------------------ stages of earlier operators


def test_keep_one_drops_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, d), (None, d), (7, a + " more"), (8, None), (8, None)]
    rows = [(i, t, n) for n, (i, t) in enumerate(rows)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(3))
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (2, b), (3, c), (None, d), (8, None), (8, None)])


def test_items_without_an_id_and_blocks_one_at_a_time(spark, monkeypatch):
    passages = [" ".join(f"{x}{i}" for i in range(20)) for x in "abcd"]
    items = [(1, passages[0]), (None, passages[1]), (None, passages[2]), (4, None)]
    docs = [(n, f"x y {p} z") for n, p in enumerate(passages)] + [(None, passages[1]), (None, passages[3]), (0, passages[2]), (9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))

    def found():
        rows = decontaminate.leaks(df, bench).collect()
        return sorted(((r.doc_id, r.text, r.leaks) for r in rows), key=str)

    one = found()
    assert [len(x) for _, _, x in one] == [len([p for p in passages[:3] if p in (t or "")]) for _, t, _ in one]
    assert {h.item_id for _, _, x in one for h in x} == {1, None}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    alive = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: alive.append(v) or broadcast(v))
    assert found() == one and len(alive) > 1
    kept = decontaminate.decontaminate(df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


@pytest.mark.parametrize("small,block,few", [(0, 5, 3), (10, 1000, 1), (64, 7, 16)])
def test_links_are_counted_whatever_the_blocks(spark, monkeypatch, small, block, few):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    monkeypatch.setattr(jaccard, "_FEW", few)
    rng = random.Random(4)
    corpus = {}
    for family, size in enumerate([60, 90, 200]):
        base = [f"f{family}w{rng.randrange(80)}" for _ in range(size)]
        for k in range(35):
            words = list(base)
            for _ in range(rng.randrange(7)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
            corpus[100 * family + k] = " ".join(words[: len(words) - rng.randrange(12)])
    corpus |= {900: corpus[3], 901: None, 902: "alone here", 903: "two of three words now ok", 904: "Two of three words now ok"}
    sets = {}
    for d, text in corpus.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    linked = lambda x, y: x and y and x != y and 4 * len(x & y) >= 3 * len(x | y)
    every = set(sets.values())
    want = {d: sum(bool(linked(own, other)) for other in every) for d, own in sets.items()}
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard.components_of(docs).collect()} == want
    links = jaccard.join_classes(docs).links
    assert links.count() == links.distinct().count() == sum(bool(linked(x, y)) for x in every for y in every) // 2


def test_parities_never_tell_alike_sets_apart():
    rng = np.random.default_rng(8)
    ranks = (np.zeros(jaccard.WORD_CELLS, dtype=np.uint16), np.zeros(jaccard.SHINGLE_CELLS, dtype=np.uint16))
    rows, alike = [], []
    for n in [5, 6, 9, 33, 64, 65, 300, 5000] * 6:
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = base.copy()
        spots = rng.choice(n, rng.integers(0, max(1, n // 20) + 1), replace=False)
        other[spots] = rng.integers(0, 2**63, len(spots), dtype=np.uint64)
        if rng.random() < 0.3:
            other = rng.integers(0, 2**63, n + 2, dtype=np.uint64)
        x, y = jaccard.Set(base, ranks), jaccard.Set(other[: len(other) - int(rng.integers(0, 3))], ranks)
        both = len(np.intersect1d(x.hashes, y.hashes))
        rows.append({"a": b"a%d" % len(rows), "b": b"b", "n_a": x.n, "n_b": y.n, "p_a": x.parity(), "p_b": y.parity()})
        alike.append(4 * both >= 3 * (x.n + y.n - both))
    batch = pa.RecordBatch.from_pylist(rows)
    (kept,) = jaccard._may_be_alike(iter([batch]))
    passed = {r["a"] for r in kept.to_pylist()}
    assert all(r["a"] in passed for r, yes in zip(rows, alike, strict=True) if yes) and any(alike)
    assert len(passed) < len(rows)
