"""Operators against brute force, exact round trips and held-out rows."""

import random
import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import chat, decontaminate, exact, jaccard, language, lines, mixing, personal, phrases, quality, words
from sievework.operators.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})


def fold(text):
    return (text or "").translate(FOLD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# ------------------------------------------------------------------------- words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBé \t\n\x0bz", max_size=30), max_size=8), st.booleans())
def test_words(found, small):
    old = words.BLOCK
    words.BLOCK = 16 if small else old
    try:
        seen = {}
        for text, (hashes, starts, ends) in zip(found, words.documents_words(pa.array(found, pa.string()), True), strict=True):
            data = text.encode()
            expected = [w.encode() for w in WORD.findall(text)]
            assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == expected
            for w, h in zip(expected, hashes, strict=True):
                assert seen.setdefault(fold(w.decode()), h) == h
        assert len(set(seen.values())) == len(seen)
    finally:
        words.BLOCK = old


# ---------------------------------------------------------------------- 1 jaccard


def shingle_set(text):
    w = WORD.findall(fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = len(sets[a]), len(sets[b])
            if 4 * min(x, y) >= 3 * max(x, y):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (x + y - both):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"new{rng.random()}"], [out[at], out[at]], [rng.choice(base)]])
    return " ".join(out)


def test_jaccard_against_brute_force(spark, texts):
    rng = random.Random(5)
    corpus = dict(texts)
    for family in range(3):
        base = [f"f{family}w{rng.randrange(60)}" for _ in range(rng.choice([12, 60, 150]))]
        for k in range(60):
            corpus[10_000 + 100 * family + k] = edited(rng, base, rng.randrange(12))
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()}
    assert found == brute_components(corpus)


def test_salted_postings_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    corpus = {k: edited(rng, base, rng.randrange(5)) for k in range(80)}
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()}
    assert found == brute_components(corpus)


def test_every_link_is_found(spark):
    rng = random.Random(9)
    corpus = {}
    for family in range(2):
        base = [f"f{family}w{rng.randrange(60)}" for _ in range((70, 120)[family])]
        for k in range(40):
            corpus[100 * family + k] = edited(rng, base, rng.randrange(8))
    corpus |= {500: corpus[3], 501: "", 502: "a b c"}
    sets = {d: shingle_set(t) for d, t in corpus.items()}
    expected = {}
    for d, own in sets.items():
        others = {x for x in sets.values() if own and x and x != own and 4 * len(own & x) >= 3 * len(own | x)}
        expected[d] = len(others)
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard.components_of(df).collect()} == expected
    found = jaccard.join_classes(df)
    by_set = {sets[d]: n for d, n in expected.items()}
    assert found.links.count() == found.links.distinct().count() == sum(by_set.values()) // 2
    few = jaccard.keep_one(df)
    smallest = {d for d, (n, root) in brute_components(corpus).items() if not n or d == root}
    assert {r.doc_id for r in few.collect()} == smallest


def test_texts_without_an_id_are_told_apart(spark):
    one, two = ([f"{c}{k}" for k in range(30)] for c in "ab")
    rows = [(None, one), (None, two), (5, one[:-1]), (6, two[:-1]), (7, [f"c{k}" for k in range(30)]), (7, one[1:])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    # classes: `one` and its two shorter forms, each linked with the others; `two` and its shorter form; c
    found = sorted((r.doc_id or 0, r.n_links) for r in jaccard.components_of(df).collect())
    assert found == [(0, 1), (0, 2), (5, 2), (6, 1), (7, 0), (7, 2)]


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components(df).collect()}
    root = {n: n for e in links for n in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in links)}


# --------------------------------------------------------------------- 2 language


def test_language_on_held_out_rows(spark, documents):
    rows = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 20 and sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    junk = spark.createDataFrame([(2, "zxqj kvvw qqxz jjkw wwqx zzvk " * 20)], "doc_id long, text string")
    everything = documents.select("doc_id", "text", "lang").unionByName(junk.withColumn("lang", F.lit(None).cast("string")))
    marked = {r.cross_entropy: r.rejected for r in language.identify(everything).collect()}
    assert marked[max(marked)] is True


def test_kneser_ney_sums_to_one():
    learned = {x: np.unique(language.grams(language.symbols(t)), return_counts=True) for x, t in (("a", "abba abab cab " * 9), ("b", "dada bead ade"))}
    model = language.KneserNey(learned)
    alphabet = {int(c) for c in model.grams[1]}
    for context in ("abb", " da", "zzz", "  a"):
        base = 0
        for c in context:
            base = base << 16 | ord(c)
        seen = np.exp(model.log_probs(np.array([base << 16 | c for c in alphabet], dtype=np.uint64)).astype(float)).sum(axis=0)
        unseen = np.exp(model.log_probs(np.array([base << 16 | ord("q")], dtype=np.uint64)).astype(float))[0]
        assert np.allclose(seen + unseen, 1, atol=1e-4)


def test_predictions_read_the_text_only(spark, documents):
    other = documents.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    model = language.train(documents.filter(~language.held_out(F.col("doc_id"))))
    a = {r.doc_id: r.lang_pred for r in language.predict(documents, model).collect()}
    b = {r.doc_id: r.lang_pred for r in language.predict(other, model).collect()}
    assert a == b


def test_no_gram_is_left_out_of_a_large_model(spark):
    rng = random.Random(12)
    rows = [(4 * i, "common", " ".join(rng.choice(["abba", "cab", "bead", "dab"]) for _ in range(60))) for i in range(40)]
    rows += [(1000, "rare", "xylo quiz jynx"), (1001, None, "quiz xylo"), (1001, None, "quiz xylo"), (None, None, "a cab"), (1002, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = {}
    for lang in ("common", "rare"):
        found = np.concatenate([language.grams(language.symbols(t)) for _, x, t in rows if x == lang])
        learned[lang] = np.unique(found, return_counts=True)
    whole = language.KneserNey(learned)
    for max_grams in (1 << 21, 60):
        model = language.train(docs, max_grams)
        assert model.langs == ["common", "rare"] and (model.n_blocks > 1) == (max_grams == 60)
        out = language.predict(docs, model).collect()
        assert len(out) == len(rows)
        expected = {}
        for doc_id, _, text in rows:
            sums = whole.log_probs(language.grams(language.symbols(text))).astype(float).sum(axis=0)
            expected[doc_id] = whole.langs[sums.argmax()], -sums.max() / max(len(language.symbols(text)), 1)
        for r in out:
            if r.n_symbols:
                assert r.lang_pred == expected[r.doc_id][0] and abs(r.cross_entropy - expected[r.doc_id][1]) < 1e-4
        assert {r.lang_pred for r in out if r.doc_id in (1000, 1001)} == {"rare"}


# --------------------------------------------------------------------- 3 personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["4321559386017072", "4321 5593 8601 7072", "1.2.3.4", "300.1.1.1", "a@b.c", "x.y@z", "+1 (958) 555-1762", "+49", "@", "..", "é", " "]


def brute_spans(text):
    found = {}
    for kind, regex in BASE.items():
        found[kind] = []
        for m in re.finditer(regex, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and personal.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                found[kind].append(m.span())
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(alphabet="0123456789.. -+@aZ_()", max_size=20), max_size=8))
def test_personal_base_against_regexes(parts):
    text = "".join(parts)
    found = personal.spans(text)
    assert {k: found[k] for k in personal.BASE} == brute_spans(text)


def test_personal_extras_and_corpus(texts):
    found = personal.spans("see https://a.example.org/x?y=1 or IBAN: NZ12 3456 7890 1234, account no. 12-3456-789")
    assert len(found["url"]) == 1 and len(found["account"]) == 2
    assert not any(personal.spans("plain words, nothing else to see. $$$ *** 12:30").values())
    for text in texts.values():
        found = personal.spans(text)
        assert {k: found[k] for k in personal.BASE} == brute_spans(text)


def test_account_cues_in_any_case():
    for text in (
        "Account Number: 12345678", "Account No. 12345678", "ACCOUNT No 12345678", "Routing Number 021000021",
        "Passport No 1234567", "rOuTiNg nUmBeR 021000021", "Iban NZ12 3456 7890 1234", "Acct NO. 12345678",
    ):
        for before in ("", "İ é "):
            found = personal.spans(before + text)["account"]
            assert len(found) == 1 and (before + text)[slice(*found[0])].replace(" ", "").isalnum(), text
    assert not personal.spans("see HTTP://A.EXAMPLE account of ab12 3456")["url"]


# ------------------------------------------------------------------------- 4 chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab[]<\\/s> ", max_size=8), st.text(alphabet="ab[]<\\/s>\n ", max_size=20)), max_size=5))
def test_template_round_trip(turns):
    assert chat.read_turns("".join(chat.turn_piece(*t)[0] for t in turns)) == turns


def test_prefix_forest(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"t{rng.randrange(2)}"))
    forest = chat.prefix_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by_conv = defaultdict(list)
    for conv, _, role, text in sorted(rows):
        by_conv[conv].append((role, text))
    prefixes = {tuple(t[: k + 1]) for t in by_conv.values() for k in range(len(t))}
    nodes = chat.emitted(forest).collect()
    assert len(nodes) == len(prefixes)  # every shared turn once
    place = {bytes(r.node): k for k, r in enumerate(nodes)}
    open_path = []
    for r in nodes:  # depth-first: the parent is on the path just walked
        del open_path[r.depth :]
        assert (bytes(r.parent) if r.parent else None) == (open_path[-1] if open_path else None)
        open_path.append(bytes(r.node))
    chain_text = defaultdict(str)
    for r in nodes:
        chain_text[r.chain] += r.piece
    parents = {bytes(r.node): r for r in nodes}
    for r in nodes:  # what a node attends to is its conversation up to itself
        chain, up = [], r
        while up is not None:
            chain.append(up.piece)
            up = parents[bytes(up.parent)] if up.parent else None
        text = "".join(reversed(chain))
        assert "".join(chain_text[i.chain][i.start : i.end] for i in r.attends) == text
        assert r.pos_end == len(text) and r.pos_start == len(text) - len(r.piece)
    assert len(place) == len(nodes)


# --------------------------------------------------------------- 5 decontamination


def test_leaks_against_brute_force(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rng = random.Random(9)
    corpus = list(texts.values())[:80]
    for text in list(items.values())[:20]:
        w = text.split()
        for k in (0, 1, 2, 3):
            changed = list(w)
            for _ in range(k):
                changed[rng.randrange(len(w))] = "zz"
            corpus.append("before this " + " ".join(changed) + " and after")
    index = decontaminate.Index(list(items.items()))
    bags = {}
    for item, text in items.items():
        w = WORD.findall(fold(text))
        bags[item] = (len(w), Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    n = 0
    for text, (w, _, _) in zip(corpus, words.documents_words(pa.array(corpus), True), strict=True):
        found = {i: round(s, 9) for i, _, _, s in index.matches(w, 0.75)}
        tokens, expected = WORD.findall(fold(text)), {}
        for item, (size, bag) in bags.items():
            for at in range(len(tokens) - size + 1):
                own = Counter(tuple(tokens[i : i + 5]) for i in range(at, at + size - 4))
                shared = sum((own & bag).values())
                if shared and (sim := shared / sum((own | bag).values())) >= 0.75:
                    expected[item] = round(max(sim, expected.get(item, 0)), 9)
        assert found == expected
        n += len(found)
    assert n > 20


def test_items_cut_at_either_end():
    item = [f"w{k}" for k in range(40)]
    index = decontaminate.Index([(7, " ".join(item)), (8, " ".join(f"v{k}" for k in range(45)))])
    for own, leak in ((item[:-2], True), (item[2:], True), (item[1:-2], True), (item[:32], True), (item[:30], False), (item[:4], False)):
        (words_, _, _), = words.documents_words(pa.array([" ".join(own)]), True)
        found = index.matches(words_, 0.75)
        assert [(i, at, n) for i, at, n, _ in found] == ([(7, 0, len(own))] if leak else [])
        assert not leak or found[0][3] == (len(own) - 4) / 36


def test_lookup_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 20).astype(np.uint64)) for _ in range(30)]
    level = decontaminate._Length(24, list(range(30)), sets)
    prints = level.prints.copy()
    for k in range(len(prints)):
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    w, i = level.lookup(prints)
    assert set(zip(range(30), range(30), strict=True)) <= set(zip(w.tolist(), i.tolist(), strict=True))


# ----------------------------------------------------------------- 6 exact, 7 quality


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60))
def test_fingerprints_compose(left, right):
    data = np.frombuffer(left + right, dtype=np.uint8)
    whole = int(exact.fingerprints(data, np.array([0, len(data)]))[0])
    parts = []
    for piece in (left, right):
        value = int(exact.fingerprints(np.frombuffer(piece, dtype=np.uint8), np.array([0, len(piece)]))[0])
        parts.append((value >> 31, value & (2**31 - 1)))
    joined = [exact.combine(a, b, len(right), k) for k, (a, b) in enumerate(zip(*parts, strict=True))]
    assert whole == joined[0] << 31 | joined[1]


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "ab"), (5, "ba")], "doc_id long, text string")
    real = exact.materialise

    def blurred(df, label):
        return real(df.withColumn("print", F.lit(0).cast("long")) if label == "exact-prints" else df, label)

    monkeypatch.setattr(exact, "materialise", blurred)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert found == {(1, 3, 2, False), (3, 3, 2, True), (2, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)}


def test_quality_on_unseen_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = quality.measured(docs)
    judged = quality.judged(rows, quality.train(rows, labels.filter(seen))).select("doc_id", "kept")
    tested = judged.join(labels.filter(~seen), "doc_id").collect()
    good = [r.kept for r in tested if r.quality == 1]
    bad = [r.kept for r in tested if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_sparse_sites_shrink_to_their_parents(spark):
    words_of = lambda k: " ".join(f"w{i * k}" for i in range(30))
    rows = [(i, words_of(i + 1) if i % 10 else "#" * 9 + " ## !! ##", "big", "p") for i in range(200)]
    rows += [(900, "#### !! ###", "small", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.select("doc_id", (~F.col("text").contains("#")).cast("int").alias("quality"))
    model = quality.train(quality.measured(docs), labels)
    shift = {r.host: r["shift"] for r in model.sites.collect()}
    assert abs(shift["big"]) < 0.5 and shift["small"] > -6


# ----------------------------------------------------------------- 8 mixing, 9 lines


def test_targets_are_filled_by_weight(spark):
    rng = random.Random(10)
    rows = [(s, rng.randrange(1, 500)) for s in (None, "a", "b", "c", "d", "e") for _ in range(rng.randrange(1, 40))]
    sized = spark.createDataFrame(rows, "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(sized, (5, 2, 1), 1.5, 2.0).collect()}
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, active = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and active:  # share by weight, cap, share the excess again
        total = sum(weight[s] for s in active)
        given_out = {s: left * weight[s] / total for s in active}
        left = 0.0
        for s, more in given_out.items():
            target[s] += more
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                active.discard(s)
    assert found == pytest.approx(target)


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.copies(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.copies(docs.repartition(3)).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))


def test_rounding_is_fair(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(12):
        for r in mixing.copies(docs, weights=(1, 1), share=0.5, block=8, seed=seed).collect():
            total[r.doc_id] += r.copies
    assert len(total) == 60 and 4 < np.mean(list(total.values())) < 8 and max(total.values()) < 12


def test_template_masks_variable_fields(spark):
    rows = ["job 17 done in 5s ok now", "job 18 done in 77s ok now", "job x done in 5s ok now", "  job\t9  done in 1 ok then"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, line string")
    found = {r.i: (r.leaf.n_words, r.leaf.path) for r in df.select("i", lines.template(F.col("line")).alias("leaf")).collect()}
    assert found[0] == found[1] == found[3] != found[2]


# ----------------------------------------------------------------------- 10 phrases


def brute_cut(texts):
    first = {}
    for d in sorted(texts):
        w = texts[d].split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    out = {}
    for d, t in texts.items():
        w = t.split()
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("hot,salt", [(1000, 200_000), (2, 3)])
def test_phrases_against_brute_force(spark, monkeypatch, hot, salt):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "SALT_ROWS", salt)
    rng = random.Random(11)
    shared = [" ".join(f"s{k}_{rng.randrange(9)}" for _ in range(rng.choice([13, 14, 60]))) for k in range(4)]
    texts = {}
    for d in range(120):
        parts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(20))) for _ in range(3)]
        texts[d] = "  ".join(x for p in parts for x in (p, rng.choice([*shared, "", " ".join(rng.choice(shared).split()[2:])])))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrases.cut_phrases(df).collect()}
    assert found == brute_cut(texts)


def test_shards_find_every_occurrence():
    rng = random.Random(12)
    shard, rows = phrases._Shard(), []
    for doc in range(30):
        line = [rng.choice("abc") for _ in range(rng.randrange(13, 22))]
        rows.append((doc, line))
        shard.add(doc, 0, 100, " ".join(line))
    covered = defaultdict(set)
    for doc, _, a, b in shard.ranges():
        covered[doc].update(range(a - 100, b - 100))
    expected = brute_cut({d: " ".join(x) for d, x in rows})
    assert {d: len(covered[d]) for d, _ in rows} == {d: expected[d][1] for d, _ in rows}


def test_anchors_are_window_minima():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 2**63, 200).astype(np.uint64)
    grams = words.shingles(w, phrases.ANCHOR)
    span = phrases.WINDOW - phrases.ANCHOR + 1
    expected = [grams[i : i + span].min() for i in range(len(w) - phrases.WINDOW + 1)]
    assert phrases.anchors(w).tolist() == [int(x) for x in expected]
    assert len(phrases.anchors(w[:12])) == 0 and ahocorasick.unicode == 1
