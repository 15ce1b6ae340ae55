"""Defined results of every operator and stage for odd tables: nulls, repeats, empty, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import chat, decontaminate, exact, jaccard, language, lines, mixing, personal, phrases, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(20))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 3),
    (4, "one two", "en", "a", 7),
    (5, LONG, "en", None, len(LONG)),
    (6, LONG, "fr", "b", len(LONG)),
    (6, LONG, "fr", "b", len(LONG)),
    (None, PASSAGE, "en", "b", 5),
    (8, "x y " + PASSAGE, "en", "b", 5),
    (9, "x y " + PASSAGE.upper(), "en", "b", 5),
]
CLASHES = [
    "id", "n", "pos", "token", "gid", "cid", "rep", "root", "a", "b", "u", "v", "key", "size", "target",
    "copies", "base", "p", "block", "held", "_id", "_text", "_size", "_nth", "_drop", "leaf", "flags",
    "leaks", "kept", "host", "path", "x", "shift", "evidence", "posterior", "doc", "text_sha256", "n_lines",
    "n_removed", "print", "packed", "ranges", "component_id", "n_shingles", "class_id", "start", "level",
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (None, "q"), (3, ""), (4, "one two")], "item_id long, text string")


def test_jaccard(odd, empty):
    rows = jaccard.components_of(odd).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 29_996, 5), (6, 29_996, 5)} <= found
    assert {(None, 16, None), (8, 18, None), (9, 18, None)} <= found
    assert jaccard.components_of(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 4, 5, 8]


def test_keep_one_keeps_the_smallest_id(spark):
    docs = spark.createDataFrame([(3, PASSAGE), (2, PASSAGE), (1, "other words here now ok")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 2]


def test_exact(odd, empty):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (5, 6, 3, False), (6, 6, 3, True), (6, 6, 3, False)} <= by
    assert {(8, 9, 2, False), (9, 9, 2, True), (None, None, 1, True)} <= by
    assert {r.text_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert exact.exact_groups(empty).count() == 0


def test_language(odd, empty):
    rows = {(r.doc_id, r.lang_pred, r.held_out) for r in language.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= {x[:2] for x in rows}
    assert all(0 <= r.score <= 1 for r in language.identify(odd).collect())
    assert all(r[2] is False for r in rows if r[0] is None)
    assert language.identify(empty).count() == 0


def test_personal(odd, empty):
    assert personal.personal_data(odd).count() == len(ROWS)
    assert personal.personal_data(empty).count() == 0


def test_decontaminate(odd, empty, benchmark, spark):
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 6]
    nothing = spark.createDataFrame([], benchmark.schema)
    assert decontaminate.decontaminate(odd, nothing).count() == len(ROWS)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


def test_quality(odd, empty, labels):
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    none = quality.keep_good(odd, labels.limit(0))
    assert none.count() == 7  # all texts with words
    assert quality.keep_good(empty, labels).count() == 0


def test_mixing(odd, empty):
    plan = mixing.copies(odd).collect()
    assert len(plan) == len(ROWS)
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in plan)
    mixed = mixing.mix(odd)
    assert sorted(mixed.columns) == sorted(odd.columns)
    assert mixed.count() == sum(r.copies > 0 for r in plan)
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_lines(odd, empty, spark):
    out = lines.drop_recurring(odd)
    assert out.count() == len(ROWS) and set(odd.columns) <= set(out.columns)
    assert {r.text for r in out.collect()} == {r[1] for r in ROWS}
    assert lines.drop_recurring(empty).count() == 0
    text = "a b c d\nkeep {0} this line of its own\nerror at 1{0}:00 in module\n"
    docs = spark.createDataFrame([(i, text.format(f"x{chr(97 + i)}" if i else "xq")) for i in range(6)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lines.drop_recurring(docs).collect()}
    assert rows[0].n_removed == 0 and rows[0].text == text.format("xq")
    assert all(rows[i].n_removed >= 1 and "a b c d" not in rows[i].text and "keep" in rows[i].text for i in range(1, 6))


def test_phrases(odd, empty):
    rows = phrases.cut_phrases(odd).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.n_words, r.n_removed) for r in rows}
    assert {(1, 0, 0), (5, 30_000, 0), (6, 30_000, 30_000), (None, 20, 0), (8, 22, 20), (9, 22, 0)} <= by
    assert phrases.cut_phrases(empty).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, node string, chain string, depth string"
    rows = [
        (1, 0, "user", "hi", "", "", ""), (1, 1, "assistant", None, "", "", ""), (2, 0, "user", "hi", "", "", ""),
        (2, None, None, "<s>[user] \\ x</s>", "", "", ""), (None, 0, "user", "hi", "", "", ""), (None, 0, "user", "hi", "", "", ""),
    ]
    turns = spark.createDataFrame(rows, schema)
    forest = chat.prefix_forest(turns)
    back = {r.conv_id: r for r in chat.read_back(forest).collect()}
    digest = lambda ts: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
    assert back[1].turns_sha256 == digest([("user", "hi"), ("assistant", "")]) and back[1].loss_chars == 0
    assert back[2].turns_sha256 == digest([("", "<s>[user] \\ x</s>"), ("user", "hi")])
    assert back[None].n_turns == 2
    assert chat.read_back(chat.prefix_forest(turns.limit(0))).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd, empty, labels, benchmark, tmp_path, name):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, empty):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out", mode="overwrite")
        if name != "mixing sources":
            assert out.columns == docs.columns
        assert docs is odd or out.count() == 0
