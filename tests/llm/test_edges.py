"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns, and an empty table."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auralake.llm import bpe, chat, flac, packing, passages, pii, quality, simhash, suffixtree, tokenshards

BYTES, WORDS = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("word_bpe_49k.json")
ON_DOCUMENTS = {
    "quality": quality.quality_rules,
    "pii": pii.personal_data,
    "packing": packing.best_fit,
    "packed": packing.packed_texts,
    "tree": lambda d: suffixtree.scores(d, F.col("doc_id") == 4),
    "flac": flac.digests,
    "simhash": simhash.groups,
    "bpe": lambda d: bpe.encoded(d, BYTES),
    "shards": lambda d: tokenshards.token_shards(d, WORDS),
}


@pytest.mark.parametrize("name", [*ON_DOCUMENTS, "passages"])
def test_empty_table(nothing, name):
    assert ON_DOCUMENTS.get(name, passages.shared_passages)(nothing).count() == 0


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_a_row_for_each_row(awkward, name):
    rows = ON_DOCUMENTS[name](awkward).collect()
    ids = [r["doc_id"] for r in rows]
    if name in ("packed", "packing"):
        assert sorted(r["doc_id"] for r in rows if r["piece"] == 0) == [1, 2, 3, 4, 5, 6, 6, 7, 8]
        fill = {}
        for r in rows:
            fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["n_tokens"]
        assert all(fill[r["bin_id"]] <= r["bin_capacity"] for r in rows)
    else:
        assert sorted(ids) == [1, 2, 3, 4, 5, 6, 6, 7, 8]


def test_passages_of_awkward_rows(awkward):
    rows = {(r["doc_id"], r["kept"]) for r in passages.shared_passages(awkward).collect()}
    assert {(5, True), (6, False), (8, False)} <= rows and not {r[0] for r in rows} & {1, 2, 3, 4, 7}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, awkward, nothing, stage):
    for frame in (awkward, nothing):
        out = stage(spark, frame, "")
        assert out.columns == frame.columns
        assert out.count() <= frame.count()


def test_rows_with_null_or_repeated_ids(spark):
    text = lambda name, n=80: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (6, text("c")), (6, text("c")), (6, text("d", 5000)), (7, text("c")), (8, text("b"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[3], rows[5], rows[7]], key=str)
    packed = packing.packed_texts(frame).collect()
    assert sorted(r.text for r in packed if r.piece == 0 and r.doc_id is None) == [rows[0][1], rows[1][1], rows[2][1]]
    assert len(packed) == 9 and "".join(r.text for r in sorted(packed, key=lambda r: r.piece) if r.text.startswith("d")) == rows[5][1]


def test_packing_stage(spark, awkward, nothing):
    stage = corpus_pipeline.STAGES[-1][1]
    rows = stage(spark, awkward, "").collect()
    of = lambda i: "".join(r.text for r in sorted(rows, key=lambda r: (r.bin_id, r.piece)) if r.doc_id == i)
    assert of(1) == of(2) == "" and of(3) == "  \n\t" and of(4) == "one two three" and len(of(6)) == 2 * len(of(5))
    assert len([r for r in rows if r.doc_id == 7]) == 15
    assert stage(spark, nothing, "").count() == 0


def test_columns_of_any_name_stay(spark):
    """Names that operators use inside do not clash with columns of the input."""
    text = " ".join(f"w{i}" for i in range(70))
    names = ["_cut", "_gone", "_row", "cut", "row", "left", "key", "print", "first", "root", "_lang", "_source", "_counts", "n_words", "kept", "pieces"]
    frame = spark.createDataFrame([(i, text, "en", "s", *map(str, range(len(names)))) for i in range(3)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, frame, "").collect()
        assert len(rows) == (1 if name in ("near_duplicates", "passages") else 3)
        assert all(r[n] == str(i) for r in rows for i, n in enumerate(names))


def test_chat_with_nulls(spark):
    turns = spark.createDataFrame([(0, "chosen", 0, None, None), (0, "rejected", 0, None, None), (1, "chosen", 0, "user", "q"), (None, "chosen", 0, "user", "q")], "pair_id long, side string, turn long, role string, text string")
    assert [(r.pair_id, r.part) for r in chat.segments(turns).collect()] == [(0, "prompt")]
    assert chat.segments(turns.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "_", "one.1-", "a.", "[ ", "_at_", "1 ", "+1", "a@b.c ", "one two ", " . a", "(at", "..@"])
def test_personal_data_of_long_runs(unit):
    """Time grows with the text; a few seconds are far below what any other growth would take."""
    text = (unit * 400_000)[:400_000] + " x @ y.com "
    began = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("unit", ["xy", "a", "=-", "1234567890", "\u00e9\u6f22", "etaoinshrdlu", "b64"])
def test_byte_bpe_of_long_words(unit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rng = random.Random(1)
    text = "".join(rng.choice(string.ascii_letters + "+/") for _ in range(200_000)) if unit == "b64" else "".join(rng.choice(unit) for _ in range(200_000)) if len(unit) > 10 else (unit * 200_000)[:200_000]
    began = time.perf_counter()
    assert bpe.coder(BYTES).ids(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - began < 20


def test_openings_with_nulls_are_told_apart(spark):
    """A null role or text opens unlike an empty one, and unlike the other one's null."""
    first = [(1, None, "x"), (2, "x", None), (3, "", "x"), (4, None, "x"), (5, "x", None), (6, "", "x"), (7, "x", "")]
    rows = [(i, 0, role, text) for i, role, text in first] + [(i, 1, "user", "q") for i, _, _ in first] + [(1, 1, "user", "q"), (None, 0, "user", "lost")]
    frame = spark.createDataFrame([(*r, "p", 1, "k") for r in rows], "conv_id long, turn long, role string, text string, pair_id string, key int, part string")
    found = chat.paired(frame)
    pairs = {(r.pair_id, r.side) for r in found.collect()}
    assert pairs == {(i, s) for i in (1, 2, 3, 7) for s in ("chosen", "rejected")}
    assert {r.pair_id for r in chat.segments(found).where("part = 'prompt' and place = 1").collect()} == {1, 2, 3, 7}
    assert chat.paired(frame.limit(0)).count() == 0


def test_long_turns_and_repeated_rows(spark):
    long = "word " * 200_000
    rows = [(0, side, turn, "assistant", long + side * turn) for side in ("chosen", "rejected") for turn in (0, 1)] + [(0, "chosen", 1, "assistant", long + "chosen")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "pair_id long, side string, turn long, role string, text string, segment string, place int")
    parts = chat.segments(frame)
    assert sorted((r.part, r.place) for r in parts.select("part", "place").collect()) == [("chosen", 2), ("chosen", 3), ("prompt", 1), ("rejected", 2)]
    whole = chat.assembled(parts).first()
    assert whole.chosen.count("<|assistant|>") == 2 and len(whole.chosen_mask) == 2 and whole.chosen[whole.chosen_mask[0].start : whole.chosen_mask[0].end] == long + "chosen\n"
