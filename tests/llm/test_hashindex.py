"""The extendible-hash index against dictionaries, and with keys that collide."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import hashindex


def _plainly(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row."""
    groups = {}
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]


def _rows(n, seed):
    rng = random.Random(seed)
    gap = lambda: rng.choice([" ", "  ", "\n", " \t", "\r\n ", "\v", "\f"])
    rows = [(i, gap().join(rng.choice(["a", "b", "é", "\x85", "\xa0", "cc"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", " ", "\n"])) for i in range(n)]
    return [*rows, (None, "no id"), (None, "no id"), (None, "a"), (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "\n\t"), (n + 4, "long text " * 50_000), (n + 5, "long  text " * 50_000), (7, rows[7][1])]


KEYS = {"xxhash64": F.xxhash64, "few": lambda t: F.shiftleft(F.pmod(F.xxhash64(t), F.lit(5)).cast("long"), 60), "one": lambda t: F.length(t).cast("long") * 0}


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("hot", [2, 1000])
def test_duplicates_against_a_dictionary(spark, monkeypatch, key, hot):
    monkeypatch.setattr(hashindex, "HOT", hot)
    rows = _rows(300, 3)
    frame = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, key int, least string, n double").repartition(7)
    found = hashindex.duplicates(frame, capacity=200, key=KEYS[key]).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=order) == sorted(_plainly(rows), key=order)
    kept = [r for r in found if r.kept]
    assert len({r.text_sha256 for r in found}) == len(kept) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    out = hashindex.duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_string_ids(spark):
    frame = spark.createDataFrame([("b", "x  y"), ("a", "x\ny"), ("c", "z")], "doc_id string, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in hashindex.duplicates(frame).collect()) == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


@pytest.mark.parametrize("key", ["xxhash64", "few"])
def test_later_insertions(spark, tmp_path, key):
    """Buckets split, the directory doubles, and a new reader of the folder finds what all insertions gave."""
    rng, seen = random.Random(1), []
    folder = str(tmp_path / "index")
    depths = []
    for step in range(4):
        rows = [(1000 * (3 - step) + i, f"text {rng.randint(0, 150 * (step + 1))} " + "pad " * 5) for i in range(120)]
        seen += rows
        frame = spark.createDataFrame(rows, "least long, text string")
        index = hashindex.HashIndex(spark, folder, capacity=600, key=KEYS[key])
        assert index.version == step - 1
        index.insert(frame, frame.select(KEYS[key](F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("size")))
        depths.append(index.directory.depth)
    assert depths == sorted(depths) and depths[-1] > depths[0]
    index = hashindex.HashIndex(spark, folder, capacity=600, key=KEYS[key])
    assert index.version == 3
    want = {}
    for i, t in seen:
        least, n = want.get(t, (i, 0))
        want[t] = min(least, i), n + 1
    entries = index.entries().collect()
    assert {r.text: (r.least, r.n) for r in entries} == want and len(entries) == len(want)
    keys = {}
    for r in entries:
        keys.setdefault(r.key, []).append(r)
    assert all(sorted(r.chain for r in own) == list(range(own[0].links)) for own in keys.values())
    bucket = index.directory.buckets(np.array([r.key for r in entries]))
    assert bucket.tolist() == [r.bucket for r in entries]
    asked = spark.createDataFrame([(1, seen[0][1]), (2, "never  seen"), (3, seen[-1][1].replace(" ", "\t"))], "doc_id long, text string")
    assert {r.doc_id: (r.least, r.n) for r in index.look_up(asked).collect()} == {1: want[seen[0][1]], 2: (None, None), 3: want[seen[-1][1]]}


def test_directory_doubles_and_splits():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 10, 256)
    cells[17] = 500
    directory = hashindex.Directory()
    directory.grow(cells, 60)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    cell = (keys.view(np.uint64) >> np.uint64(56)).astype(int)
    found = directory.buckets(keys)
    for b, (prefix, depth) in enumerate(zip(directory.prefixes, directory.depths, strict=True)):
        inside = (cell >> 8 - depth) == prefix
        assert ((found == b) == inside).all()
        load = cells[prefix << 8 - depth : prefix + 1 << 8 - depth].sum()
        assert load <= 60 or depth == 8
    assert directory.depth == max(directory.depths) == 8
    again = hashindex.Directory.of(directory.prefixes, directory.depths)
    assert (again.slots == directory.slots).all()
