"""Importance draws against plain loops over n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from auralake.llm import common, importance, queries

FOLDER = "/root/testdata/sf0.001"


def _features(text, n=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _plainly(documents, target, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in documents for f in _features(t)[1])
    t = Counter(of(f) for x in target for f in _features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in documents:
        words, features = _features(text)
        weight = sum(gain[of(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(able[: 5 * len(able) // 100]):
        row[4] = place + 1
    return [tuple(r[:5]) for r in rows]


def test_query_against_plain_loops(spark):
    documents = [(r.doc_id, r.text) for r in common.read(spark, FOLDER, "documents").collect()]
    target = [r.text for r in common.read(spark, FOLDER, "benchmark").collect()]
    found = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in queries.queries()["op13_importance_draw"](spark, FOLDER).collect()]
    assert sorted(found) == sorted(_plainly(documents, target))
    assert sum(r[4] is not None for r in found) > 5


def test_awkward_rows(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["One", "two", "drei", "vier-5", "été", "Ünf", "x_y", "😀", "w" * 300]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(None, text(30)), (300, None), (301, ""), (302, "!? \n"), (303, text(30_000))]
    same = text(25)
    rows += [(400, same), (400, same), (401, same)]
    frame = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in rows], "doc_id long, text string, score int, low double, place string").repartition(5)
    target = [text(40), None, "", "été vier"]
    found = importance.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    mine = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found]
    order = lambda r: (r[0] is None, r[0] or 0, r[4] or 0)
    assert sorted(mine, key=order) == sorted(_plainly(rows, target), key=order)
    nothing = importance.resampled(frame.limit(0), spark.createDataFrame([], "text string"))
    assert nothing.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and nothing.count() == 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_runs_hold_every_occurrence(n):
    rng = random.Random(n)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    found = importance.runs(pa.array(texts), n, 1 << 30)
    for k in range(1, n + 1):
        want = Counter(" ".join(t.split()[i : i + k]) for t in texts for i in range(len(t.split()) - k + 1))
        got = sorted(zip(found.buckets[k - 1].tolist(), found.lengths[k - 1].tolist(), strict=True))
        assert got == sorted((zlib.crc32(f.encode()) % (1 << 30), c) for f, c in want.items())
        assert (found.at[k - 1] >= 0).sum() == sum(want.values())


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    for top in (3, 1 << 40):
        ids = rng.integers(1, top, 400)
        ids[200:300] = ids[50:150]
        left = np.repeat([100, 400], [100, 300]) - np.arange(400)
        order, common_prefix = importance.suffixes(ids, left, 4)
        tails = [tuple(ids[i : i + min(4, left[i])].tolist()) for i in order]
        assert tails == sorted(tails)
        for a, b, got in zip(tails, tails[1:], common_prefix[1:].tolist(), strict=False):
            assert got == next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)


def test_joined_checksums():
    rng = random.Random(8)
    for size in (0, 1, 7, 63, 64, 65, 1000, 70_000):
        a, b = rng.randbytes(10), rng.randbytes(size)
        got = importance.SHIFTS(np.array([zlib.crc32(a)], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)
