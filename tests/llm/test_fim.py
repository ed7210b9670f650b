"""Fill-in-middle against slicing of strings, and the automaton against plain counting."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from auralake.llm import common, fim, queries

ALPHABET = ["a", "b", " ", "\n", "\t", "<", "P", "S", "M", ">", "é", "€", "😀", "\x00", "<P>", "<M", "S>", "<S"]


def _texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def _units(text, unit):
    """The first character of each unit."""
    if unit == "char":
        return list(range(len(text)))
    if unit == "line":
        return [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
    return sorted({0, *[m.start() for m in re.finditer(r"[^ \t-\r]+", text)]}) if text else []


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("most", [3, 40, 3000])
def test_automaton_counts_units_points_and_sentinels(unit, most):
    texts = _texts(60, most, most)
    data, bounds = common.utf8(pa.array(texts))
    counted = fim.automaton(unit, fim.SENTINELS).scan(data, bounds)
    for i, text in enumerate(texts):
        own = counted[bounds[i] : bounds[i + 1]]
        byte_of = np.cumsum([0, *[len(c.encode()) for c in text]])
        assert np.flatnonzero(own & fim.POINT).tolist() == byte_of[:-1].tolist()
        assert np.flatnonzero(own & fim.SENTINEL).tolist() == [byte_of[m.end()] - 1 for m in re.finditer(r"<[PSM]>", text)]
        assert np.flatnonzero(own & fim.UNIT).tolist() == byte_of[_units(text, unit)].tolist(), text


def test_sentinels_of_several_bytes():
    own = fim.Automaton("char", ("«P»", "«Pre»", "«M»"))
    text = "a««P»«Pre««M» «Pr«P»"
    data, bounds = common.utf8(pa.array([text]))
    ends = np.flatnonzero(own.scan(data, bounds) & fim.SENTINEL).tolist()
    assert ends == [len(text[: m.end()].encode()) - 1 for m in re.finditer("«P»|«Pre»|«M»", text)]


def _plainly(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_against_slices(spark):
    rows = [*enumerate(_texts(400, 60, 5)), (400, None), (401, ""), (None, "no id"), (402, "long é " * 40_000), (403, "same"), (403, "same")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    found = fim.restored(fim.fill_in_middle(frame)).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(((r.doc_id, r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(((i, t or "", *_plainly(i, t)) for i, t in rows), key=key)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_fall_between_units(spark, unit):
    rows = [(i, t) for i, t in enumerate(_texts(300, 200, 9))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in fim.restored(fim.fill_in_middle(frame, unit, seed=3, rate=100, spm=50)).collect():
        text = rows[r.doc_id][1]
        assert r.restored == text and r.n == len(_units(text, unit))
        if r.form != "plain":
            ends = {*_units(text, unit), 0, len(text)}
            assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends


def test_sentinels_must_not_arise_at_cuts():
    with pytest.raises(ValueError, match="first character"):
        fim.fill_in_middle(None, sentinels=("aPa", "<S>", "<M>"))
    with pytest.raises(ValueError, match="not of the form"):
        fim.rebuilt("<P>a<M>b", "psm")


def test_query_has_a_row_for_each_document(spark):
    rows = queries.queries()["op12_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == common.read(spark, "/root/testdata/sf0.001", "documents").count()
