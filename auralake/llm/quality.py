"""Operator 1: quality rules whose thresholds come from quantile sketches of each language and source.

Each ratio of a document falls into a logarithmic bucket (bucket ``b`` holds values up to
``GAMMA**b``, so a quantile read off the buckets is within 1 % of the value). A sketch is the table
of bucket counts; sketches merge by adding counts, in any order, and give the same answer however
the rows are dealt. The sketches of (lang, source), of lang, and of everything come from one
aggregation: the coarser ones are merged from the finer ones. They hold the documents that pass the
base rules, so that junk does not widen its own bounds.

A ratio's bound lies beyond a high quantile of its group, by a multiple of that quantile's distance
from the median; only where a group hardly varies does a small least distance from the median count.
A group's bound is drawn towards that of its language, as if ``PRIOR`` more documents had the
language's, and a language's towards that of the corpus in the same way: small groups follow their
parents, large ones themselves, with no switch between.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Relative error of the sketch, and the ratio of neighbouring bucket bounds.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Values up to this count as zero and share one bucket.
TINY = 1e-6
ZERO_BUCKET = -10_000
#: Documents that a parent's bound weighs in the bound of a group.
PRIOR = 100
#: Ratio -> the share of its upper quantile (the lower one is as far from the other end), how many times that quantile's
#: distance from the median the bound lies beyond it, the bound's least distance from the median, and whether there is a lower bound.
RATIOS = {"symbol_ratio": (0.9, 4.0, 0.02, False), "dup_line_ratio": (0.95, 8.0, 0.15, False), "repeat_ratio": (0.95, 4.0, 0.05, False), "word_length": (0.9, 4.0, 0.25, True)}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Threshold rows that are sent to all executors at most; more are joined by shuffle.
BROADCAST_ROWS = 100_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated_words(words: common.Words) -> np.ndarray:
    """For each text, its words that lie in a 3-word window found twice or more in it."""
    windows, whole = common.shingles(words, words.prints(), 3)
    inside = np.zeros(len(words.start), bool)
    at = np.flatnonzero(whole)
    if len(at):
        keyed = common.mix(windows[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        same = keyed[order[1:]] == keyed[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for shift in range(3):
            inside[at[twice] + shift] = True
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[words.first[1:]] - total[words.first[:-1]]


def _lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    kept = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(kept), len(kept) - len(set(kept))


def counted(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the counts of ``_COUNTS``, made anew if columns of those names are there.

    A null text has no words. The text itself stays; select what is needed, Spark prunes the rest.
    """
    arrow = pa.schema([(c, pa.int64()) for c in _COUNTS])

    def count(column: pa.Array) -> pa.StructArray:
        words = common.scan(column)
        inside = np.zeros(len(words.data) + 1, np.int64)
        np.add.at(inside, words.start, 1)
        np.add.at(inside, words.end, -1)
        in_word = np.cumsum(inside)[:-1].astype(bool)
        lines = np.array([_lines(x) for x in column.to_pylist()], np.int64).reshape(-1, 2)
        columns = (words.counts, words.per_text(in_word & ((words.data & 0xC0) != 0x80)), words.per_text(_SYMBOL[words.data]), lines[:, 1], _repeated_words(words), lines[:, 0])
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in columns], fields=list(arrow))

    @F.arrow_udf("struct<" + ", ".join(f"{c}: long" for c in _COUNTS) + ">")
    def counts(column: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])
        parts = [count(p.column(0)) for p in common.pieces([whole])]
        return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.int64())] * len(_COUNTS), fields=list(arrow))

    return documents.withColumn("_counts", counts(F.col(text))).withColumns({c: F.col("_counts")[c] for c in _COUNTS}).drop("_counts")


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, ratio, bucket, n); lang or source null: merged over all of them.

    Documents without a language or a source form the group named ``''``. Rows are counted before
    anything is shuffled, so a source with a third of all rows costs no more than another.
    """
    long = measured.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in _ratios().items()])))
    bucket = F.when(F.col("value") <= TINY, F.lit(ZERO_BUCKET)).otherwise(F.ceil(F.log("value") / math.log(GAMMA)).cast("int"))
    fine = long.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return merged(fine)


def merged(fine: DataFrame) -> DataFrame:
    """Sketches of each (lang, source) with those of each language and of the corpus added."""
    return fine.groupingSets([["lang", "source", "ratio", "bucket"], ["lang", "ratio", "bucket"], ["ratio", "bucket"]], "lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))


def _of_ratio(at: int) -> Column:
    """One of the numbers in ``RATIOS``, by the column ``ratio``."""
    return F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[at])])[F.col("ratio")]


def quantiles(sketch: DataFrame) -> DataFrame:
    """(lang, source, ratio, total, low, median, high): the first bucket bound that covers each share of the ratio."""
    group = Window.partitionBy("lang", "source", "ratio")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("value")))
    placed = sketch.select("lang", "source", "ratio", value.alias("value"), F.sum("n").over(group).alias("total"), F.sum("n").over(upto).alias("upto"))
    return placed.groupBy("lang", "source", "ratio").agg(F.max("total").alias("total"), at(1 - _of_ratio(0)).alias("low"), at(F.lit(0.5)).alias("median"), at(_of_ratio(0)).alias("high"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


BOUNDS = [*(f"max_{k}" for k in RATIOS), *(f"min_{k}" for k, v in RATIOS.items() if v[3])]


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) that has a document of which the base rules hold: the columns ``BOUNDS``."""
    found = quantiles(sketches(measured.where(~_base_failed())))
    bounds = found.select(
        "lang", "source", "ratio", "total",
        F.greatest(F.col("high") + _of_ratio(1) * (F.col("high") - F.col("median")), F.col("median") + _of_ratio(2)).alias("max"),
        F.least(F.col("low") - _of_ratio(1) * (F.col("median") - F.col("low")), F.col("median") - _of_ratio(2)).alias("min"),
    )
    one = lambda name: F.max(F.when(F.col("ratio") == name[4:], F.col(name[:3]))).alias(name)
    wide = common.cut(bounds.groupBy("lang", "source").agg(F.max("total").alias("total"), *map(one, BOUNDS)))
    corpus = wide.where(F.col("lang").isNull()).first()  # a row of a few numbers
    if corpus is None:
        return wide.select("lang", "source", *BOUNDS)
    drawn = lambda own, total, parent: (total * own + PRIOR * parent) / (total + PRIOR)
    langs = wide.where(F.col("source").isNull() & F.col("lang").isNotNull()).select("lang", *[drawn(F.col(c), F.col("total"), F.lit(corpus[c])).alias(f"{c}_lang") for c in BOUNDS])
    return wide.where(F.col("source").isNotNull()).join(langs, "lang").select("lang", "source", *[drawn(F.col(c), F.col("total"), F.col(f"{c}_lang")).alias(c) for c in BOUNDS])


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` joined to the bounds of its group, with ``base_failed`` and ``kept``.

    The bounds go to all executors if they are few; else both sides are shuffled, and Spark splits
    the partitions of a large source.
    """
    few = bounds.count() <= BROADCAST_ROWS
    side = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = (F.coalesce(measured["lang"], F.lit("")) == side["_lang"]) & (F.coalesce(measured["source"], F.lit("")) == side["_source"])
    over = F.lit(False)
    for k, v in _ratios().items():
        over = over | (v > F.col(f"max_{k}"))
        if RATIOS[k][3]:
            over = over | (v < F.col(f"min_{k}"))
    return measured.join(F.broadcast(side) if few else side, on, "left").withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).drop("_lang", "_source", *BOUNDS)


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, ``base_failed`` and ``kept`` for each row of ``documents``.

    Null or empty text: no words, so ``base_failed``. Null lang or source: the group ``''``. Repeated
    rows each get a row. An empty table gives an empty result. Other columns are left out, whatever
    their names. A text is worked on whole: counting it takes about 40 times its bytes. Counts are kept in the checkpoint folder, so texts are read once.
    """
    measured = common.cut(counted(documents.select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(measured, common.cut(thresholds(measured)))


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps, with their columns as they are, whatever their names.

    Null and empty texts go (they fail the base rules); a repeated row stays or goes with its equal;
    an empty table stays empty. A text is worked on whole: counting it takes about 40 times its bytes.
    """
    plain = documents.select("doc_id", "lang", "source", "text")
    bounds = common.cut(thresholds(counted(plain).drop("text")))
    own = documents.columns
    held = documents.select(F.struct(*own).alias("_row"), "lang", "source", "text")
    return judged(counted(held), bounds).where("kept").select(*[F.col("_row")[c].alias(c) for c in own])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def sql() -> str:
    """The rows of ``op1_quality_rules`` in DuckDB's SQL."""
    space = r"[\x20\x09-\x0D]"
    ratio = {"symbol_ratio": "n_symbols / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)"}
    of = lambda at: "CASE ratio " + " ".join(f"WHEN '{k}' THEN CAST({v[at]!r} AS DOUBLE)" for k, v in RATIOS.items()) + " END"
    wide = ", ".join(f"max(CASE WHEN ratio = '{c[4:]}' THEN {'most' if c[:3] == 'max' else 'least'} END) AS {c}" for c in BOUNDS)
    drawn = lambda own, total, parent: f"({total} * {own} + {PRIOR} * {parent}) / ({total} + {PRIOR})"
    langs = ", ".join(f"{drawn('l.' + c, 'l.total', 'a.' + c)} AS {c}" for c in BOUNDS)
    groups = ", ".join(f"{drawn('f.' + c, 'f.total', 'k.' + c)} AS {c}" for c in BOUNDS)
    over = " OR ".join([*(f"coalesce({ratio[k]} > max_{k}, false)" for k in RATIOS), *(f"coalesce({ratio[k]} < min_{k}, false)" for k, v in RATIOS.items() if v[3])])
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS k FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY id),
c AS (SELECT w.id, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep ON rep.id = w.id),
r AS ({" UNION ALL ".join(f"SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, '{k}' AS ratio, {v} AS x FROM c WHERE NOT ({base})" for k, v in ratio.items())}),
b AS (SELECT lang, source, ratio, CASE WHEN x <= {TINY} THEN {ZERO_BUCKET} ELSE CAST(ceil(ln(x) / {math.log(GAMMA)!r}) AS INTEGER) END AS bucket FROM r),
s AS (SELECT lang, source, ratio, bucket, count(*) AS n, grouping(lang) AS gl, grouping(source) AS gs FROM b GROUP BY GROUPING SETS ((lang, source, ratio, bucket), (lang, ratio, bucket), (ratio, bucket))),
u AS (SELECT gl, gs, lang, source, ratio, {of(0)} AS share, CASE WHEN bucket = {ZERO_BUCKET} THEN 0.0 ELSE pow({GAMMA!r}, bucket) END AS x, sum(n) OVER (PARTITION BY gl, gs, lang, source, ratio) AS total, sum(n) OVER (PARTITION BY gl, gs, lang, source, ratio ORDER BY bucket) AS upto FROM s),
q AS (SELECT gl, gs, lang, source, ratio, max(total) AS total, min(CASE WHEN upto >= (1 - share) * total THEN x END) AS low, min(CASE WHEN upto >= 0.5::DOUBLE * total THEN x END) AS median, min(CASE WHEN upto >= share * total THEN x END) AS high FROM u GROUP BY ALL),
t AS (SELECT *, greatest(high + {of(1)} * (high - median), median + {of(2)}) AS most, least(low - {of(1)} * (median - low), median - {of(2)}) AS least FROM q),
g AS (SELECT gl, gs, lang, source, CAST(max(total) AS DOUBLE) AS total, {wide} FROM t GROUP BY ALL),
k AS (SELECT l.lang, {langs} FROM (SELECT * FROM g WHERE gs = 1 AND gl = 0) l, (SELECT * FROM g WHERE gl = 1) a),
p AS (SELECT f.lang, f.source, {groups} FROM (SELECT * FROM g WHERE gs = 0) f JOIN k ON k.lang = f.lang),
v AS (SELECT c.*, {base} AS base_failed, {over} AS odd FROM c LEFT JOIN p ON p.lang = coalesce(c.lang, '') AND p.source = coalesce(c.source, ''))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT odd AS kept, lang, source FROM v
"""
