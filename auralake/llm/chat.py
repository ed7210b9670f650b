"""Operator 3: preference pairs rendered as one prompt and two masked completions.

A pair is a chosen and a rejected conversation. Their turns meet in one join on (pair, turn); the
first turn at which role or text differ, found by a minimum, ends the longest common prefix. What
lies before it is the prompt and is rendered once; what lies after it in each conversation is its
completion. Each turn is rendered as ``<|role|>`` newline text newline, and each rendered turn has
a mask: only the text of an assistant's turn in a completion, with its newline, is learned from.

Turns stay rows (one rendered segment each, with its offset), so a pair of any length is handled a
turn at a time; ``assembled`` joins the segments of pairs into strings for those who want them so.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEARNED_ROLE = "assistant"


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def segments(turns: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, segment, start, learn_from, learn_to) of ``turns`` (pair_id, side, turn, role, text).

    ``side`` is ``chosen`` or ``rejected``; ``part`` is ``prompt``, ``chosen`` or ``rejected``.
    ``start`` counts characters from the beginning of the part, ``learn_from`` and ``learn_to`` those
    of the segment that are learned from (equal: none). Null text and role count as empty. Turns of one
    number are taken in the order of role and text, as further turns; turns without a number come
    first; repeated rows are further turns too. Pairs without both sides, rows of other sides and rows without a
    pair_id are left out; an empty table gives an empty result; other columns are left out, whatever their names.
    A task holds one turn's text at a time, and of a pair's turns the rows' other fields.
    """
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    given = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("side").isin("chosen", "rejected") & F.col("pair_id").isNotNull())
    placed = given.withColumn("place", F.row_number().over(order))
    both = placed.groupBy("pair_id", "place").agg(
        F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high"), F.max((F.col("side") == "chosen").cast("int")).alias("c"), F.max((F.col("side") == "rejected").cast("int")).alias("r")
    )
    prefix = both.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when((F.col("n") < 2) | (F.col("low") != F.col("high")), F.col("place"))), F.max("place") + 1).alias("split"), F.max("c").alias("c"), F.max("r").alias("r")
    ).where("c = 1 and r = 1").select("pair_id", "split")
    joined = placed.join(prefix, "pair_id").where((F.col("place") >= F.col("split")) | (F.col("side") == "chosen"))
    part = F.when(F.col("place") < F.col("split"), F.lit("prompt")).otherwise(F.col("side"))
    segment = _rendered(F.col("role"), F.col("text"))
    learned = (F.col("part") != "prompt") & (F.col("role") == LEARNED_ROLE)
    head = F.length("role") + 5
    before = Window.partitionBy("pair_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shown = joined.withColumn("part", part).withColumn("segment", segment)
    return shown.select(
        "pair_id", "part", "place", "turn", "role", "segment", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).alias("start"),
        F.when(learned, head).otherwise(F.lit(0)).alias("learn_from"), F.when(learned, F.length("segment")).otherwise(F.lit(0)).alias("learn_to"),
    )


def assembled(parts: DataFrame) -> DataFrame:
    """One row a pair: ``prompt``, ``chosen``, ``rejected`` and the learned spans of both completions.

    ``parts`` is what ``segments`` gives; parts without a segment are empty, spans too. Repeated segments are joined as
    often as they come; an empty table gives an empty result; other columns are left out. A row holds its pair's
    whole text, of which a task needs about six times the bytes.
    """
    rows = parts.groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "segment", (F.col("start") + F.col("learn_from")).alias("a"), (F.col("start") + F.col("learn_to")).alias("b")))).alias("s"))
    text = F.concat_ws("", F.transform("s", lambda x: x["segment"]))
    spans = F.transform(F.filter("s", lambda x: x["a"] < x["b"]), lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end")))
    of = lambda part, value: F.max(F.when(F.col("part") == part, value))
    read = rows.select("pair_id", "part", text.alias("text"), spans.alias("spans"))
    return read.groupBy("pair_id").agg(
        *[F.coalesce(of(p, F.col("text")), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[F.coalesce(of(p, F.col("spans")), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias(f"{p}_mask") for p in ("chosen", "rejected")],
    )


def _mates(conversations: DataFrame) -> DataFrame:
    """(a, b): the conversations (conv_id, key) of each key in order of conv_id, two by two; b is null for a last odd one.

    Rows are dealt by range of (key, conv_id), so a very common key is spread. A rank within the key
    is that within the partition plus what earlier partitions hold of the key; only keys that
    partitions share need that, at most two rows a partition, which go through the driver.
    """
    dealt = common.cut(conversations.repartitionByRange("key", "conv_id").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("part", "n"))).alias("runs")).where("parts > 1").select("key", "runs").collect()
    before = [(key, run.part, n) for key, runs in split for run, n in zip(runs, accumulate((r.n for r in runs), initial=0), strict=False)]
    held = dealt.sparkSession.createDataFrame(before, "key long, part int, before long")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("conv_id")) - 1
    ranked = dealt.withColumn("place", place).join(F.broadcast(held), ["key", "part"], "left").withColumn("two", F.floor((F.col("place") + F.coalesce("before", F.lit(0))) / 2))
    return ranked.groupBy("key", "two").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).select("a", F.when(F.col("a") < F.col("b"), F.col("b")).alias("b"))


def paired(conversations: DataFrame) -> DataFrame:
    """Turns (pair_id, side, turn, role, text) of pairs of conversations that open alike, ``conversations`` being (conv_id, turn, role, text).

    Conversations whose first turns have the same role and text are put in order of conv_id and
    paired in turn. The odd ones that openings leave over are put in order of conv_id and paired in
    turn in the same way. If there is an odd number of conversations, the last of those is both
    sides of its pair, so that all of it is prompt. Of a pair, the lesser conv_id is the chosen one
    and names the pair. A null role or text is one of its own, unlike an empty one; turns without a number come
    first; rows without a conv_id are left out; repeated rows stay turns of their conversation; an empty table
    gives an empty result; other columns are left out, whatever their names. Pairing works on ids and hashes; a task
    holds one turn's text at a time.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    first = turns.groupBy("conv_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("opening"))).alias("f")).select("conv_id", F.col("f.opening").alias("key"))
    alike = common.cut(_mates(first))
    rest = _mates(alike.where("b is null").select(F.col("a").alias("conv_id"), F.lit(0).cast("long").alias("key")))
    both = alike.where("b is not null").unionByName(rest)
    sides = F.array(F.struct(F.col("a").alias("conv_id"), F.lit("chosen").alias("side")), F.struct(F.coalesce("b", "a").alias("conv_id"), F.lit("rejected").alias("side")))
    pairs = both.select(F.col("a").alias("pair_id"), F.inline(sides))
    return turns.join(pairs, "conv_id").select("pair_id", "side", "turn", "role", "text")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(paired(common.read(spark, sf_dir, "conversations")))


#: The same rows in SQL, for turns whose numbers do not repeat within a conversation.
SQL = """
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1)) AS k FROM turns),
lined AS (SELECT conv_id, row_number() OVER w - 1 AS at_, lead(conv_id) OVER w AS next_, lag(conv_id) OVER w AS last_
          FROM ranked WHERE k = 1 WINDOW w AS (PARTITION BY role, text ORDER BY conv_id)),
matched AS (SELECT conv_id, CASE WHEN at_ % 2 = 1 THEN last_ WHEN next_ IS NOT NULL THEN conv_id END AS pair_id FROM lined),
rest AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS at_, lag(conv_id) OVER (ORDER BY conv_id) AS last_ FROM matched WHERE pair_id IS NULL),
pairs AS (SELECT conv_id, pair_id, CASE WHEN conv_id = pair_id THEN 'chosen' ELSE 'rejected' END AS side FROM matched WHERE pair_id IS NOT NULL
          UNION ALL SELECT conv_id, CASE WHEN at_ % 2 = 0 THEN conv_id ELSE last_ END, CASE WHEN at_ % 2 = 0 THEN 'chosen' ELSE 'rejected' END FROM rest
          UNION ALL SELECT conv_id, conv_id, 'rejected' FROM rest WHERE at_ % 2 = 0 AND at_ = (SELECT max(at_) FROM rest)),
placed AS (SELECT p.pair_id, p.side, t.turn, coalesce(t.role, '') AS role, coalesce(t.text, '') AS text,
                  row_number() OVER (PARTITION BY p.pair_id, p.side ORDER BY t.turn NULLS FIRST, coalesce(t.role, ''), coalesce(t.text, '')) AS place
           FROM turns t JOIN pairs p USING (conv_id)),
compared AS (SELECT pair_id, place, count(*) AS n, min(role || chr(0) || text) AS low, max(role || chr(0) || text) AS high FROM placed GROUP BY pair_id, place),
split AS (SELECT pair_id, coalesce(min(CASE WHEN n < 2 OR low <> high THEN place END), max(place) + 1) AS split FROM compared GROUP BY pair_id),
shown AS (SELECT pair_id, CASE WHEN place < split THEN 'prompt' ELSE side END AS part, place, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS segment
          FROM placed JOIN split USING (pair_id) WHERE place >= split OR side = 'chosen')
SELECT pair_id, part, place, turn, role, segment,
       coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS learn_from,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(segment) ELSE 0 END AS learn_to
FROM shown
"""
