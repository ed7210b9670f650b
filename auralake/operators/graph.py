"""Graph operators over edge tables, by rounds of joins.

Joins name their kind: files of keys are so small that Spark would send whole tables to all tasks in every round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import written


class _Rounds:
    """What rounds have found, as few tables: two of like size are written as one, so a row is written again as often as the number of rounds has binary digits."""

    def __init__(self):
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame) -> None:
        self.tables.append((1, rows))
        while len(self.tables) > 1 and self.tables[-1][0] >= self.tables[-2][0]:
            (n, last), (m, before) = self.tables.pop(), self.tables.pop()
            self.tables.append((n + m, written(before.unionByName(last)) if n + m > 2 else before.unionByName(last)))

    def all(self) -> DataFrame:
        out = self.tables[0][1]
        for _, more in self.tables[1:]:
            out = out.unionByName(more)
        return out


def distances(edges: DataFrame, start: DataFrame, within: Sequence[str] = (), of: Sequence[str] = ()) -> DataFrame:
    """(within, of, node, hops, parent): unweighted shortest paths over ``edges`` (within, src, dst) from the nodes of ``start`` (within, of, node).

    ``within`` are columns that tell graphs apart, such as a scene; ``of`` are columns that tell searches
    apart, such as where they start: all searches go on at once, a hop a round. Nodes of one search start
    together. Of several parents the least is taken. A round joins the newest nodes with the edges and drops
    those that are known to their search, so a node is expanded once; rounds end when nothing new is reached.
    """
    keys, search = list(within), [*within, *of]
    frontier = written(start.select(*search, "node").distinct().select(*search, "node", F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")))
    edges = edges.select(*keys, "src", "dst")
    known = _Rounds()
    hop = 0
    while True:
        known.add(frontier)
        hop += 1
        reached = frontier.withColumnRenamed("node", "src").join(edges.hint("merge"), [*keys, "src"]).groupBy(*search, F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = written(reached.join(known.all().select(*search, "node").hint("merge"), [*search, "node"], "left_anti").select(*search, "node", F.lit(hop).alias("hops"), "parent"))
        if frontier.isEmpty():
            return known.all()


def paths(tree: DataFrame, ends: DataFrame, search: Sequence[str] = ()) -> DataFrame:
    """(search, end, place, node): the nodes of the shortest paths to the nodes of ``ends`` (search, node), in order from place 0 at the start.

    ``tree`` (search, node, hops, parent) is what ``distances`` gives; ends that it does not reach have no rows. Parents are
    doubled to the ancestors at distance 1, 2, 4, ...; then each row, which stands for a stretch of a path, is
    halved as often. So rounds grow with the logarithm of the longest path, and rows only to those of the result.
    """
    keys = list(search)
    tree = tree.select(*keys, "node", "hops", "parent")
    rows = written(ends.select(*keys, "node").distinct().join(tree.hint("merge"), [*keys, "node"]).select(*keys, F.col("node").alias("end"), "node", F.col("hops").alias("place")))
    longest = rows.agg(F.coalesce(F.max("place"), F.lit(0)).alias("n")).first().n
    up = [tree.where("parent is not null").select(*keys, "node", F.col("parent").alias("above"))]
    while 2 ** len(up) <= longest:
        further = up[-1].select(*keys, F.col("node").alias("above"), F.col("above").alias("higher"))
        up.append(written(up[-1].join(further.hint("merge"), [*keys, "above"]).select(*keys, "node", F.col("higher").alias("above"))))
    for k in reversed(range(len(up))):
        upper = rows.where(F.col("place") >= 2**k).join(up[k].hint("merge"), [*keys, "node"]).select(*keys, "end", F.col("above").alias("node"), (F.col("place") - 2**k).alias("place"))
        rows = written(rows.unionByName(upper))
    return rows.select(*keys, "end", "place", "node")


def components(nodes: DataFrame, edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component): the least node that ``edges`` (src, dst, in whichever direction) connect with each node.

    A round puts the nodes in an order of its own, by a hash, hooks each node to its first neighbour if that
    comes before it, and goes on with what it is hooked to as a node: at most every second node is expected to come before
    all its neighbours, so whatever the shape of the graph, a round leaves half of the nodes at most, and the
    number of rounds grows with the logarithm of the nodes. ``rounds`` gets the number of edges of each round.
    """
    pair = lambda a, b: F.array_sort(F.array(a, b))
    ends = lambda p: (p[0].alias("a"), p[1].alias("b"))
    left = written(edges.where("src <> dst").select(*ends(pair(F.col("src"), F.col("dst")))).distinct())
    levels: list[DataFrame] = []
    while (size := left.count()) > 0:
        if rounds is not None:
            rounds.append(size)
        turn = F.lit(len(levels))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("other", turn).alias("h"), "other")).alias("f"))
        hooked = first.select("node", F.when(F.col("f") < F.struct(F.xxhash64("node", turn).alias("h"), F.col("node").alias("other")), F.col("f.other")).otherwise(F.col("node")).alias("root"))
        further = hooked.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        hooked = written(hooked.join(further.hint("merge"), "root").select("node", F.col("higher").alias("root")))
        levels.append(hooked)
        of = lambda end, roots=hooked: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        moved = left.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where("root_a <> root_b")
        left = written(moved.select(*ends(pair(F.col("root_a"), F.col("root_b")))).distinct())
    if not levels:
        return nodes.select("node", F.col("node").alias("component")).distinct()
    top = levels[-1]
    for lower in reversed(levels[:-1]):  # each has twice as many nodes as the one before, or more
        top = written(lower.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    least = top.groupBy("root").agg(F.min("node").alias("least"))
    named = top.join(least.hint("merge"), "root").select("node", F.col("least").alias("component"))
    return nodes.select("node").distinct().join(named.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def patched(edges: DataFrame, removed: DataFrame, added: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``edges`` (src, dst) without those of ``removed`` and without all that touch ``nodes`` (node), with those of ``added``, each once."""
    left = edges.select("src", "dst").join(removed.select("src", "dst"), ["src", "dst"], "left_anti")
    if nodes is not None:
        for end in ("src", "dst"):
            left = left.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return (left if added is None else left.unionByName(added.select("src", "dst"))).select("src", "dst").distinct()
