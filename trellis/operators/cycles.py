"""Cycles as strongly connected components, each with a shortest cycle as witness.

Nodes are numbered in load order, so the smallest number of a component is its first node and paths compare as lists
of numbers. Every loop here shrinks what it looks at: nodes without in- or out-edges are trimmed first, which leaves
only what lies on cycles or between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import load_order
from ..storage import Rounds

#: Steps of a loop that go into one written table.
AT_ONCE = 4

def _numbered(rounds: Rounds, edges: DataFrame, hubs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int | None]:
    """Distinct edges (src, dst) of numbers, (id, name) of the numbers, and the number from which on they are hubs."""
    edges = rounds.write(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    names = edges.select(F.col("src").alias("name")).unionAll(edges.select("dst")).distinct()
    if hubs is None:
        names = names.withColumn("hub", F.lit(False))
    else:
        names = names.join(hubs.select(F.col("node").alias("name"), F.lit(True).alias("hub")).distinct(), "name", "left").select("name", F.coalesce("hub", F.lit(False)).alias("hub"))
    numbers = rounds.write(names.orderBy("hub", load_order("name")).select(F.monotonically_increasing_id().alias("id"), "name", "hub"))
    first = None if hubs is None else numbers.where("hub").agg(F.min("id")).first()[0]
    number = lambda c: numbers.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c))
    return edges.join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), numbers.select("id", "name"), first


def trimmed(rounds: Rounds, edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges without nodes that lack in- or out-edges, peeled from both sides until none is left to peel."""
    edges, n = rounds.counted(edges)
    before = -1
    while n and n != before:
        before = n
        for _ in range(AT_ONCE // 2):
            ends = edges.select(F.col("dst").alias("src")).distinct()
            starts = edges.select(F.col("src").alias("dst")).distinct()
            edges = edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")
        edges, n = rounds.counted(edges)
    return edges, n


def _colours(rounds: Rounds, edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node."""
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    now, n = rounds.write(nodes.select("node", F.col("node").alias("colour"))), 1
    while n:
        step = now.withColumn("was", F.col("colour"))
        for _ in range(AT_ONCE):
            sent = edges.join(step.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
            step = step.join(sent, "node", "left").select("node", F.least("colour", "c").alias("colour"), "was")
        now, n = rounds.counted(step, F.col("colour") < F.col("was"))
        now = now.select("node", "colour")
    return now


def strong_components(rounds: Rounds, edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle, a self-loop being one; the component is its smallest node.

    ``edges`` (src, dst) of numbers. Each node takes the smallest one that reaches it as its colour; a node that
    keeps its own is the first of a component, whose members are those of its colour that lead back to it. What they
    leave is trimmed and coloured again.
    """
    none = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    done, live = none, edges.where("src <> dst")
    while True:
        live, n = trimmed(rounds, live)
        if not n:
            alone = loops.join(done.select("node"), "node", "left_anti").select("node", "component")
            return rounds.write(done.unionAll(alone))
        colour = _colours(rounds, live)
        mine = live.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        mine = rounds.write(mine.where("colour = other").select("src", "dst", "colour"))
        # Backwards from each first node, within its colour.
        new, n = rounds.counted(colour.where("node = colour"))
        found = new
        while n:
            more = step = new
            for _ in range(AT_ONCE):
                step = mine.join(step.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
                more = more.unionAll(step)
            new, n = rounds.counted(more.distinct().join(found.select("node"), "node", "left_anti"))
            found = found.unionAll(new)
        # A first node without a way back is no component of more than one node.
        several = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        members = rounds.write(found.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component")))
        done = done.unionAll(members)
        gone = found.select("node")
        live = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


def witnesses(rounds: Rounds, edges: DataFrame, members: DataFrame, first: int | None = None) -> DataFrame:
    """(component, path): a shortest cycle of each component as numbers from its smallest node back to it; of several
    the smallest.

    Walks go on from every member at once, over members that are no smaller than where they began, one smallest walk
    for each pair of ends. A component stops at its first closed walk, which is a cycle as it is a shortest one. Nodes
    from ``first`` on are hubs: a walk passes one within a step and does not name it. Loops are told before any pair of ends is made.
    """
    at = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    inner = edges.join(at("src"), "src").join(at("dst"), "dst").where("src_in = dst_in")
    inner = rounds.write(inner.select(F.col("src_in").alias("component"), "src", "dst"))
    straight, into, onward = inner, None, None
    if first is not None:
        straight, into, onward = inner.where(f"src < {first} and dst < {first}"), inner.where(f"dst >= {first}"), inner.where(f"src >= {first}")
    loops = straight.where("src = dst").select("component", F.col("src").alias("start"))
    if first is not None:
        through = into.select("component", F.col("src").alias("start"), F.col("dst").alias("hub"))
        loops = loops.unionAll(through.join(onward.select("component", F.col("src").alias("hub"), F.col("dst").alias("start")), ["component", "start", "hub"]).select("component", "start"))
    out = rounds.write(loops.groupBy("component").agg(F.min("start").alias("start")).select("component", F.array("start", "start").alias("path")))
    starts = members if first is None else members.where(F.col("node") < first)
    now = starts.select("component", F.col("node").alias("start"), "node", F.array("node").alias("path"))
    now, n = rounds.counted(now.join(out.select("component"), "component", "left_anti"))
    shortest = lambda df: df.groupBy("component", "start", "node").agg(F.min("path").alias("path"))
    while n:
        left = now.withColumnRenamed("node", "src")
        after = lambda rows, by: rows.join(by, ["component", "src"]).where("dst >= start").select("component", "start", F.col("dst").alias("node"), "path")
        step = after(left, straight)
        if first is not None:
            step = step.unionAll(after(shortest(after(left, into)).withColumnRenamed("node", "src"), onward))
        now = rounds.write(shortest(step.withColumn("path", F.concat("path", F.array("node")))))
        closed = rounds.write(now.where("node = start").groupBy("component").agg(F.min("path").alias("path")))
        out = out.unionAll(closed)
        now, n = rounds.counted(now.join(closed.select("component"), "component", "left_anti"))
    return out


def _described(rounds: Rounds, edges: DataFrame, members: DataFrame, tolerated: bool, first: int | None) -> DataFrame:
    sizes = (members if first is None else members.where(F.col("node") < first)).groupBy("component").agg(F.count("*").alias("size"))
    return witnesses(rounds, edges, members, first).join(sizes, "component").select("component", "size", F.lit(tolerated).alias("tolerated"), "path")


def components(edges: DataFrame, blackbox: DataFrame | None = None, arrow: str = " -> ", hubs: DataFrame | None = None) -> DataFrame:
    """(component, size, tolerated, path): the components of a graph (src, dst) that hold cycles, with their first node in
    load order, how many nodes they have, and a shortest cycle as text.

    A cycle is tolerated if it has a node of ``blackbox`` (node). So components are those of the other nodes, and
    besides, tolerated, those of the whole graph that have none of these inside. Null ends are no edges.

    A hub (``hubs``: node) stands for an edge from each node that leads to it to each node it leads to, so that these need no rows. It
    is no node of the graph: it is not counted and no path names it. No hub leads to a hub.
    """
    rounds = Rounds(edges.sparkSession, "cycles")
    edges, numbers, first = _numbered(rounds, edges, hubs)
    edges = rounds.write(edges)
    if blackbox is None:
        out = _described(rounds, edges, strong_components(rounds, edges), False, first)
    else:
        boxed = numbers.join(blackbox.select(F.col("node").alias("name")).distinct(), "name", "left_semi").select("id")
        boxed = rounds.write(boxed)
        plain = edges.join(boxed.withColumnRenamed("id", "src"), "src", "left_anti").join(boxed.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        plain = rounds.write(plain)
        bad = strong_components(rounds, plain)
        whole = strong_components(rounds, edges)
        worse = whole.join(bad.select("node"), "node", "left_semi").select("component").distinct()
        mild = rounds.write(whole.join(worse, "component", "left_anti").select("node", "component"))
        out = _described(rounds, plain, bad, False, first).unionAll(_described(rounds, edges, mild, True, first))
    name = lambda c: numbers.select(F.col("id").alias(c), "name")
    out = rounds.write(out)
    steps = out.select(F.col("component").alias("of"), F.posexplode("path").alias("pos", "id")).join(name("id"), "id")
    said = steps.groupBy("of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), arrow).alias("path"))
    out = out.drop("path").join(said, F.col("component") == F.col("of")).join(name("component"), "component")
    return out.select(F.col("name").alias("component"), "size", "tolerated", "path")
