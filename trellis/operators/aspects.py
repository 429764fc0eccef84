"""Aspect propagation with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import GraphTables
from ..storage import Rounds, written
from .closure import ancestors, with_root


def above(g: GraphTables) -> DataFrame:
    """(node, ancestor, distance), the root node with the empty path included."""
    return with_root(g.nodes, ancestors(g.nodes))


def implies_closure(g: GraphTables) -> DataFrame:
    """(aspect, implied, depth), without the aspect itself unless it lies on a cycle.

    Paths are doubled until no pair is new: implications are few, and pairs with themselves meet in few rounds. The written
    pairs stay with the graph for the next operator that asks.
    """
    if g.implied is not None and g.implied[0] is g.implies:
        return g.implied[1]
    rounds = Rounds(g.implies.sparkSession, "implied")
    now, n = rounds.counted(g.implies.select(F.col("id").alias("aspect"), "implied").distinct().withColumn("depth", F.lit(1).cast("long")))
    before = -1
    while n and n != before:
        before = n
        longer = now.select("aspect", F.col("implied").alias("by"), "depth").join(now.select(F.col("aspect").alias("by"), "implied", F.col("depth").alias("more")), "by")
        now, n = rounds.counted(now.unionAll(longer.select("aspect", "implied", F.col("depth") + F.col("more"))).groupBy("aspect", "implied").agg(F.min("depth").alias("depth")))
    g.implied = g.implies, now
    return now


def circular(closure: DataFrame) -> DataFrame:
    """(aspect) that imply themselves, or one that does; nothing can be expanded from them."""
    loops = closure.where("aspect = implied").select(F.col("aspect").alias("implied"))
    return closure.join(loops, "implied", "left_semi").select("aspect").distinct()


def implies_order(g: GraphTables, closure: DataFrame | None = None) -> DataFrame:
    """(aspect, implied, path): the smallest path of ordinals to each implied aspect; by it depth-first order is a sort.

    Aspects that lead into a cycle are left out (``circular``). A round for each step of the longest chain.
    """
    closure = implies_closure(g) if closure is None else closure
    rounds = Rounds(g.implies.sparkSession, "implies")
    edges = g.implies.select("id", F.col("ord").cast("long").alias("ord"), "implied").join(circular(closure).withColumnRenamed("aspect", "id"), "id", "left_anti")
    edges = rounds.write(edges.groupBy("id", "implied").agg(F.min("ord").alias("ord")))
    known, n = rounds.counted(edges.select(F.col("id").alias("aspect"), "implied", F.array("ord").alias("path")))
    new = known
    while n:
        step = new.select("aspect", F.col("implied").alias("id"), "path").join(edges, "id").select("aspect", "implied", F.concat("path", F.array("ord")).alias("path"))
        step = step.groupBy("aspect", "implied").agg(F.min("path").alias("path"))
        old = known.select("aspect", "implied", F.col("path").alias("was"))
        new, n = rounds.counted(step.join(old, ["aspect", "implied"], "left").where("was is null or path < was").drop("was"))
        known = rounds.write(known.unionAll(new).groupBy("aspect", "implied").agg(F.min("path").alias("path"))) if n else known
    return known


def expanded(seeds: DataFrame, order: DataFrame, by: list[str]) -> DataFrame:
    """``seeds`` (by..., aspect, at) and what they imply, once for each ``by``: (by..., aspect, key), the order being
    that of ``key``: where the first seed that leads there stands, then the ordinals on the way."""
    none = F.array().cast("array<long>")
    own = seeds.select(*by, "aspect", F.struct("at", none.alias("path")).alias("key"))
    more = seeds.join(order, "aspect").select(*by, F.col("implied").alias("aspect"), F.struct("at", "path").alias("key"))
    return own.unionAll(more).groupBy(*by, "aspect").agg(F.min("key").alias("key"))


def listed(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., aspects): the ids of ``expanded`` rows in order, joined by commas."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("key", "aspect"))), lambda x: x["aspect"])
    return rows.groupBy(*by).agg(F.array_join(ids, ",").alias("aspects"))


def resolved(rows: DataFrame, aspects: DataFrame) -> DataFrame:
    """Rows whose aspect is defined."""
    return rows.join(aspects.select(F.col("id").alias("aspect")).distinct(), "aspect", "left_semi")


def flow_membership(g: GraphTables) -> DataFrame:
    """(node, flow): flows that name the node or one of its ancestors."""
    direct = g.flow_nodes.select("node", "flow")
    up = above(g).join(g.flow_nodes.select(F.col("node").alias("ancestor"), "flow"), "ancestor").select("node", "flow")
    return direct.join(g.nodes.select(F.col("path").alias("node")), "node", "left_semi").unionAll(up).distinct()


def sources(g: GraphTables, member: DataFrame | None = None) -> DataFrame:
    """(node, aspect, prio, rank, source): every way an aspect reaches a node, before implication."""
    own = g.node_aspects.select(F.col("path").alias("node"), "aspect", F.lit(0).alias("prio"), F.lit("0").alias("rank"), F.lit("own").alias("source"))
    up = above(g).join(g.node_aspects.select(F.col("path").alias("ancestor"), "aspect"), "ancestor").select("node", "aspect", F.lit(1).alias("prio"), F.lpad(F.col("distance").cast("string"), 6, "0").alias("rank"), F.concat(F.lit("hierarchy "), "ancestor").alias("source"))
    flow = (flow_membership(g) if member is None else member).join(g.flow_aspects.select("flow", "aspect"), "flow").select("node", "aspect", F.lit(2).alias("prio"), F.col("flow").alias("rank"), F.concat(F.lit("flow "), "flow").alias("source"))
    return own.unionAll(up).unionAll(flow)


def effective(g: GraphTables, closure: DataFrame | None = None, member: DataFrame | None = None) -> DataFrame:
    """(node, aspect): own, inherited, by flow, and implied by any of these."""
    base = written(sources(g, member).select("node", "aspect").distinct())
    more = base.join(implies_closure(g) if closure is None else closure, "aspect").select("node", F.col("implied").alias("aspect"))
    return base.unionAll(more).distinct()


def provenance(g: GraphTables) -> DataFrame:
    """(node, aspect, source): own before the nearest ancestor, the first flow, and implication."""
    base = written(sources(g))
    more = base.select("node", "aspect").distinct().join(implies_closure(g), "aspect").select("node", F.col("implied").alias("aspect"), F.lit(3).alias("prio"), F.lit("").alias("rank"), F.lit("implied").alias("source")).distinct()
    best = base.unionAll(more).groupBy("node", "aspect").agg(F.min(F.struct("prio", "rank", "source")).alias("b"))
    return best.select("node", "aspect", F.col("b.source").alias("source"))
