"""Hierarchy, reachability and topological levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ..storage import Rounds, written  # noqa: F401  (written is used by other operators from here)

STRUCTURAL = ["uses", "calls", "extends", "implements"]
EVENT = ["emits", "listens"]
#: Steps that one round of ``reach`` goes, as a power of two.
STRIDE_ROUNDS = 2


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance) by path prefixes: the hierarchy has no gaps, so there is no recursion.

    A root node with the empty path, where there is one, is the ancestor of every other node.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("a"), (F.size(parts) - i).cast("long").alias("d")))
    return nodes.where("depth > 1").select(F.col("path").alias("node"), F.explode(up).alias("x")).select("node", F.col("x.a").alias("ancestor"), F.col("x.d").alias("distance"))


def with_root(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``above`` (node, ancestor, distance), and the empty path as ancestor of every node if it is a node."""
    root = nodes.where("path = ''").select(F.lit("").alias("ancestor"))
    return above.unionAll(nodes.where("path <> ''").select(F.col("path").alias("node"), "depth").join(F.broadcast(root)).select("node", "ancestor", F.col("depth").cast("long").alias("distance")))


def structural(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("type").isin(STRUCTURAL))


def of_class(relations: DataFrame, which: str) -> DataFrame:
    """Relations of class 'structural', 'event' or 'all'; an unknown type is in 'all' alone."""
    if which not in ("structural", "event", "all"):
        raise ValueError(f"relation class must be structural, event or all, not {which!r}")
    return relations if which == "all" else relations.where(F.col("type").isin(STRUCTURAL if which == "structural" else EVENT))


def numbered_reach(edges: DataFrame, max_depth: int | None = None, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``reach`` as (root, node, depth) with numbers for nodes, and the written table (id, name) of the numbers."""
    rounds = Rounds(edges.sparkSession, "reach")
    edges = edges.select("src", "dst")
    if roots is not None:
        # Of the edges of nodes that nothing leads to, only those of roots are on a path.
        edges = rounds.write(edges)
        begin = edges.select(F.col("dst").alias("src")).unionAll(roots.select(F.col("root").alias("src"))).distinct()
        edges = edges.join(begin, "src", "left_semi").select("src", "dst")
    edges = rounds.write(edges.distinct())
    names = rounds.write(edges.select(F.col("src").alias("name")).unionAll(edges.select("dst")).distinct().select(F.monotonically_increasing_id().alias("id"), "name"))
    number = lambda c: names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c))
    one = edges.join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.lit(1).cast("long").alias("d"))
    stride = 1
    if roots is None and (max_depth is None or max_depth > 1):
        for _ in range(STRIDE_ROUNDS):
            one = rounds.write(one)
            outer = one.where(F.col("d") == stride)
            longer = outer.select("src", F.col("dst").alias("mid")).join(one.select(F.col("src").alias("mid"), "dst", F.col("d").alias("e")), "mid").select("src", "dst", (F.col("e") + stride).alias("d"))
            one = one.unionAll(longer).groupBy("src", "dst").agg(F.min("d").alias("d"))
            stride *= 2
    steps = rounds.write(one)
    new = steps.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.col("d").alias("depth"))
    if roots is not None:
        new = new.join(roots.select(F.col("root").alias("name")).distinct().join(names, "name").select(F.col("id").alias("root")), "root", "left_semi")
    if max_depth is not None:
        new = new.where(F.col("depth") <= max_depth)
    if max_depth is not None and max_depth <= stride:
        return new, names
    known, depth = new, stride
    while True:
        outer = new.where(F.col("depth") == depth)
        step = outer.join(steps, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg((F.min("d") + depth).alias("depth"))
        if max_depth is not None:
            step = step.where(F.col("depth") <= max_depth)
        new, n = rounds.counted(step.join(known, ["root", "node"], "left_anti"))
        known, depth = known.unionAll(new), depth + stride
        if not n or max_depth is not None and depth >= max_depth:
            return known, names


def reach(edges: DataFrame, max_depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): all nodes reachable over edges (src, dst), with the fewest steps; safe on cycles.

    ``roots`` (root) limits where paths begin; from given roots pairs are rows, and every round goes one step, so nothing is made for
    other nodes. From all nodes sets are bits (``bitmaps.reached``), and pairs are rows in the result alone.
    """
    if roots is not None:
        pairs, names = numbered_reach(edges, max_depth, roots)
        named = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
        return pairs.join(named("root"), "root").join(named("node"), "node").select(F.col("root_name").alias("root"), F.col("node_name").alias("node"), "depth")
    rounds = Rounds(edges.sparkSession, "reach")
    edges = rounds.write(edges.select("src", "dst").distinct())
    # Nodes that nothing leads to come first, so that each class of roots lies close together.
    numbers = bitmaps.numbered(rounds, edges.select(F.col("src").alias("name"), F.lit(0).alias("group")).unionAll(edges.select("dst", F.lit(1))))
    sets = bitmaps.reached(rounds, bitmaps.by_number(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")), numbers, "root", "node"), True, max_depth)
    return bitmaps.listed(sets, numbers).select(F.col("name").alias("root"), F.col("root").alias("node"), "depth")


def dependencies(nodes: DataFrame, relations: DataFrame, which: str = "structural", max_depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): every node with itself (depth 0) and what it depends on, by the fewest steps.

    ValueError if a root is no node or a followed relation has a target that is none.
    """
    edges = of_class(relations, which)
    start = nodes.select(F.col("path").alias("root")) if roots is None else roots.select("root").distinct()
    lost = start.join(nodes.select(F.col("path").alias("root")), "root", "left_anti").first()
    if lost:
        raise ValueError(f"node not found: {lost[0]}")
    out = reach(edges, max_depth, roots).where("root <> node").unionAll(start.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")))
    out = written(out)
    lost = out.join(nodes.select(F.col("path").alias("node")), "node", "left_anti").first()
    if lost:
        raise ValueError(f"relation target not found: {lost['node']}")
    return out


def stages(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, stage) for an acyclic graph: one more than the longest path to a leaf; raises on a cycle.

    Only edges between candidates count; parallel edges count once each way round. One written table for
    each level: the nodes left, with how many of their edges lead to nodes left. Levels run over the nodes that others
    lead to; the others are one above the highest stage they lead to, told once at the end.
    """
    rounds = Rounds(candidates.sparkSession, "stages")
    here = rounds.write(candidates.select("node").distinct())
    among = edges.select("src", "dst").join(here.select(F.col("node").alias("dst")), "dst", "left_semi").join(here.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    among = rounds.write(among.distinct())
    inner = rounds.write(among.select(F.col("dst").alias("node")).distinct())
    core = rounds.write(among.join(inner.select(F.col("node").alias("src")), "src", "left_semi"))
    left = inner.join(core.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open")), "node", "left").select("node", F.coalesce("open", F.lit(0)).cast("long").alias("open"))
    left, ready = rounds.counted(left, F.col("open") == 0)
    done, level = left.where("open = 0").select("node", F.lit(1).cast("long").alias("stage")), 1
    while True:
        closed = core.join(left.where("open = 0").select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("closed"))
        rest = left.where("open > 0").select("node", "open")
        if not ready:
            outer = among.join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
            stuck = [r[0] for r in rest.select("node").unionAll(outer).distinct().orderBy("node").limit(20).collect()]
            if stuck:
                raise ValueError("circular dependency among: " + ", ".join(stuck))
            break
        level += 1
        left, ready = rounds.counted(rest.join(closed, "node", "left").select("node", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")), F.col("open") == 0)
        done = done.unionAll(left.where("open = 0").select("node", F.lit(level).cast("long").alias("stage")))
    done = rounds.write(done)
    tops = among.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max("stage").alias("below"))
    outer = here.join(inner, "node", "left_anti").join(tops, "node", "left")
    return done.unionAll(outer.select("node", F.coalesce(F.col("below") + 1, F.lit(1).cast("long")).alias("stage")))


def stage_list(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, parallel, nodes): the levels of ``stages``, nodes in path order."""
    out = stages(candidates, edges).groupBy("stage").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return out.select("stage", (F.size("nodes") > 1).alias("parallel"), "nodes")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(node) that lie on a cycle: peel nodes without in- or out-edges, then keep those that reach themselves."""
    rounds = Rounds(edges.sparkSession, "cycles")
    edges, n = rounds.counted(edges.select("src", "dst").distinct())
    before = -1
    while n != before and n:
        before = n
        for _ in range(2):
            edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges, n = rounds.counted(edges)
    if not n:
        return edges.select(F.col("src").alias("node"))
    return reach(edges).where("root = node").select("node")


def dependency_paths(edges: DataFrame, max_depth: int) -> DataFrame:
    """(root, path, node, depth): simple paths by relation ordinals, to a depth cap."""
    e = edges.select("src", "dst", "ord")
    now = e.where("src <> dst").select(F.col("src").alias("root"), F.array("src", "dst").alias("p"), F.col("dst").alias("node"))
    out, depth = now.withColumn("depth", F.lit(1).cast("long")), 1
    while depth < max_depth:
        depth += 1
        now = now.join(e, F.col("node") == F.col("src")).where(~F.array_contains("p", F.col("dst"))).select("root", F.concat("p", F.array("dst")).alias("p"), F.col("dst").alias("node"))
        out = out.unionAll(now.withColumn("depth", F.lit(depth).cast("long")))
    return out.select("root", F.array_join("p", " > ").alias("path"), "node", "depth")


def dependency_tree(nodes: DataFrame, relations: DataFrame, root: str, which: str = "all", depth: int | None = None) -> DataFrame:
    """(ords, path, node, type, blackbox): every simple path from one root, in pre-order by ``ords``; targets that are no
    nodes are left out, parallel relations each have a row. ``depth`` caps the steps; without it a path ends only where
    every step would return to itself."""
    if depth is not None and (not isinstance(depth, int) or depth < 0):
        raise ValueError("depth must be a number of steps")
    known = nodes.select(F.col("path").alias("dst"), "blackbox")
    e = of_class(relations, which).select("src", "dst", "ord", "type").join(known, "dst")
    rounds = Rounds(nodes.sparkSession, "tree")
    e = rounds.write(e)
    now = nodes.where(F.col("path") == root).select(F.array().cast("array<long>").alias("ords"), F.array("path").alias("path"), F.col("path").alias("node"))
    if now.isEmpty():
        raise ValueError(f"node not found: {root}")
    out, n, at = None, 1, 0
    while n and (depth is None or at < depth):
        at += 1
        step = now.select("ords", "path", F.col("node").alias("src")).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.concat("ords", F.array(F.col("ord").cast("long"))).alias("ords"), F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), "type", "blackbox")
        now, n = rounds.counted(step)
        out = now if out is None else out.unionAll(now)
    return out if out is not None else now.select("ords", "path", "node", F.lit(None).cast("string").alias("type"), F.lit(False).alias("blackbox")).limit(0)
