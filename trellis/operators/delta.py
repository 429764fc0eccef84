"""What changes in the packages when the graph changes: two snapshots are compared table by table, inserted and deleted
rows are followed to the nodes whose packages they touch, and only these are counted anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import GraphTables
from ..storage import Rounds, written
from . import context
from .aspects import above, flow_membership, implies_closure, sources


def changed_rows(before: DataFrame, after: DataFrame, columns: list) -> DataFrame:
    """The distinct rows of ``columns`` that one side has more often than the other; texts are best given by hash."""
    one = lambda df, sign: df.select(*columns).withColumn("_n", F.lit(sign))
    both = one(before, 1).unionAll(one(after, -1))
    names = [c for c in both.columns if c != "_n"]
    return both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(*names)


def touched(before: GraphTables, after: GraphTables) -> DataFrame:
    """(node): every node whose package may differ. Changed settings or artifact types touch all nodes.

    A node's own row, artifacts, aspects and flows touch it and the nodes below it; its row and its artifacts also those with
    a relation to it; a relation its source; a flow's texts and aspects its members; an aspect whoever has one that leads to it.
    """
    rounds = Rounds(after.nodes.sparkSession, "touched")
    everyone = before.nodes.select(F.col("path").alias("node")).unionAll(after.nodes.select("path")).distinct()
    whole = before.settings != after.settings or not changed_rows(before.artifact_types, after.artifact_types, ["filename", "ord", "included"]).isEmpty()
    if whole:
        return everyone
    sides = (before, after)
    diff = lambda table, *columns: changed_rows(getattr(before, table), getattr(after, table), list(columns))
    body = F.xxhash64("content").alias("h"), F.length("content").alias("n"), F.col("content").isNull().alias("none")
    named = lambda df, c: df.select(F.col(c).alias("node"))
    heard = rounds.write(named(diff("nodes", "path", "name", "yaml_raw"), "path").unionAll(named(diff("artifacts", "node", "filename", *body), "node")).distinct())
    spread = heard.unionAll(named(diff("node_aspects", "path", "aspect", F.array_join("exceptions", "\n").alias("e")), "path")).unionAll(named(diff("flow_nodes", "flow", "node"), "node"))
    spread = rounds.write(spread.distinct())
    out = [spread, named(diff("relations", "src", "dst", "type", F.array_join("consumes", ",").alias("c"), "failure", "event_name"), "src")]
    flows = diff("flow_aspects", "flow", "aspect").select("flow").unionAll(diff("flow_artifacts", "flow", "filename", *body).select("flow"))
    ids = [diff("implies", "id", "implied").select("id"), diff("aspects", "id", "stability").select("id"), diff("aspect_artifacts", "aspect", "filename", *body).select("aspect")]
    flows, ids = rounds.write(flows.distinct()), rounds.write(reduce(DataFrame.unionAll, ids).distinct())
    leading = ids.select(F.col("id").alias("aspect"))
    for g in sides:
        leading = leading.unionAll(implies_closure(g).join(ids.withColumnRenamed("id", "implied"), "implied", "left_semi").select("aspect"))
    leading = rounds.write(leading.distinct())
    any_flow, any_aspect = not flows.isEmpty(), not leading.isEmpty()
    for g in sides:
        out.append(above(g).join(spread.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").select("node"))
        out.append(named(g.relations.join(heard.withColumnRenamed("node", "dst"), "dst", "left_semi"), "src"))
        if any_flow:
            out.append(flow_membership(g).join(flows, "flow", "left_semi").select("node"))
        if any_aspect:
            out.append(sources(g).join(leading, "aspect", "left_semi").select("node"))
    return rounds.write(reduce(DataFrame.unionAll, out).distinct())


def budget_changes(before: GraphTables, after: GraphTables, stored: DataFrame) -> DataFrame:
    """(node, tokens_before, tokens_after, status): package sizes at both snapshots, null where a node has none.

    ``stored`` (node, tokens) are the sizes before. Nodes that no change touches keep theirs; status is that after.
    """
    some = touched(before, after)
    new = written(context.budget(after, some)).select("node", F.col("tokens").alias("tokens_after"))
    old = stored.select("node", F.col("tokens").alias("tokens_before"))
    kept = old.join(some, "node", "left_anti").select("node", "tokens_before", F.col("tokens_before").alias("tokens_after"))
    changed = old.join(some, "node", "left_semi").join(new, "node", "full_outer").select("node", "tokens_before", "tokens_after")
    rows = kept.unionAll(changed)
    return rows.withColumn("status", F.when(F.col("tokens_after").isNotNull(), context.status_of(after, F.col("tokens_after"))))
