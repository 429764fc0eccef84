"""Drift between stored and current files, and longest-prefix ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, prefixes
from ..sources.tables import GraphTables
from ..storage import written
from .aspects import above, effective, flow_membership, implies_closure
from .closure import structural
from .context import configured
from .rules import load_order

# File names of the graph's own files.
NODE_FILE, ASPECT_FILE, FLOW_FILE = "yg-node.yaml", "yg-aspect.yaml", "yg-flow.yaml"


def tracked(g: GraphTables, prefix: str = "graph") -> DataFrame:
    """(node, path, category): the files that bear on a node, once each: its own, its ancestors', those of every defined
    aspect in scope, of structural targets (flagged artifacts if a target has any, else all configured ones) and of
    flows, all of category graph below ``prefix``, and the mapped source paths."""
    at = lambda *parts: F.concat_ws("/", F.lit(prefix), *(F.lit(p) if i == 0 else p for i, p in enumerate(parts)))
    nodes = g.nodes.select(F.col("path").alias("owner"))
    some = written(configured(g).select(F.col("node").alias("owner"), "filename", "included"))
    files = written(nodes.select("owner", F.lit(NODE_FILE).alias("filename")).unionAll(some.select("owner", "filename")).select("owner", at("model", F.when(F.col("owner") != "", F.col("owner")), F.col("filename")).alias("path")))
    out = files.select(F.col("owner").alias("node"), "path")
    out = out.unionAll(above(g).join(files.withColumnRenamed("owner", "ancestor"), "ancestor").select("node", "path"))
    member = written(flow_membership(g))
    own = g.aspects.select(F.col("id").alias("aspect"), F.lit(ASPECT_FILE).alias("filename"))
    rules = own.unionAll(g.aspect_artifacts.select("aspect", "filename").join(own.select("aspect"), "aspect", "left_semi")).select("aspect", at("aspects", F.col("aspect"), F.col("filename")).alias("path"))
    out = out.unionAll(effective(g, implies_closure(g), member).join(rules, "aspect").select("node", "path"))
    flagged = some.groupBy("owner").agg(F.max("included").alias("any"))
    target = some.join(flagged, "owner").where("included or not any").select(F.col("owner").alias("dst"), at("model", F.col("owner"), F.col("filename")).alias("path"))
    # Few targets have artifacts, so relations are not told apart before; rows that come twice go with all others at the end.
    out = out.unionAll(structural(g.relations).select(F.col("src").alias("node"), "dst").join(target, "dst").select("node", "path"))
    steps = g.flows.select("flow", F.lit(FLOW_FILE).alias("filename")).unionAll(g.flow_artifacts.select("flow", "filename")).select("flow", at("flows", F.col("flow"), F.col("filename")).alias("path"))
    out = out.unionAll(member.join(steps, "flow").select("node", "path"))
    graph = out.select("node", "path", F.lit("graph").alias("category"))
    source = g.mappings.select("node", F.trim("mapping").alias("path"), F.lit("source").alias("category")).where("path <> ''")
    return graph.unionAll(source).groupBy("node", "path").agg(F.min("category").alias("category"))


def exclusions(g: GraphTables) -> DataFrame:
    """(node, prefix): mappings of nodes below that lie in a node's own mappings; their files are the lower node's."""
    m = g.mappings.select("node", F.trim("mapping").alias("mapping")).where("mapping <> ''")
    lower = m.select(F.col("node").alias("low"), F.col("mapping").alias("prefix"), F.explode(prefixes("mapping")).alias("mapping"))
    both = lower.join(m, "mapping")
    return both.where(F.col("low").startswith(F.concat("node", F.lit("/")))).select("node", "prefix").distinct()


def without_lower(files: DataFrame, excluded: DataFrame) -> DataFrame:
    """``files`` (node, path, ...) without those equal to or below an excluded prefix of their node."""
    hit = files.select("node", "path", F.explode(prefixes("path")).alias("prefix")).join(excluded, ["node", "prefix"], "left_semi").select("node", "path").distinct()
    return files.join(hit, ["node", "path"], "left_anti")


def category(path: str, prefix: str):
    """graph for paths that start with the graph directory's name, without regard to what follows; else source."""
    return F.when(F.col(path).startswith(prefix), "graph").otherwise("source")


def file_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(node, path, change, category) of files (node, path, hash, category) that differ: changed, added or deleted."""
    b, c = (d.select("node", "path", F.col("hash").alias(f"{n}_hash"), F.col("category").alias(f"{n}_cat")) for d, n in ((stored, "b"), (current, "c")))
    both = b.join(c, ["node", "path"], "full_outer").where(~F.col("b_hash").eqNullSafe(F.col("c_hash")))
    change = F.when(F.col("b_hash").isNull(), "added").when(F.col("c_hash").isNull(), "deleted").otherwise("changed")
    return both.select("node", "path", change.alias("change"), F.coalesce("c_cat", "b_cat").alias("category"))


def files(g: GraphTables) -> DataFrame:
    """Changes between the two snapshots of a projection."""
    return file_changes(g.baseline, g.current)


def classify(mapped: DataFrame, digests: DataFrame, there: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, status, details) of mapped nodes (node).

    ``digests`` (node, hash): stored; ``there`` (node): nodes with a mapped path that exists; ``current`` (node, hash);
    ``changes``: of ``file_changes``. Nodes without state are unmaterialized, or source-drift if a path exists; all paths gone
    is missing; an equal digest is ok; else by the categories of the changes, source-drift if no file is told.
    """
    named = F.when(F.col("change") == "deleted", F.concat("path", F.lit(" (deleted)"))).otherwise(F.col("path"))
    kinds = changes.groupBy("node").agg(F.max((F.col("category") == "graph").cast("int")).alias("g"), F.max((F.col("category") == "source").cast("int")).alias("s"), F.array_sort(F.collect_list(F.struct((F.col("change") == "deleted").alias("d"), named.alias("p")))).alias("names"))
    rows = mapped.select("node").distinct().join(digests.select("node", F.col("hash").alias("was")), "node", "left").join(current.select("node", F.col("hash").alias("now")), "node", "left").join(there.select("node", F.lit(True).alias("there")).distinct(), "node", "left").join(kinds, "node", "left")
    there_ = F.coalesce("there", F.lit(False))
    status = (
        F.when(F.col("was").isNull(), F.when(there_, "source-drift").otherwise("unmaterialized")).when(~there_, "missing").when(F.col("was").eqNullSafe(F.col("now")), "ok")
        .when((F.col("g") == 1) & (F.col("s") == 1), "full-drift").when(F.col("g") == 1, "graph-drift").otherwise("source-drift")
    )
    said = F.concat(F.lit("Changed files: "), F.array_join(F.transform("names", lambda x: x["p"]), ", "))
    details = (
        F.when(F.col("was").isNull(), F.when(there_, "No drift state recorded, files exist (run drift-sync after materialization)").otherwise("No drift state recorded, files do not exist"))
        .when(F.col("status") == "missing", "All source mapping paths are missing").when(F.col("status") != "ok", F.coalesce(said, F.lit("File(s) modified since last sync")))
    )
    return rows.withColumn("status", status).select("node", "status", details.alias("details"))


def status(g: GraphTables, mapped: DataFrame | None = None) -> DataFrame:
    """(node, status) of a projection's snapshots, for nodes with files in either, or for ``mapped`` (node)."""
    all_ = g.baseline.select("node").unionAll(g.current.select("node")).distinct() if mapped is None else mapped
    return classify(all_, digest(g.baseline).withColumnRenamed("digest", "hash"), g.current.select("node"), digest(g.current).withColumnRenamed("digest", "hash"), files(g)).select("node", "status")


def in_section(statuses: DataFrame, drifted_only: bool = True) -> DataFrame:
    """(section, node, status): source drift, then graph drift; a node of both is in both."""
    s = statuses.where("status <> 'ok'") if drifted_only else statuses
    src = s.where("status <> 'graph-drift'").select(F.lit("source").alias("section"), "node", "status")
    return src.unionAll(s.where("status not in ('source-drift', 'missing', 'unmaterialized')").select(F.lit("graph").alias("section"), "node", "status"))


def sections(statuses: DataFrame, limit: int) -> DataFrame:
    """(section, node, rn, total): the first nodes of each section, and how many it has."""
    rows = in_section(statuses).select("section", "node")
    total = rows.groupBy("section").agg(F.count("*").alias("total"))
    rn = F.row_number().over(Window.partitionBy("section").orderBy("node")).cast("long")
    return rows.withColumn("rn", rn).where(F.col("rn") <= limit).join(F.broadcast(total), "section")


def digest(snapshot: DataFrame) -> DataFrame:
    """(node, digest): SHA-256 of 'path:hash' lines in locale order of the paths."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.collate(F.col("path"), "UNICODE").alias("k"), "hash"))), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["hash"]))
    return snapshot.groupBy("node").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def _lines(path: str, value: str):
    """SHA-256 of 'path:value' lines in locale order of the paths."""
    rows = F.array_sort(F.collect_list(F.struct(F.collate(F.col(path), "UNICODE").alias("k"), F.col(value).alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["v"])), "\n"), 256)


def path_digests(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """(node, mapping, is_file, digest): a mapped file has its own hash, a mapped directory that of the files below it, named
    from there. ``files``: path, hash. A mapping that is neither has no row; a file is hashed once for each directory above it
    that is mapped."""
    claims = mappings.select("node", comparable("mapping").alias("mapping")).where("mapping <> ''").distinct()
    below = files.select("path", "hash", F.explode(prefixes("path")).alias("mapping")).join(claims.select("mapping").distinct(), "mapping", "left_semi")
    rest = F.expr("substring(path, length(mapping) + 2)")
    one = below.groupBy("mapping").agg(F.max(F.when(F.col("path") == F.col("mapping"), F.col("hash"))).alias("own"), F.count("*").alias("n"))
    inside = below.where("path <> mapping").select("mapping", rest.alias("rest"), "hash").groupBy("mapping").agg(_lines("rest", "hash").alias("whole"))
    found = one.join(inside, "mapping", "left").select("mapping", F.col("own").isNotNull().alias("is_file"), F.coalesce("own", "whole").alias("digest"))
    return claims.join(found, "mapping").select("node", "mapping", "is_file", "digest")


def mapping_digests(digests: DataFrame) -> DataFrame:
    """(node, n_paths, digest): one hash for all mapped paths of a node, of ``path_digests``."""
    return digests.groupBy("node").agg(F.count("*").alias("n_paths"), _lines("mapping", "digest").alias("digest"))


def garbage(g: GraphTables, valid: DataFrame) -> DataFrame:
    """(node) with stored state that is not among ``valid`` (path)."""
    return g.baseline.select("node").distinct().join(valid.select(F.col("path").alias("node")), "node", "left_anti")


def owners(g: GraphTables) -> DataFrame:
    """(file, node, mapping, direct): the longest mapping that equals the file or is a directory above it; of equal ones that of
    the first node in load order."""
    claims = g.mappings.select("node", comparable("mapping").alias("mapping")).where("mapping <> ''")
    hit = g.files.select("file", F.explode(prefixes("file")).alias("mapping")).join(claims, "mapping")
    best = hit.groupBy("file").agg(F.min(F.struct((-F.length("mapping")).alias("n"), load_order("node").alias("k"), "mapping", "node")).alias("b"))
    return best.select("file", F.col("b.node").alias("node"), F.col("b.mapping").alias("mapping"), (F.col("b.mapping") == F.col("file")).alias("direct"))
