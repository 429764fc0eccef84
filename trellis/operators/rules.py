"""Integrity rules; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, load_order, prefixes, trim, units
from ..sources.tables import GraphTables
from . import context
from .anchors import found, found_near
from .aspects import circular, implies_closure
from .closure import cyclic_core, structural, written


def missing(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is not among ``known``."""
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def unknown_type(g: GraphTables, types: list[str]) -> DataFrame:
    return g.nodes.where(~F.col("type").isin(types)).select(F.col("path").alias("node"), "type")


def unknown_aspect(g: GraphTables, aspects: DataFrame) -> DataFrame:
    return missing(g.node_aspects, "aspect", aspects, "id").select(F.col("path").alias("node"), "aspect")


def broken_relation(g: GraphTables, nodes: DataFrame) -> DataFrame:
    """(node, target, suggestion): the suggestion is the first node in load order of those that share most leading
    segments with the target; none if none shares the first."""
    broken = missing(g.relations, "dst", nodes, "path").select(F.col("src").alias("node"), F.col("dst").alias("target")).distinct()
    first = nodes.select("path", F.explode(prefixes("path")).alias("prefix")).groupBy("prefix").agg(F.min(F.struct(load_order("path").alias("k"), "path")).alias("f"))
    near = broken.select("target").distinct().select("target", F.posexplode(prefixes("target")).alias("shared", "prefix")).join(first, "prefix")
    best = near.groupBy("target").agg(F.max_by("f.path", "shared").alias("suggestion"))
    return broken.join(best, "target", "left").select("node", "target", "suggestion")


def siblings(broken: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, n_siblings, siblings): names under the missing target's parent, sorted, as hints.

    Names are gathered once for each parent, and the targets below it take over the joined text."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    top = lambda c: F.coalesce(c, F.lit(""))
    parent = broken.select("target", F.regexp_replace("target", "/?[^/]*$", "").alias("parent")).distinct()
    below = nodes.select(top(F.col("parent_path")).alias("parent"), name("path").alias("name"), "path").where("path <> ''")
    parent = written(parent)
    below = below.join(parent.select("parent").distinct(), "parent", "left_semi").groupBy("parent").agg(F.sort_array(F.collect_set("name")).alias("s"))
    found = written(below.select("parent", F.size("s").cast("long").alias("n_siblings"), F.array_join("s", ", ").alias("siblings")))
    return parent.join(found, "parent").select("target", "n_siblings", "siblings")


def broken_flow_ref(g: GraphTables, nodes: DataFrame) -> DataFrame:
    return missing(g.flow_nodes, "node", nodes, "path").select("flow", "node")


def broken_flow_aspect(g: GraphTables, aspects: DataFrame) -> DataFrame:
    return missing(g.flow_aspects, "aspect", aspects, "id").select("flow", "aspect")


def implied_missing(g: GraphTables, aspects: DataFrame) -> DataFrame:
    return missing(g.implies, "implied", aspects, "id").select(F.col("id").alias("aspect"), "implied")


def overlapping(mappings: DataFrame) -> DataFrame:
    """(mapping_a, mapping_b, blamed): equal mappings of different nodes, and a mapping_a inside a mapping_b of a node
    neither above nor below its own; blamed is the later node in load order.

    Prefixes of one side meet the other by equality.
    """
    mappings = mappings.select("node", comparable("mapping").alias("mapping")).where("mapping <> ''")
    a = mappings.select(F.col("node").alias("na"), F.col("mapping").alias("ma"), F.explode(prefixes("mapping")).alias("mb"))
    b = mappings.select(F.col("node").alias("nb"), F.col("mapping").alias("mb"))
    before = load_order("na") < load_order("nb")
    both = a.join(b, "mb").where((F.col("na") != F.col("nb")) & ((F.col("ma") != F.col("mb")) | before))
    kin = F.col("na").startswith(F.concat("nb", F.lit("/"))) | F.col("nb").startswith(F.concat("na", F.lit("/")))
    return both.where((F.col("ma") == F.col("mb")) | ~kin).select(F.col("ma").alias("mapping_a"), F.col("mb").alias("mapping_b"), F.when(before, F.col("nb")).otherwise(F.col("na")).alias("blamed"))


def structural_cycle(edges: DataFrame, blackbox: DataFrame) -> DataFrame:
    """(node): on a cycle without blackbox members."""
    plain = missing(missing(edges, "src", blackbox, "node"), "dst", blackbox, "node")
    return cyclic_core(plain)


def untolerated(g: GraphTables) -> DataFrame:
    """(src, dst) of structural relations between nodes that are no blackboxes: a cycle with a blackbox is tolerated."""
    plain = g.nodes.where("not blackbox").select("path")
    edges = structural(g.relations).join(plain.withColumnRenamed("path", "src"), "src", "left_semi")
    return edges.join(plain.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src", "dst")


def missing_artifact(g: GraphTables, types: DataFrame | None = None) -> DataFrame:
    """(node, artifact, reason_kind, n): artifact types whose condition holds for a node that lacks them.

    always: not for blackboxes; incoming and outgoing: n relations of any class; aspect: the node's own entry.
    ``types`` (filename, required, when) is the configuration's, a small table.
    """
    types = g.artifact_types if types is None else types
    when = F.col("when")
    kind = F.when(F.col("required") == "always", "always").when(when == "has_incoming_relations", "incoming").when(when == "has_outgoing_relations", "outgoing").when(when.rlike("^(has_aspect|has_tag):"), "aspect")
    wanted = types.where("required <> 'never'").select(F.col("filename").alias("artifact"), kind.alias("reason_kind"), F.regexp_replace("when", "^(has_aspect|has_tag):", "").alias("aspect")).where("reason_kind is not null")
    count = lambda c, n: g.relations.groupBy(F.col(c).alias("path")).agg(F.count("*").alias(n))
    own = g.node_aspects.groupBy("path").agg(F.collect_set("aspect").alias("own"))
    rows = g.nodes.select("path", "blackbox").join(count("dst", "n_in"), "path", "left").join(count("src", "n_out"), "path", "left").join(own, "path", "left").join(F.broadcast(wanted))
    is_ = lambda k: F.col("reason_kind") == k
    n = F.when(is_("incoming"), F.col("n_in")).when(is_("outgoing"), F.col("n_out")).when(is_("aspect"), F.array_contains("own", F.col("aspect")).cast("long")).when(is_("always"), (~F.col("blackbox")).cast("long"))
    rows = rows.select(F.col("path").alias("node"), "artifact", "reason_kind", F.coalesce(n, F.lit(0)).cast("long").alias("n")).where("n > 0")
    return rows.join(g.artifacts.select("node", F.col("filename").alias("artifact")).distinct(), ["node", "artifact"], "left_anti")


def first_sources(g: GraphTables, most: int = 5) -> DataFrame:
    """(node, n_sources, sources): how many nodes relate to a node, and the first ``most`` of them in byte order. A limit within
    each group keeps what is gathered that short, before and after the shuffle."""
    pairs = written(g.relations.select(F.col("dst").alias("node"), "src").distinct())
    n = pairs.groupBy("node").agg(F.count("*").alias("n_sources"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("src"))
    some = pairs.withColumn("k", rank).where(F.col("k") <= most).groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("src")), ", ").alias("sources"))
    return n.join(some, "node").select("node", "n_sources", "sources")


def shallow(g: GraphTables, least: int | None = None) -> DataFrame:
    """(node, artifact, n): artifacts with fewer units than the least, without the blanks around them."""
    least = g.settings.min_artifact_length if least is None else least
    n = units(trim(F.coalesce("content", F.lit(""))))
    return g.artifacts.select("node", F.col("filename").alias("artifact"), n.alias("n")).where(F.col("n") < least)


def over_budget(g: GraphTables) -> DataFrame:
    b = context.budget(g).join(g.nodes.where("not blackbox").select(F.col("path").alias("node")), "node", "left_semi")
    return b.where("status <> 'ok'").select("node", F.when(F.col("status") == "error", "W006").otherwise("W005").alias("code"))


def fan_out(g: GraphTables, most: int | None = None) -> DataFrame:
    most = g.settings.max_direct_relations if most is None else most
    return g.relations.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > most)


def unpaired_event(g: GraphTables) -> DataFrame:
    """(node, other, direction): emits without the other's listens, and the reverse."""
    e = g.relations.select("src", "dst", "type").distinct()
    emits, listens = e.where("type = 'emits'"), e.where("type = 'listens'")
    turned = lambda x: x.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    row = lambda x, d: x.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(d).alias("direction"))
    return row(emits.join(turned(listens), ["src", "dst"], "left_anti"), "emits").unionAll(row(listens.join(turned(emits), ["src", "dst"], "left_anti"), "listens"))


def required_aspect(g: GraphTables, types: DataFrame | None = None) -> DataFrame:
    """(node, aspect): aspects that a node's type requires and neither its own aspects nor what they imply cover.

    Not for blackboxes, nor for nodes whose aspects lead into a cycle; an aspect must be defined to cover.
    """
    closure = implies_closure(g)
    own = g.node_aspects.select(F.col("path").alias("node"), "aspect")
    covered = own.unionAll(own.join(closure, "aspect").select("node", F.col("implied").alias("aspect")))
    covered = covered.join(g.aspects.select(F.col("id").alias("aspect")), "aspect", "left_semi").distinct()
    loops = own.join(circular(closure), "aspect", "left_semi").select("node").distinct()
    need = (g.node_types if types is None else types).select("type", F.explode("required_aspects").alias("aspect"))
    rows = g.nodes.where("not blackbox").select(F.col("path").alias("node"), "type").join(F.broadcast(need), "type").select("node", "aspect")
    return rows.join(loops, "node", "left_anti").join(covered, ["node", "aspect"], "left_anti").select("node", "aspect")


def anchor_not_found(g: GraphTables, texts: DataFrame) -> DataFrame:
    """(node, aspect, anchor): anchors of a node's aspect that none of the node's texts holds. ``texts``: node, content;
    a node without texts has no rows."""
    wanted = g.node_aspects.select(F.col("path").alias("node"), "aspect", F.explode("anchors").alias("anchor")).distinct()
    wanted = written(wanted.join(texts.select("node").distinct(), "node", "left_semi"))
    return wanted.join(found_near(texts, wanted, ["node"]), ["node", "anchor"], "left_anti").select("node", "aspect", "anchor")


def anchors_missing(g: GraphTables) -> DataFrame:
    """(anchor): literal texts that no artifact holds."""
    anchors = g.anchors.distinct()
    return anchors.join(found(g.artifacts, anchors, []), "anchor", "left_anti")


def structural_edges(g: GraphTables) -> DataFrame:
    return structural(g.relations).select("src", "dst")


def bad_condition(conditions: DataFrame, aspects: DataFrame) -> DataFrame:
    """(artifact, aspect): artifact types (artifact, condition) whose condition names an unknown aspect."""
    named = conditions.select("artifact", F.regexp_extract("condition", "^(?:has_aspect|has_tag):(.*)$", 1).alias("aspect")).where("condition rlike '^(has_aspect|has_tag):'")
    return missing(named, "aspect", aspects, "id").select("artifact", "aspect")


def duplicate_aspect(aspects: DataFrame) -> DataFrame:
    """(id, n): aspect ids bound more than once."""
    return aspects.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def implies_cycle(implies: DataFrame) -> DataFrame:
    """(aspect): aspects that imply themselves through others."""
    return cyclic_core(implies.select(F.col("id").alias("src"), F.col("implied").alias("dst"))).select(F.col("node").alias("aspect"))


def missing_schema(schemas: DataFrame, required: tuple[str, ...] = ("node", "aspect", "flow")) -> DataFrame:
    """(schema): required schemas that are not there."""
    return schemas.sparkSession.createDataFrame([(x,) for x in required], "schema string").join(schemas.select("schema").distinct(), "schema", "left_anti")


def mapping_missing(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """(node, mapping): mappings that are neither a file nor a directory above one."""
    there = files.select(F.explode(prefixes("file")).alias("mapping")).distinct()
    return mappings.join(there, "mapping", "left_anti").select("node", "mapping")


def issue(rows: DataFrame, code: str, severity: str, node: str | None) -> DataFrame:
    """(code, severity, node) of a rule's rows; those of no node have null. A column named code takes precedence."""
    at = F.col(node) if node else F.lit(None).cast("string")
    return rows.select((F.col("code") if "code" in rows.columns else F.lit(code)).alias("code"), F.lit(severity).alias("severity"), at.alias("node"))


def relevant(g: GraphTables, issues: DataFrame, node: str) -> DataFrame:
    """Errors that bear on one node's package: of no node, or of itself, an ancestor or a direct relation's target."""
    near = g.nodes.where(F.col("path") == node).select(F.explode(F.concat(prefixes("path"), F.array(F.lit("")))).alias("node"))
    near = near.unionAll(g.relations.where(F.col("src") == node).select("dst")).distinct()
    errors = issues.where("severity = 'error'")
    return errors.where("node is null").unionAll(errors.join(near, "node", "left_semi").select(*issues.columns))


def scoped(issues: DataFrame, scope: str, nodes: DataFrame) -> DataFrame:
    """Issues of a node and the nodes below it; issues of no node always pass. Raises on an unknown scope."""
    if nodes.where(F.col("path") == scope).isEmpty():
        raise ValueError(f"invalid scope: {scope}")
    return issues.where((F.col("node") == scope) | F.col("node").startswith(scope + "/") | F.col("node").isNull())
