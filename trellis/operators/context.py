"""Context packages: their size from lengths alone, and their texts where these are asked for.

A package has layers in this order: global, hierarchy (each ancestor from the top), own, relational (in the order of
the relations), flows, aspects. Its size counts the layers' contents joined by blank lines, four UTF-16 units a token.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape, rtrim, tokens, trim, units
from ..sources.tables import GraphTables
from ..storage import Rounds, dealt, written
from . import bitmaps
from .aspects import above, circular, expanded, flow_membership, implies_closure, implies_order, listed, resolved, sources
from .closure import EVENT, STRUCTURAL

# The words of the layers.
NODE_FILE, NO_FLOW_FILES = "yg-node.yaml", "(no artifacts)"
#: Nodes whose packages are hashed together; the columns that tell the place of a piece in its package.
ALIKE = 512
_PLACE = ["section", "k1", "k2", "k3", "k4", "k5"]
STABILITY, EXCEPTION = "\n**Stability tier:** ", "\n\n⚠ **Exception for this node:** "


def _joined(column: str):
    """'a, b' of an array, null for a null or empty one."""
    return F.when(F.size(column) > 0, F.array_join(column, ", "))


def _block(kind: str = "filename"):
    return F.concat(F.lit("### "), kind, F.lit("\n"), F.coalesce("content", F.lit("")))


def _preamble():
    """What a structural relation says before the target's artifacts."""
    used = F.when(_joined("consumes").isNotNull(), F.concat(F.lit("Consumes: "), _joined("consumes"), F.lit("\n\n")))
    fails = F.when(F.col("failure") != "", F.concat(F.lit("On failure: "), "failure", F.lit("\n\n")))
    return F.concat(F.coalesce(used, F.lit("")), F.coalesce(fails, F.lit("")))


def _event():
    """(name, content) of an event relation to a target ``dst`` named ``dst_name``."""
    name, emits = F.coalesce("event_name", "dst_name"), F.col("type") == "emits"
    said = F.concat(F.when(emits, "Target: ").otherwise("Source: "), "dst", F.when(emits, "\nYou publish ").otherwise("\nYou listen for "), name, F.lit("."))
    return name, F.concat(said, F.coalesce(F.when(_joined("consumes").isNotNull(), F.concat(F.lit("\nConsumes: "), _joined("consumes"))), F.lit("")))


def configured(g: GraphTables) -> DataFrame:
    """Node artifacts of configured types, with their place in the configuration (ord), in locale order (alpha), and
    whether relations include them. The configuration is one file, so its table is small."""
    kinds = g.artifact_types.select("filename", F.col("ord").alias("ord"), "included")
    names = [r[0] for r in g.artifact_types.select("filename").orderBy(F.collate(F.col("filename"), "UNICODE")).collect()]
    places = g.nodes.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "filename string, alpha int")
    return g.artifacts.join(F.broadcast(kinds.join(places, "filename")), "filename")


def artifact_units(g: GraphTables) -> DataFrame:
    """(node, own, all, related): units of a node's artifacts after its node file, alone, and as a relation's target:
    flagged ones if it has any, else all, without the blanks at the end."""
    text = F.coalesce("content", F.lit(""))
    # Blanks at the end of a text; of a blank text the line break before it as well.
    tail = units(text) - units(rtrim(text)) + F.when(rtrim(text) == "", 1).otherwise(0)
    one = configured(g).select("node", "ord", "alpha", "included", (units("filename") + 5 + units(text)).alias("u"), tail.alias("t"))
    flagged = lambda x: F.when(F.col("included"), x)
    sums = one.groupBy("node").agg(
        F.sum("u").alias("s"), F.count("*").alias("n"), F.max(F.struct("alpha", "t")).alias("last"),
        F.sum(flagged(F.col("u"))).alias("fs"), F.count(flagged(F.lit(1))).alias("fn"), F.max(flagged(F.struct("ord", "t"))).alias("flast"),
    )
    whole = F.col("s") + 2 * (F.col("n") - 1)
    related = F.when(F.col("fn") > 0, F.col("fs") + 2 * (F.col("fn") - 1) - F.col("flast.t")).otherwise(whole - F.col("last.t"))
    return sums.select("node", (F.col("s") + 2 * F.col("n")).alias("own"), whole.alias("all"), related.alias("related"))


def _concluded(files: DataFrame, key: str) -> DataFrame:
    """(key, units) of files joined by blank lines."""
    one = files.select(key, (units("filename") + 5 + units(F.coalesce("content", F.lit("")))).alias("u"))
    return one.groupBy(key).agg((F.sum("u") + 2 * (F.count("*") - 1)).alias("units"))


class Assembly:
    """What several layers need, made once: the nodes that can be assembled, memberships and aspects."""

    def __init__(self, g: GraphTables, only: DataFrame | None = None):
        self.g, self.closure = g, implies_closure(g)
        self.edges = written(g.relations)  # read several times, and dear where it is an aggregate
        self.member = written(flow_membership(g))
        self.above = above(g)
        self.base = written(sources(g, self.member).select("node", "aspect").distinct())
        nodes = g.nodes if only is None else g.nodes.join(only.select(F.col("node").alias("path")).distinct(), "path", "left_semi")
        # A relation to a missing node, or an aspect that leads into a cycle, leaves a node without a package.
        lost = self.edges.join(dealt(g.nodes.select(F.col("path").alias("dst"))), "dst", "left_anti").select(F.col("src").alias("path"))
        round_ = self.base.join(circular(self.closure), "aspect", "left_semi").select(F.col("node").alias("path"))
        self.nodes = written(nodes.select("path", "parent_path", "depth", "name", "yaml_raw", "blackbox").join(lost.unionAll(round_).distinct(), "path", "left_anti"))
        self.ids = dealt(self.nodes.select(F.col("path").alias("node")))

    def here(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.ids, "node", "left_semi")

    def relations(self) -> DataFrame:
        """Relations of assembled nodes, without those to an ancestor, with the target's name."""
        names = dealt(self.g.nodes.select(F.col("path").alias("dst"), F.col("name").alias("dst_name")))
        out = self.edges.join(self.ids.withColumnRenamed("node", "src"), "src", "left_semi")
        return out.join(dealt(self.above.select(F.col("node").alias("src"), F.col("ancestor").alias("dst"))), ["src", "dst"], "left_anti").join(names, "dst")

    def aspects(self) -> DataFrame:
        """(node, aspect): every defined aspect in scope."""
        base = self.here(self.base)
        full = base.unionAll(base.join(self.closure, "aspect").select("node", F.col("implied").alias("aspect"))).distinct()
        return resolved(full, self.g.aspects).select("node", "aspect")

    def exceptions(self) -> DataFrame:
        """(node, aspect, note) of a node's own entries."""
        return self.g.node_aspects.where(F.size("exceptions") > 0).select(F.col("path").alias("node"), "aspect", F.array_join("exceptions", "; ").alias("note"))


def layers(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, layer_type, units): one row per layer of each package; no artifact text leaves the scan."""
    a = Assembly(g, only)
    art = written(artifact_units(g))
    kind = lambda t, n: (F.lit(t).alias("layer_type"), n.cast("long").alias("units"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = a.ids.select("node", *kind("global", F.lit(14 + len(g.settings.name.encode("utf-16-le")) // 2)))
    up = a.here(a.above).join(art.select(F.col("node").alias("ancestor"), "all"), "ancestor", "left")
    own = a.nodes.select(F.col("path").alias("node"), units(trim("yaml_raw")).alias("y")).join(art.select("node", "own"), "node", "left")
    rel = a.relations()
    pre = _preamble()
    structural = rel.where(F.col("type").isin(STRUCTURAL)).join(art.select(F.col("node").alias("dst"), "related"), "dst", "left")
    flows = _concluded(g.flow_artifacts, "flow")
    rules = _concluded(g.aspect_artifacts, "aspect")
    tiers = g.aspects.select(F.col("id").alias("aspect"), F.when(F.col("stability") != "", units("stability") + len(STABILITY)).alias("tier"))
    scope = a.aspects().join(rules, "aspect", "left").join(tiers, "aspect", "left").join(a.exceptions().select("node", "aspect", (units("note") + len(EXCEPTION)).alias("note")), ["node", "aspect"], "left")
    for more in (
        up.select("node", *kind("hierarchy", zero(F.col("all")))),
        own.select("node", *kind("own", F.col("y") + len(NODE_FILE) + 5 + zero(F.col("own")))),
        structural.select(F.col("src").alias("node"), *kind("relational", F.when(F.col("related").isNull(), units(rtrim(pre))).otherwise(units(pre) + F.col("related")))),
        rel.where(F.col("type").isin(EVENT)).select(F.col("src").alias("node"), *kind("relational", units(_event()[1]))),
        a.here(a.member).join(flows, "flow", "left").select("node", *kind("flows", F.coalesce("units", F.lit(len(NO_FLOW_FILES))))),
        scope.select("node", *kind("aspects", zero(F.col("units")) + zero(F.col("tier")) + zero(F.col("note")))),
    ):
        out = out.unionAll(more)
    return out


def status_of(g: GraphTables, n_tokens):
    return F.when(n_tokens >= g.settings.error, "error").when(n_tokens >= g.settings.warning, "warning").otherwise("ok")


def _status(g: GraphTables):
    return status_of(g, F.col("tokens"))


def _counted(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, layer_type, units, n, lost, here): partial sums of a node's layers; rows of no layer have no units and n 0.

    The rows of ``layers`` without taking nodes out, for one aggregate. A relation to a missing node, or an aspect that leads into a cycle, marks the
    node's row instead of taking it out beforehand; an ancestor is told by its path. Written besides: artifact sizes and
    flow memberships.
    """
    art, closure = written(artifact_units(g)), implies_closure(g)
    member = written(flow_membership(g))
    zero = lambda c: F.coalesce(c, F.lit(0))
    row = lambda df, kind, n, lost=F.lit(False), count=F.lit(1), here=F.lit(False): df.select("node", F.lit(kind).alias("layer_type"), n.cast("long").alias("units"), count.cast("long").alias("n"), lost.alias("lost"), here.alias("here"))
    here = lambda df, c="node": df if only is None else df.join(only.select(F.col("node").alias(c)).distinct(), c, "left_semi")
    nodes = here(g.nodes, "path")
    start = nodes.select(F.col("path").alias("node"), units(trim("yaml_raw")).alias("y")).join(art.select("node", "own"), "node", "left")
    head, fixed = 14 + len(g.settings.name.encode("utf-16-le")) // 2, len(NODE_FILE) + 5
    out = row(start, "own", F.col("y") + fixed + zero(F.col("own")), here=F.lit(True)).unionAll(row(nodes.select(F.col("path").alias("node")), "global", F.lit(head)))
    out = out.unionAll(row(here(above(g)).join(art.select(F.col("node").alias("ancestor"), "all"), "ancestor", "left"), "hierarchy", zero(F.col("all"))))

    names = g.nodes.select(F.col("path").alias("dst"), F.col("name").alias("dst_name"), F.lit(True).alias("known"))
    rel = here(g.relations, "src").join(names, "dst", "left").join(art.select(F.col("node").alias("dst"), "related"), "dst", "left").withColumnRenamed("src", "node")
    higher = F.col("node").startswith(F.concat("dst", F.lit("/"))) | (F.col("dst") == "") & (F.col("node") != "")
    pre, is_event = _preamble(), F.col("type").isin(EVENT)
    # The text of a row is made once, then measured.
    rel = rel.withColumn("said", F.when(is_event, _event()[1]).when(F.col("related").isNull(), rtrim(pre)).otherwise(pre))
    size = units("said") + F.when(is_event, F.lit(0)).otherwise(zero(F.col("related")))
    counts = (is_event | F.col("type").isin(STRUCTURAL)) & ~higher & F.col("known").isNotNull()
    out = out.unionAll(row(rel, "relational", F.when(counts, size).otherwise(0), F.col("known").isNull(), counts.cast("int")))

    out = out.unionAll(row(here(member).join(_concluded(g.flow_artifacts, "flow"), "flow", "left"), "flows", F.coalesce("units", F.lit(len(NO_FLOW_FILES)))))
    base = here(sources(g, member)).select("node", "aspect").distinct()
    tiers = g.aspects.select(F.col("id").alias("aspect"), F.when(F.col("stability") != "", units("stability") + len(STABILITY)).alias("tier"))
    known = resolved(base.unionAll(base.join(closure, "aspect").select("node", F.col("implied").alias("aspect"))).distinct(), g.aspects)
    notes = g.node_aspects.where(F.size("exceptions") > 0).select(F.col("path").alias("node"), "aspect", (units(F.array_join("exceptions", "; ")) + len(EXCEPTION)).alias("note"))
    scope = known.join(_concluded(g.aspect_artifacts, "aspect"), "aspect", "left").join(tiers, "aspect", "left").join(notes, ["node", "aspect"], "left")
    out = out.unionAll(row(scope, "aspects", zero(F.col("units")) + zero(F.col("tier")) + zero(F.col("note"))))
    round_ = base.join(circular(closure), "aspect", "left_semi")
    return out.unionAll(row(round_, "aspects", F.lit(0), F.lit(True), F.lit(0)))


def sums(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, units, n): the units of a node's layers and how many these are, for each node that can be assembled."""
    total = _counted(g, only).groupBy("node").agg(F.sum("units").alias("units"), F.sum("n").alias("n"), F.max("lost").alias("lost"), F.max("here").alias("here"))
    return total.where("here and not lost").select("node", "units", "n")


def layer_sums(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, layer_type, n_layers, units): the same by kind of layer, one row for each kind that a node has. Nodes that cannot
    be assembled are told by these few rows of theirs, not by joins with all layers."""
    total = _counted(g, only).groupBy("node", "layer_type").agg(F.sum("n").alias("n_layers"), F.sum("units").alias("units"), F.max("lost").alias("lost"), F.max("here").alias("here"))
    node = Window.partitionBy("node")
    total = total.withColumns({"lost": F.max("lost").over(node), "here": F.max("here").over(node)})
    return total.where("here and not lost and n_layers > 0").select("node", "layer_type", "n_layers", "units")


def budget(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, tokens, status) of every node that can be assembled."""
    total = sums(g, only).select("node", tokens(F.col("units") + 2 * (F.col("n") - 1)).alias("tokens"))
    return total.withColumn("status", _status(g))


def _texts(files: DataFrame, key: str, order, name: str) -> DataFrame:
    """(key, name): files as blocks joined by blank lines, in the order of ``order``."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), _block().alias("b")))), lambda x: x["b"])
    return files.groupBy(key).agg(F.array_join(blocks, "\n\n").alias(name))


def layer_texts(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """The rows of ``_layer_texts`` with whole texts."""
    return _layer_texts(g, only)[0]


def _layer_texts(g: GraphTables, only: DataFrame | None = None, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, section, k1, k2, k3, k4, k5, layer_type, label, content, tagged): every layer's text, its label, and its
    tagged form. Sections: 0 global, 1 hierarchy, 2 own, 3 aspects, 4 relations, 5 flows; within one by k1 to k5. The
    mapping is a row of section 2 with the type 'mapping', which is shown but not counted.

    ``apart``: the texts of relations' targets are left out of content and tagged form, and rows have besides ``of``, the target; ``after``,
    what follows the text in the tagged form; and ``more``, the text's units. The second result is (node, body, more), the texts themselves.
    """
    a = Assembly(g, only)
    order = written(implies_order(g, a.closure))
    files = configured(g)
    every = _texts(files, "node", F.col("alpha"), "all")
    flagged = _texts(files.where("included"), "node", F.col("ord"), "flagged")
    texts = every.join(dealt(flagged), "node", "left")
    if apart:
        texts = written(texts.withColumn("body", rtrim(F.coalesce("flagged", "all", F.lit("")))))
    texts = dealt(texts)
    bodies = texts.select("node", "body", units("body").alias("more")).where("more > 0") if apart else texts
    no_path = F.array().cast("array<long>")

    def row(df, section, kind, label, content, tagged, k1=None, k2=None, k3=None, k4=None, k5=None, of=None):
        own = (F.lit(None).cast("string").alias("of"), F.lit("").alias("after"), F.lit(0).cast("long").alias("more")) if of is None else of
        key = lambda c, none, name: (F.lit(none) if c is None else c).alias(name)
        return df.select("node", F.lit(section).alias("section"), key(k1, 0, "k1").cast("long").alias("k1"), key(k2, 0, "k2").cast("long").alias("k2"), key(k3, "", "k3"), key(k4, 0, "k4").cast("long").alias("k4"), (no_path if k5 is None else k5).alias("k5"), F.lit(kind).alias("layer_type"), label.alias("label"), content.alias("content"), tagged.alias("tagged"), *(own if apart else ()))

    attr = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), escape(c), F.lit('"')), F.lit(""))
    wrap = lambda tag, attrs, content: F.concat(F.lit(f"<{tag}"), *attrs, F.lit(">\n"), content, F.lit(f"\n</{tag}>"))
    own_ids = dealt(listed(expanded(g.node_aspects.select(F.col("path").alias("owner"), "aspect", F.col("ord").cast("long").alias("at")), order, ["owner"]), ["owner"]))

    head = F.lit(f"**Project:** {g.settings.name}\n")
    out = row(a.ids, 0, "global", F.lit("Global Context"), head, wrap("global", [], head))

    up = a.here(a.above).join(texts.select(F.col("node").alias("ancestor"), "all"), "ancestor", "left").join(own_ids.withColumnRenamed("owner", "ancestor"), "ancestor", "left")
    content = F.coalesce("all", F.lit(""))
    path = F.when(F.col("ancestor") != "", F.col("ancestor"))
    out = out.unionAll(row(up, 1, "hierarchy", F.concat(F.lit("Module Context ("), "ancestor", F.lit("/)")), content, wrap("hierarchy", [attr("path", path), attr("aspects", F.col("aspects"))], content), k1=-F.col("distance")))

    mine = a.nodes.withColumnRenamed("path", "node").join(texts, "node", "left").join(own_ids.withColumnRenamed("owner", "node"), "node", "left")
    content = F.concat_ws("\n\n", F.concat(F.lit(f"### {NODE_FILE}\n"), trim("yaml_raw")), "all")
    out = out.unionAll(row(mine, 2, "own", F.concat(F.lit("Node: "), "name"), content, wrap("own-artifacts", [attr("aspects", F.col("aspects"))], content)))
    paths = a.here(g.mappings.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "mapping"))), lambda x: x["mapping"]), ", ").alias("paths")))
    out = out.unionAll(row(paths, 2, "mapping", F.lit("Materialization Target"), F.col("paths"), F.concat(F.lit('<materialization-target paths="'), escape("paths"), F.lit('" />')), k2=F.lit(1)))

    rel = a.relations().withColumn("node", F.col("src"))
    text = bodies.select(F.col("node").alias("dst"), "more") if apart else texts.select(F.col("node").alias("dst"), "all", "flagged")
    one = rel.where(F.col("type").isin(STRUCTURAL)).join(dealt(text), "dst", "left")
    content = F.when(F.col("more") > 0, _preamble()).otherwise(rtrim(_preamble())) if apart else rtrim(F.concat(_preamble(), F.coalesce("flagged", "all", F.lit(""))))
    fails = F.when(F.col("failure") != "", F.col("failure"))
    attrs = [attr("target", F.col("dst")), attr("type", F.col("type")), attr("consumes", _joined("consumes")), attr("failure", fails)]
    label = F.concat(F.lit("Dependency: "), "dst_name", F.lit(" ("), "type", F.lit(") — "), "dst")
    if apart:
        of = (F.when(F.col("more") > 0, F.col("dst")).alias("of"), F.lit("\n</dependency>").alias("after"), F.coalesce("more", F.lit(0)).cast("long").alias("more"))
        out = out.unionAll(row(one, 4, "relational", label, content, F.concat(F.lit("<dependency"), *attrs, F.lit(">\n"), content), k1=F.col("ord"), of=of))
    else:
        out = out.unionAll(row(one, 4, "relational", label, content, wrap("dependency", attrs, content), k1=F.col("ord")))
    name, content = _event()
    attrs = [attr("target", F.col("dst")), attr("type", F.col("type")), attr("event-name", name), attr("consumes", _joined("consumes"))]
    out = out.unionAll(row(rel.where(F.col("type").isin(EVENT)), 4, "relational", F.concat(F.lit("Event: "), name, F.lit(" ["), "type", F.lit("]")), content, wrap("event", attrs, content), k1=F.col("ord")))

    flow_ids = listed(expanded(g.flow_aspects.select(F.col("flow").alias("owner"), "aspect", F.col("ord").cast("long").alias("at")), order, ["owner"]), ["owner"])
    flow_texts = _texts(g.flow_artifacts, "flow", F.collate(F.col("filename"), "UNICODE"), "all")
    one = a.here(a.member).join(g.flows.select("flow", "name"), "flow").join(flow_texts, "flow", "left").join(flow_ids.withColumnRenamed("owner", "flow"), "flow", "left")
    content = F.coalesce("all", F.lit(NO_FLOW_FILES))
    shown = trim("name")
    out = out.unionAll(row(one, 5, "flows", F.concat(F.lit("Flow: "), "name"), content, wrap("flow", [attr("name", shown), attr("aspects", F.col("aspects"))], content), k3=F.col("flow")))

    # Aspects in the order in which the layers before name them.
    at = lambda rank, depth, flow, ord_: F.struct(F.lit(rank).cast("long").alias("rank"), depth.cast("long").alias("depth"), flow.alias("flow"), ord_.cast("long").alias("ord")).alias("at")
    entries = g.node_aspects.select(F.col("path").alias("owner"), "aspect", "ord")
    seeds = entries.select(F.col("owner").alias("node"), "aspect", at(1, F.lit(0), F.lit(""), F.col("ord")))
    seeds = seeds.unionAll(a.above.join(dealt(entries.withColumnRenamed("owner", "ancestor")), "ancestor").select("node", "aspect", at(0, -F.col("distance"), F.lit(""), F.col("ord"))))
    seeds = seeds.unionAll(a.member.join(g.flow_aspects.select("flow", "aspect", "ord"), "flow").select("node", "aspect", at(2, F.lit(0), F.col("flow"), F.col("ord"))))
    rules = _texts(g.aspect_artifacts, "aspect", F.collate(F.col("filename"), "UNICODE"), "all")
    one = expanded(a.here(seeds), order, ["node"]).join(g.aspects.select(F.col("id").alias("aspect"), "name", "stability"), "aspect").join(rules, "aspect", "left").join(dealt(a.exceptions()), ["node", "aspect"], "left")
    tier = F.when(F.col("stability") != "", F.concat(F.lit(STABILITY), "stability"))
    content = F.concat(F.coalesce("all", F.lit("")), F.coalesce(tier, F.lit("")), F.coalesce(F.concat(F.lit(EXCEPTION), "note"), F.lit("")))
    attrs = [attr("name", F.col("name")), attr("id", F.col("aspect"))]
    k = F.col("key.at")
    return out.unionAll(row(one, 3, "aspects", F.concat("name", F.lit(" (aspect: "), "aspect", F.lit(")")), content, wrap("aspect", attrs, content), k["rank"], k["depth"], k["flow"], k["ord"], F.col("key.path"))), bodies


def _ordered(column: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("section", "k1", "k2", "k3", "k4", "k5", F.col(column).alias("x")))), lambda v: v["x"])


def _head(n_tokens):
    return F.concat(F.lit('<context-package node-path="'), escape("node"), F.lit('" node-name="'), escape("name"), F.lit('" token-count="'), n_tokens.cast("string"), F.lit('">\n\n'))


TAIL = "\n\n</context-package>"


def packages(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, name, tokens, status, text): the tagged text of each package; one row holds a whole package."""
    rows = written(layer_texts(g, only))
    size = rows.where("layer_type <> 'mapping'").groupBy("node").agg(tokens(F.sum(units("content")) + 2 * (F.count("*") - 1)).alias("tokens"))
    body = rows.groupBy("node").agg(F.array_join(_ordered("tagged"), "\n\n").alias("body"))
    both = body.join(dealt(size), "node").join(dealt(g.nodes.select(F.col("path").alias("node"), "name")), "node")
    return both.select("node", "name", "tokens", _status(g).alias("status"), F.concat(_head(F.col("tokens")), "body", F.lit(TAIL)).alias("text"))


def digests(g: GraphTables, only: DataFrame | None = None) -> DataFrame:
    """(node, tokens, status, digest): the SHA-256 of the texts of ``packages``, which are not put together.

    Nodes with near numbers (``bitmaps.numbered``) relate to much the same targets, so ALIKE of them are a group, and a target's text
    is sent once to a group for each place it has there. A task takes the pieces of a group in the order that all its packages have
    and adds each to the hashes of its nodes; it holds one text and the states of the hashes.
    """
    rows, bodies = _layer_texts(g, only, apart=True)
    rounds = Rounds(g.nodes.sparkSession, "digests")
    rows = rounds.write(rows.select("node", *_PLACE, "layer_type", (units("content") + F.col("more")).alias("units"), "tagged", "of", "after"))
    numbers = bitmaps.numbered(rounds, g.nodes.select(F.col("path").alias("name"), F.lit(0).alias("group")))
    numbers = dealt(numbers.select("id", F.floor(F.col("id") / ALIKE).alias("group"), F.col("name").alias("node")))
    size = rows.where("layer_type <> 'mapping'").groupBy("node").agg(tokens(F.sum("units") + 2 * (F.count("*") - 1)).alias("tokens"))
    size = rounds.write(size.join(numbers, "node").join(dealt(g.nodes.select(F.col("path").alias("node"), "name")), "node"))
    # A text comes before the pieces that it belongs to, which have the same place and start.
    start = F.when(F.col("of").isNull(), F.substring("tagged", 1, 8)).otherwise(F.concat(F.lit('<dependency target="'), escape("of"), F.lit('"'))).alias("start")
    pieces = rounds.write(rows.where("tagged is not null").join(numbers, "node").select("group", "id", *_PLACE, start, "tagged", "of", "after"))
    texts = pieces.where("of is not null").select("group", *_PLACE, "start", "of").distinct().join(bodies.select(F.col("node").alias("of"), "body"), "of")
    none = lambda t: F.lit(None).cast(t)
    first = [F.lit(-1), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(""), F.lit(0).cast("long"), F.array().cast("array<long>")]
    every = pieces.select("group", "id", *_PLACE, "start", F.lit(1).alias("kind"), "tagged", F.col("of").isNotNull().alias("has"), "after")
    every = every.unionAll(texts.select("group", none("long"), *_PLACE, "start", F.lit(0), "body", F.lit(False), F.lit("")))
    every = every.unionAll(size.select("group", "id", *first, F.lit(""), F.lit(1), _head(F.col("tokens")), F.lit(False), F.lit("")))
    every = every.repartition("group").sortWithinPartitions("group", *_PLACE, "start", "kind", "tagged")

    def run(batches):
        now, text, states = None, b"", {}

        def out():
            for _, state in states.values():
                state.update(TAIL.encode())
            yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int64()), pa.array([x.hexdigest() for _, x in states.values()], pa.string())], ["id", "digest"])
            states.clear()

        for b in batches:
            for group, id_, section, piece, has, after in zip(*(b[c].to_pylist() for c in ("group", "id", "section", "tagged", "has", "after"))):
                if group != now:
                    yield from out()
                    now = group
                if id_ is None:
                    text = piece
                elif section < 0:
                    states[id_] = [b"", hashlib.sha256(piece)]
                else:
                    state = states[id_]
                    state[1].update(state[0] + piece)
                    if has:
                        state[1].update(text)
                    state[1].update(after)
                    state[0] = b"\n\n"
        yield from out()

    found = every.select("group", "id", "section", F.col("tagged").cast("binary").alias("tagged"), "has", F.col("after").cast("binary").alias("after")).mapInArrow(run, "id long, digest string")
    return size.join(dealt(found), "id").select("node", "tokens", _status(g).alias("status"), "digest")


def markdown(g: GraphTables, node: str, generated: str) -> str:
    """A package as Markdown; ``generated`` is the time shown in its head."""
    rows = layer_texts(g, g.nodes.where(F.col("path") == node).select(F.col("path").alias("node"))).collect()
    if not rows:
        raise ValueError(f"no context package for {node}")
    rows.sort(key=lambda r: (r.section, r.k1, r.k2, r.k3, r.k4, list(r.k5)))
    counted = [r for r in rows if r.layer_type != "mapping"]
    size = -(-(sum(len(r.content.encode("utf-16-le")) // 2 for r in counted) + 2 * (len(counted) - 1)) // 4)
    name = next(r.label for r in rows if r.layer_type == "own").removeprefix("Node: ")
    out = f"# Context Package: {name}\n# Path: {node}\n# Generated: {generated}\n\n---\n\n"
    for title, some in (("Global", (0,)), ("Hierarchy", (1,)), ("OwnArtifacts", (2,)), ("Aspects", (3,)), ("Relational", (4, 5))):
        here = [r for r in rows if r.section in some]
        if here:
            out += f"## {title}\n\n" + "".join(f"### {r.label}\n\n{r.content}\n\n" for r in here) + "---\n\n"
    internal = sorted(counted, key=lambda r: {0: 0, 1: 1, 2: 2, 4: 3, 5: 4, 3: 5}[r.section])
    return out + f"Context size: {size:,} tokens\nLayers: {', '.join(r.layer_type for r in internal)}\n"


