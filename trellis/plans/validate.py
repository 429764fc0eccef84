"""Every integrity rule as rows of one table: (severity, code, rule, message, node); ``node`` is null for rules of no node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import thousands
from ..operators import context, cycles, drift, rules
from ..sources import project
from ..sources.tables import GraphTables
from ..sources.tree import tree

SCHEMA = "severity string, code string, rule string, message string, node string"
# Rule names by code.
RULES = {
    "E001": "invalid-node-yaml", "E002": "unknown-node-type", "E003": "unknown-aspect", "E004": "broken-relation", "E006": "broken-flow-ref", "E007": "broken-aspect-ref",
    "E009": "overlapping-mapping", "E010": "structural-cycle", "E012": "invalid-config", "E013": "invalid-artifact-condition", "E014": "duplicate-aspect-binding", "E015": "missing-node-yaml",
    "E016": "implied-aspect-missing", "E017": "aspect-implies-cycle", "W001": "missing-artifact", "W002": "shallow-artifact", "W005": "budget-warning", "W006": "budget-error", "W007": "high-fan-out",
    "W009": "unpaired-event", "W010": "missing-schema", "W011": "missing-required-aspect-coverage", "W012": "mapping-path-missing", "W013": "directory-without-node", "W014": "anchor-not-found",
}


def _say(text: str, **columns: Column | str) -> Column:
    """A message from a text with {names} for columns."""
    parts, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(columns.get(name, F.col(name)).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _rows(df: DataFrame, code: str, message: Column, node: str | None = None) -> DataFrame:
    severity = "error" if code.startswith("E") else "warning"
    at = F.col(node) if node else F.lit(None)
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(RULES[code]).alias("rule"), message.alias("message"), at.cast("string").alias("node"))


def issues(spark: SparkSession, g: GraphTables, files: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The rows of all rules. ``files`` (path) of the project for mappings, ``texts`` (node, content) for anchors; without them
    these two rules have no rows. A configuration that could not be read leaves out the rules that hang on it."""
    s, out = g.settings, []
    flow_name = lambda df: df.join(g.flows.select("flow", "name"), "flow")
    name_of = g.aspects.select(F.col("id").alias("aspect"), "name")
    if g.config_error:
        out.append(spark.createDataFrame([("error", "E012", RULES["E012"], g.config_error, None)], SCHEMA))
    out.append(_rows(g.node_errors, "E001", F.col("error"), "path"))
    if not g.config_error:
        types = [r[0] for r in g.node_types.collect()]
        conditions = g.artifact_types.select(F.col("filename").alias("artifact"), F.col("when").alias("condition"))
        missing = rules.missing_artifact(g).join(rules.first_sources(g), "node", "left").join(g.artifact_types.select(F.col("filename").alias("artifact"), "description"), "artifact")
        reason = F.when(F.col("reason_kind") == "always", "required: always").when(F.col("reason_kind") == "incoming", _say("{n} incoming relation(s)")).when(F.col("reason_kind") == "outgoing", _say("{n} outgoing relation(s)")).otherwise("node has the aspect asked for")
        near = F.when(F.col("n_sources") > 0, _say(" Node has {n_sources} incoming relation(s): {sources}{more}.", more=F.when(F.col("n_sources") > 5, "...")))
        tokens = context.budget(g).join(g.nodes.where("not blackbox").select(F.col("path").alias("node")), "node", "left_semi")
        shown = F.format_number("tokens", 0)
        out += [
            _rows(rules.unknown_type(g, types), "E002", _say(f"Node type '{{type}}' not in config.node_types ({', '.join(types)})"), "node"),
            _rows(rules.unknown_aspect(g, g.aspects), "E003", _say("Aspect '{aspect}' has no corresponding directory in aspects/"), "node"),
            _rows(rules.duplicate_aspect(g.aspects), "E014", _say("Aspect '{id}' is bound to {n} aspects")),
            _rows(rules.implied_missing(g, g.aspects).join(name_of, "aspect"), "E016", _say("Aspect '{name}' implies '{implied}' but no aspect with that id exists in aspects/")),
            _rows(cycles.components(g.implies.select(F.col("id").alias("src"), F.col("implied").alias("dst")), None, " → "), "E017", _say("Aspect implies cycle: {path}")),
            _rows(rules.required_aspect(g).join(g.nodes.select(F.col("path").alias("node"), "type"), "node"), "W011", _say("Node '{node}' (type: {type}) missing required aspect coverage for '{aspect}'"), "node"),
            _rows(missing, "W001", F.rtrim(F.concat(_say("Missing required artifact '{artifact}' ({reason}).", reason=reason), F.coalesce(near, F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))), "node"),
            _rows(rules.bad_condition(conditions, g.aspects), "E013", _say("Artifact '{artifact}' condition has_aspect:{aspect} has no corresponding aspect in aspects/")),
            _rows(tokens.where("status = 'error'"), "W006", _say(f"Context is {{t}} tokens (error threshold: {thousands(s.error)}) — node must be split", t=shown), "node"),
            _rows(tokens.where("status = 'warning'"), "W005", _say(f"Context is {{t}} tokens (warning threshold: {thousands(s.warning)}). Consider splitting the node or reducing dependencies.", t=shown), "node"),
            _rows(rules.fan_out(g), "W007", _say(f"Node has {{n}} direct relations (max: {s.max_direct_relations})"), "node"),
        ]
        if texts is not None:
            out.append(_rows(rules.anchor_not_found(g, texts), "W014", _say("Anchor '{anchor}' for aspect '{aspect}' not found in mapped source files"), "node"))
    broken = rules.broken_relation(g, g.nodes)
    hints = broken.join(rules.siblings(broken, g.nodes), "target", "left")
    parent = F.regexp_replace("target", "[^/]*$", "")
    known = F.when(F.col("siblings") != "", _say("\n     Existing nodes in {p}: {siblings}", p=F.when(parent == "", "model/").otherwise(parent)))
    guess = F.when(F.col("suggestion").isNotNull(), _say("\n     Did you mean '{suggestion}'?"))
    unpaired = F.when(F.col("direction") == "emits", _say("Node '{node}' emits to '{other}' but '{other}' has no listens from '{node}'")).otherwise(_say("Node '{node}' listens from '{other}' but '{other}' has no emits to '{node}'"))
    dirs = g.without_node
    out += [
        _rows(rules.missing_schema(g.schemas), "W010", _say("Schema 'yg-{schema}.yaml' missing from schemas/")),
        _rows(hints, "E004", F.concat(_say("Relation target '{target}' does not exist"), F.coalesce(known, F.lit("")), F.coalesce(guess, F.lit(""))), "node"),
        _rows(cycles.components(rules.untolerated(g)), "E010", _say("Circular dependency: {path}")),
        _rows(rules.overlapping(g.mappings), "E009", _say("Mapping paths '{mapping_a}' and '{mapping_b}' overlap. Keep one owner mapping and model other concerns via relations."), "blamed"),
        _rows(flow_name(rules.broken_flow_ref(g, g.nodes)), "E006", _say("Flow '{name}' references non-existent node '{node}'")),
        _rows(flow_name(rules.broken_flow_aspect(g, g.aspects)), "E007", _say("Flow '{name}' references aspect '{aspect}' but no aspect with that id exists in aspects/")),
        _rows(dirs.where("code = 'E015'"), "E015", _say("Directory '{dir}' has files but no yg-node.yaml"), "dir"),
        _rows(dirs.where("code = 'W013'"), "W013", _say("Directory '{dir}' has subdirectories but no yg-node.yaml — consider creating a node"), "dir"),
        _rows(rules.shallow(g), "W002", _say(f"Artifact '{{artifact}}' is below minimum length ({{n}} < {s.min_artifact_length})"), "node"),
        _rows(rules.unpaired_event(g), "W009", unpaired, "node"),
    ]
    if files is not None:
        there = rules.mapping_missing(g.mappings.select("node", F.regexp_replace(F.trim("mapping"), "/+$", "").alias("mapping")), files.select(F.col("path").alias("file")))
        out.append(_rows(there, "W012", _say("Mapping path '{mapping}' does not exist on disk"), "node"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole


def of_scope(g: GraphTables, found: DataFrame, scope: str) -> tuple[DataFrame, int]:
    """Issues of a node and those below it, and of no node; and how many nodes that is. A scope that is no node gives one
    error: of itself or of the node above it that could not be read, or that there is none."""
    nodes = g.nodes.where(F.col("path").startswith(scope + "/") | (F.col("path") == scope))
    if not g.nodes.where(F.col("path") == scope).isEmpty():
        return found.where((F.col("node") == scope) | F.col("node").startswith(scope + "/") | F.col("node").isNull()), nodes.count()
    spark = g.nodes.sparkSession
    bad = g.node_errors.where((F.col("path") == scope) | F.lit(scope).startswith(F.concat("path", F.lit("/")))).orderBy("path").first()
    row = ("error", "E001", RULES["E001"], bad["error"], bad["path"]) if bad else ("error", None, "invalid-scope", f"Node not found: {scope}", None)
    return spark.createDataFrame([row], SCHEMA), 0


def of_project(spark: SparkSession, g: GraphTables, root: str) -> DataFrame:
    """``issues`` with the files of the project at ``root``."""
    there = drift.written(tree(spark, root))
    files = there.where("not folder").select("path")
    return issues(spark, g, there.select("path"), project.anchor_texts(spark, root, files, g.mappings))


class Drift:
    """Current and stored files of a project's mapped nodes."""

    def __init__(self, spark: SparkSession, g: GraphTables, root: str, prefix: str):
        self.spark, self.g, self.prefix = spark, g, prefix
        entries = drift.written(tree(spark, root))
        listed = entries.where("not folder").select("path", "mtime", "size")
        self.mapped = g.mappings.where(F.trim("mapping") != "").select("node").distinct()
        self.state = drift.written(project.read_state(spark, f"{root}/{prefix}"))
        stored = self.state.select("node", F.explode_outer("files").alias("path", "hash"), "mtimes").where("path is not null")
        self.stored = stored.select("node", "path", "hash", drift.category("path", prefix).alias("category"), F.element_at("mtimes", F.col("path")).alias("mtime"))
        wanted = drift.tracked(g, prefix).join(self.mapped, "node", "left_semi")
        files = project.expand(spark, root, listed, wanted).select("node", "path").distinct()
        files = drift.without_lower(files, drift.exclusions(g)).join(listed.select("path", "mtime"), "path")
        hashes = project.hash_files(spark, root, files, self.stored)
        self.current = drift.written(files.select("node", "path").join(hashes, "path").select("node", "path", "hash", "mtime", drift.category("path", prefix).alias("category")))
        self.there = g.mappings.select("node", F.trim("mapping").alias("m")).join(entries.select(F.col("path").alias("m")), "m").select("node")
        self.digests = drift.written(drift.digest(self.current).withColumnRenamed("digest", "hash"))

    def changes(self) -> DataFrame:
        return drift.file_changes(self.stored.join(self.mapped, "node", "left_semi"), self.current)

    def report(self, scope: str = "all") -> DataFrame:
        """(node, status, details); ValueError if the scope is no node, or neither it nor a node below is mapped."""
        out = drift.classify(self.mapped, self.state, self.there, self.digests, self.changes().join(self.state.select("node"), "node", "left_semi"))
        if scope == "all":
            return out
        here = (F.col("node") == scope) | F.col("node").startswith(scope + "/")
        if self.g.nodes.where(F.col("path") == scope).isEmpty():
            raise ValueError(f"node not found: {scope}")
        if self.mapped.where(here).isEmpty():
            raise ValueError(f"node has no mapping: {scope}")
        return out.where(here)

    def sync(self, node: str | None = None, recursive: bool = False) -> list[tuple[str, str | None, str]]:
        """Stores the current files of a node, with ``recursive`` those below it, or of all mapped nodes and then drops
        the state of others; (node, previous hash, current hash) in byte order."""
        some = self.mapped
        if node is not None:
            if self.g.nodes.where(F.col("path") == node).isEmpty():
                raise ValueError(f"node not found: {node}")
            here = F.col("node") == node
            some = self.mapped.where(here | F.col("node").startswith(node + "/") if recursive else here)
            if not recursive and some.isEmpty():
                raise ValueError(f"node has no mapping: {node}")
        maps = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", c))))
        rows = self.current.join(some, "node", "left_semi").groupBy("node").agg(maps("hash").alias("files"), maps("mtime").alias("mtimes"))
        empty = drift.F.sha2(F.lit(""), 256)
        new = some.join(rows, "node", "left").join(self.digests, "node", "left").select("node", F.coalesce("hash", empty).alias("hash"), F.coalesce("files", F.create_map().cast("map<string,string>")).alias("files"), F.coalesce("mtimes", F.create_map().cast("map<string,double>")).alias("mtimes"))
        new = drift.written(new)
        project.write_state(new, self.g.root)
        if node is None:
            project.collect_garbage(self.spark, self.g.root, some)
        both = new.select("node", "hash").join(self.state.select("node", F.col("hash").alias("was")), "node", "left").orderBy("node")
        return [(r.node, r.was, r.hash) for r in both.collect()]
