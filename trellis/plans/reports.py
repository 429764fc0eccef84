"""Reports as texts: the small results of operators, rendered by the driver. The words and signs of lines are fixed values."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import node_path, pluralize, project_path, rounded, short_hash
from ..operators import aspects, closure, context, drift, impact, rules
from ..sources import directory, project
from ..sources.tables import GraphTables
from ..sources.tree import tree
from . import validate


def _locale(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.collate(F.col(column), "UNICODE"))


def _or_none(names) -> str:
    return ", ".join(names) or "(none)"


def _boxes(rows: list[tuple[int, str]]) -> str:
    """Lines of a tree from (depth, text) in pre-order, the first level at depth 1."""
    out = []
    for k, (depth, text) in enumerate(rows):
        def last(at: int) -> bool:
            for d, _ in rows[k + 1 :]:  # noqa: B023
                if d <= at:
                    return d < at
            return True
        out.append("".join("    " if last(d) else "│   " for d in range(1, depth)) + ("└── " if last(depth) else "├── ") + text)
    return "\n".join(out)


class Project:
    """A project at ``root`` whose graph is its directory ``graph``."""

    def __init__(self, spark: SparkSession, root: str, graph: str, tolerate_invalid_config: bool = False):
        self.spark, self.root, self.graph = spark, root.rstrip("/"), graph
        self.g: GraphTables = directory.load(spark, f"{self.root}/{graph}", tolerate_invalid_config)

    def _known(self, node: str) -> str:
        node = node_path(node)
        if self.g.nodes.where(F.col("path") == node).isEmpty():
            raise ValueError(f"node not found: {node}")
        return node

    def drift(self) -> validate.Drift:
        return validate.Drift(self.spark, self.g, self.root, self.graph)

    def issues(self) -> DataFrame:
        return closure.written(validate.of_project(self.spark, self.g, self.root))

    def build_context(self, node: str) -> str:
        """The tagged package of a node and its budget status. ValueError if errors bear on it."""
        node = node_path(node)
        found = self.issues()
        blocking = rules.relevant(self.g, found, node).collect()
        if blocking:
            others = found.where("severity = 'error'").count() - len(blocking)
            lines = [f"  {r.code or ''} {r.node + ': ' if r.node else ''}{r.message}" for r in blocking]
            raise ValueError(f"blocked by {len(blocking)} error(s) affecting this node's context ({others} in other nodes ignored)\n" + "\n".join(lines))
        (r,) = context.packages(self.g, self.spark.createDataFrame([(self._known(node),)], "node string")).collect()
        return f"{r.text}Budget status: {r.status}\n"

    def validate(self, scope: str = "all") -> tuple[str, bool]:
        """The report and whether there is no error."""
        found, scope = self.issues(), node_path(scope)
        found, n = (found, self.g.nodes.count()) if scope == "all" else validate.of_scope(self.g, found, scope)
        rows = found.orderBy("severity", "code", F.col("node").asc_nulls_first(), "message").collect()
        out = [f"{n} nodes scanned", ""]
        for r in rows:
            out.append(("✗" if r.severity == "error" else "⚠") + f" {r.code or ''} " + (f"{r.node} -> " if r.node else "") + r.message)
        errors = sum(r.severity == "error" for r in rows)
        out += ["", f"{errors} errors, {len(rows) - errors} warnings."] if rows else ["✓ No issues found."]
        return "\n".join(out) + "\n", not errors

    def drift_report(self, scope: str = "all", drifted_only: bool = False, limit: int | None = None) -> tuple[str, bool]:
        d = self.drift()
        rows = d.report(node_path(scope)).orderBy(F.translate("node", "/", "\x01")).collect()
        changed = defaultdict(list)
        for r in d.changes().orderBy(F.col("change") == "deleted", "path").collect():
            changed[r.node, r.category].append(r.path + (" (deleted)" if r.change == "deleted" else ""))
        label = {"ok": "[ok]", "missing": "[missing]", "unmaterialized": "[unmat.]"}
        out = []
        for title, section, apart in (("Source drift:", "source", {"graph-drift"}), ("\nGraph drift:", "graph", {"source-drift", "missing", "unmaterialized"})):
            here = [r for r in rows if r.status not in apart and not (drifted_only and r.status == "ok")]
            out += [title] + ([] if here else ["  (none)"])
            for r in here[:limit]:
                out.append(f"  {label.get(r.status, '[drift]'):13}{r.node}")
                out += [f"{'':15}{p}  (changed)" for p in changed[r.node, section]] if r.status.endswith("drift") and r.details.startswith("Changed") else []
            if limit is not None and len(here) > limit:
                out.append(f"  ... {len(here) - limit} more ({len(here)} total)")
        n = lambda s: sum(r.status == s for r in rows)
        summary = "\nSummary: " + ", ".join(f"{n(s)} {s}" for s in ("source-drift", "graph-drift", "full-drift", "missing", "unmaterialized"))
        out.append(summary + (f" ({n('ok')} ok hidden)" if drifted_only and n("ok") else f", {n('ok')} ok"))
        return "\n".join(out) + "\n", n("ok") == len(rows)

    def sync(self, node: str | None = None, recursive: bool = False) -> str:
        done = self.drift().sync(None if node is None else node_path(node), recursive)
        return "".join(f"Synchronized: {n}\n  Hash: {short_hash(was)} -> {short_hash(now)}\n" for n, was, now in done)

    def status(self) -> str:
        g, d = self.g, {r.status: r["count"] for r in self.drift().report().groupBy("status").count().collect()}
        severity = {r.severity: r["count"] for r in self.issues().groupBy("severity").count().collect()}
        types = g.nodes.groupBy("type").agg(F.count("*").alias("n"), F.min(F.translate("path", "/", "\x01")).alias("k")).orderBy("k").collect()
        n = sum(t.n for t in types)
        boxed = g.nodes.where("blackbox").count()
        structural = closure.structural(g.relations).count()
        event = g.relations.count() - structural
        most = g.relations.groupBy("src").count().orderBy(F.desc("count"), F.translate("src", "/", "\x01")).first()
        kinds = g.artifact_types.count()
        filled = context.configured(g).count()
        mapped = g.mappings.where(F.trim("mapping") != "").select("node").distinct().count()
        covered = aspects.effective(g).select("node").distinct().count()
        percent = rounded(100 * filled / (n * kinds)) if n * kinds else "0"
        return "\n".join([
            f"Graph: {g.settings.name}", f"Nodes: {n} ({', '.join(f'{t.n} {pluralize(t.type, t.n)}' for t in types)}) + {boxed} blackbox", f"Relations: {structural} structural, {event} event",
            f"Aspects: {g.aspects.count()}    Flows: {g.flows.count()}",
            "Drift: " + ", ".join(f"{d.get(s, 0)} {s}" for s in ("source-drift", "graph-drift", "full-drift", "missing", "unmaterialized", "ok")),
            f"Validation: {severity.get('error', 0)} errors, {severity.get('warning', 0)} warnings", "", "Quality:",
            f"  Artifacts: {filled}/{n * kinds} slots filled ({percent}%) — {kinds} types × {n} nodes",
            f"  Relations: avg {rounded((structural + event) / n, 1) if n else '0'}/node, max {most['count'] if most else 0}" + (f" ({most.src})" if most else ""),
            f"  Mapping: {mapped}/{n} nodes mapped to source", f"  Aspects: {covered}/{n} nodes have aspect coverage",
        ]) + "\n"

    def preflight(self, quick: bool = False) -> tuple[str, bool]:
        """The report and whether there is neither drift (unless ``quick``) nor an error."""
        g = self.g
        off = [] if quick else self.drift().report().where("status <> 'ok'").orderBy(F.translate("node", "/", "\x01")).collect()
        out = ["=== Preflight Report ===", "", "Drift:      skipped (--quick)" if quick else f"Drift:      {len(off)} nodes need attention" if off else "Drift:      clean"]
        out += [f"            - {r.node}: {r.status}" for r in off]
        out += ["", f"Status:     {g.nodes.count()} nodes, {g.aspects.count()} aspects, {g.flows.count()} flows, {g.mappings.where(F.trim('mapping') != '').count()} mapped paths", ""]
        found = self.issues().orderBy("severity", "code", F.col("node").asc_nulls_first(), "message").collect()
        errors = sum(r.severity == "error" for r in found)
        parts = [f"{k} {w}" for k, w in ((errors, "errors"), (len(found) - errors, "warnings")) if k]
        out.append("Validation: " + (", ".join(parts) or "clean"))
        out += ["            - " + (f"[{r.code}] " if r.code else "") + (f"{r.node} -> " if r.node else "") + r.message for r in found]
        return "\n".join(out) + "\n", not off and not errors

    def deps(self, node: str, depth: int | None = None, which: str = "all") -> str:
        node = self._known(node)
        rows = closure.dependency_tree(self.g.nodes, self.g.relations, node, which, depth).orderBy("ords").collect()
        body = _boxes([(len(r.ords), f"{r.type} {r.node}" + (" ■ blackbox" if r.blackbox else "")) for r in rows])
        return "\n".join(x for x in (node, body) if x) + "\n"

    def tree(self, root: str | None = None, depth: int | None = None) -> str:
        """Nodes in pre-order, siblings in locale order, to a depth below the roots shown."""
        g, root = self.g, None if root is None else self._known(root)
        own = g.node_aspects.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "aspect"))), lambda x: x["aspect"]), ",").alias("ids"))
        count = g.relations.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n"))
        rows = g.nodes.select("path", "type", "blackbox", "depth").join(own, "path", "left").join(count, "path", "left")
        if root is not None:
            rows = rows.where((F.col("path") == root) | F.col("path").startswith(root + "/"))
        below = 0 if root is None or root == "" else root.count("/")
        if depth is not None:
            rows = rows.where(F.col("depth") - below <= depth)
        # Locale order decides between siblings; '/' sorts before all that a name may hold.
        named = {r.path: r for r in _locale(rows, "path").collect()}
        order = {p: k for k, p in enumerate(named)}
        key = lambda p: [order.get("/".join(p.split("/")[: i + 1]), -1) for i in range(p.count("/") + 1)]
        lines = []
        for p in sorted(named, key=key):
            r = named[p]
            lines.append((p.count("/") + 1 - below, f"{p.rpartition('/')[2]}/ [{r.type}]" + (f" aspects:{r.ids}" if r.ids else "") + (" ■ blackbox" if r.blackbox else "") + f" -> {r.n or 0} relations"))
        return ("" if root is not None else "model/\n") + _boxes(lines) + "\n"

    def owner(self, path: str) -> str:
        file = project_path("/", path).rstrip("/")
        g = self.g
        from dataclasses import replace

        r = drift.owners(replace(g, files=self.spark.createDataFrame([(file,)], "file string"))).first()
        if r is None:
            there = not tree(self.spark, self.root, [file]).isEmpty()
            return f"{file} -> no graph coverage{'' if there else ' (file not found)'}\n"
        note = "" if r.direct else f"  The file has no mapping of its own; its context comes from the directory {r.mapping} above it.\n"
        return f"{file} -> {r.node}\n{note}"

    def impact_node(self, node: str, method: str | None = None, simulate: bool = False) -> str:
        g, node = self.g, self._known(node)
        edges = closure.structural(g.relations)
        at = self.spark.createDataFrame([(node,)], "target string")
        direct = [r for r in impact.direct(g).where(F.col("target") == node).orderBy("dependent").collect()]
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        everyone = {r.node for r in closure.reach(back, roots=at.select(F.col("target").alias("root"))).where("root <> node").collect()}
        chains = [r.chain for r in impact.chains(edges, at).orderBy("chain").collect()]
        if method:
            direct = [r for r in direct if not r.consumes or method in r.consumes.split(",")]
            everyone, chains = {r.dependent for r in direct}, []
        events = [] if method else impact.events(g).where(F.col("target") == node).orderBy(F.collate(F.col("node"), "UNICODE"), "type", "event").collect()
        joined = impact.events(g).where(F.col("target") == node).select("node").distinct().collect() if method else events
        below = [r.node for r in aspects.above(g).where(F.col("ancestor") == node).orderBy("node").collect()]
        flows = [r.name for r in g.flow_nodes.where(F.col("node") == node).select("flow").distinct().join(g.flows, "flow").orderBy("flow").collect()]
        scope = aspects.effective(g)
        mine = scope.where(F.col("node") == node).select(F.col("aspect").alias("id")).join(g.aspects.select("id", "name"), "id").orderBy(F.translate("id", "/", "\x01")).collect()
        shared = _locale(impact.co_aspect(scope, node), "b").collect()
        out = [f"Impact of changes in {node}{f' (method: {method})' if method else ''}:", "", "Directly dependent:"]
        out += [f"  <- {r.dependent} ({r.type}" + (f", consumes: {r.consumes.replace(',', ', ')}" if r.consumes else "") + ")" for r in direct] or ["  (none)"]
        if events:
            out += ["", "Event-connected:"] + [f"  {r.node} ({r.type}: {r.event})" for r in events]
        out += ["", "Transitively dependent:"] + ([f"  {c}" for c in chains] or ["  (none)"])
        if below:
            out += ["", "Descendants (hierarchy impact):"] + [f"  {p}" for p in below]
        out += ["", f"Flows: {_or_none(flows)}", f"Aspects (scope covers node): {_or_none(r.name for r in mine)}"]
        if shared:
            out += ["Nodes sharing aspects:"] + [f"  {r.b} ({r.shared})" for r in shared]
        touched = everyone | set(below) | {r.node for r in joined}
        out += ["", f"Total scope: {len(touched)} nodes, {len(flows)} flows, {len(mine)} aspects"]
        return "\n".join(out) + "\n" + (self.simulation(sorted(touched), node) if simulate and touched else "")

    def impact_aspect(self, aspect: str, simulate: bool = False) -> str:
        g = self.g
        if g.aspects.where(F.col("id") == aspect).isEmpty():
            raise ValueError(f"aspect not found: {aspect}")
        names = {r.flow: r.name for r in g.flows.collect()}
        said = lambda s: "hierarchy from " + s[10:] if s.startswith("hierarchy ") else "flow: " + names[s[5:]] if s.startswith("flow ") else s
        rows = _locale(aspects.provenance(g).where(F.col("aspect") == aspect).join(g.nodes.select(F.col("path").alias("node")), "node", "left_semi"), "node").collect()
        flows = [names[r.flow] for r in g.flow_aspects.where(F.col("aspect") == aspect).select("flow").distinct().orderBy("flow").collect()]
        by = [r.id for r in g.implies.where(F.col("implied") == aspect).select("id").distinct().orderBy(F.translate("id", "/", "\x01")).collect()]
        to = [r.implied for r in g.implies.where(F.col("id") == aspect).orderBy("ord").collect()]
        out = [f"Impact of changes in aspect {aspect}:", "", f"Affected nodes ({len(rows)}):"] + ([f"  {r.node} ({said(r.source)})" for r in rows] or ["  (none)"])
        out += ["", f"Flows propagating this aspect: {_or_none(flows)}", f"Implied by: {_or_none(by)}", f"Implies: {_or_none(to)}", "", f"Total scope: {len(rows)} nodes, {len(flows)} flows"]
        return "\n".join(out) + "\n" + (self.simulation([r.node for r in rows]) if simulate and rows else "")

    def impact_flow(self, flow: str, simulate: bool = False) -> str:
        """A flow by its name or its directory."""
        g = self.g
        found = g.flows.where((F.col("name") == flow) | (F.col("flow") == flow)).orderBy("flow").first()
        if found is None:
            raise ValueError(f"flow not found: {flow}")
        rows = impact.flow_scope(g).where(F.col("flow") == found.flow).orderBy("node").collect()
        ids = [r.aspect for r in g.flow_aspects.where(F.col("flow") == found.flow).orderBy("ord").collect()]
        out = [f"Impact of changes in flow {found.name}:", "", "Participants:"] + ([f"  {r.node}{'' if r.declared else ' (descendant)'}" for r in rows] or ["  (none)"])
        out += ["", f"Flow aspects: {_or_none(ids)}", "", f"Total scope: {len(rows)} nodes"]
        return "\n".join(out) + "\n" + (self.simulation([r.node for r in rows]) if simulate and rows else "")

    def simulation(self, nodes: list[str], target: str | None = None, ref: str = "HEAD") -> str:
        """Package sizes now and at a commit, changed dependencies and drift of the nodes given."""
        some = self.spark.createDataFrame([(n,) for n in nodes], "node string")
        now = {r.node: r for r in context.budget(self.g, some).collect()}
        then_graph = project.at_ref(self.spark, self.root, self.graph, ref)
        then = {r.node: r.tokens for r in context.budget(then_graph, some).collect()} if then_graph else {}
        state = {r.node: r for r in self.drift().report().join(some, "node", "left_semi").collect()}
        uses = {r.src for r in closure.structural(self.g.relations).where(F.col("dst") == target).select("src").distinct().collect()} if target else set()
        out = ["", "Changes in context packages:", ""]
        for n in nodes:
            if n not in now:
                out += [f"{n}:", "  failed to build context", ""]
                continue
            out += [f"{n}:"] + ([f"  + Changed dependency interface: {target}"] if n in uses else [])
            out.append(f"  Budget: {f'{then[n]} -> ' if n in then else ''}{now[n].tokens} tokens ({now[n].status})")
            if n in state:
                out.append(f"  Mapped files (on-disk): {state[n].status}" + (f" ({state[n].details})" if state[n].details else ""))
            out.append("")
        return "\n".join(out) + "\n"

    def aspects_yaml(self) -> str:
        implied = defaultdict(list)
        for r in self.g.implies.orderBy("id", "ord").collect():
            implied[r.id].append(r.implied)
        rows = []
        for r in _locale(self.g.aspects, "id").collect():
            rows.append({k: v for k, v in (("id", r.id), ("name", r.name), ("description", r.description), ("implies", implied[r.id]), ("stability", r.stability)) if v})
        return directory.yaml.safe_dump(rows, sort_keys=False, allow_unicode=True)

    def flows_yaml(self) -> str:
        nodes, ids = defaultdict(list), defaultdict(list)
        for r in self.g.flow_nodes.orderBy("flow", "node").collect():
            nodes[r.flow].append(r.node)
        for r in self.g.flow_aspects.orderBy("flow", "ord").collect():
            ids[r.flow].append(r.aspect)
        rows = [{"name": r.name, "participants": len(nodes[r.flow]), "nodes": nodes[r.flow]} | ({"aspects": ids[r.flow]} if ids[r.flow] else {}) for r in _locale(self.g.flows, "name").collect()]
        return directory.yaml.safe_dump(rows, sort_keys=False, allow_unicode=True)


def open_project(spark: SparkSession, start: str, graph: str) -> Project:
    """The project whose graph directory is in ``start`` or the nearest directory above it."""
    return Project(spark, str(Path(project.find_root(start, graph)).parent), graph)
