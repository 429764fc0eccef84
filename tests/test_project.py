"""The sample project as a whole: validation, drift, reports, git snapshots, state files, ignore rules, migration."""

import hashlib
import json
import subprocess

import pytest
import sample
from test_context import TOKENS, plain_layers
from pyspark.sql import functions as F

from trellis.functions import text
from trellis.plans import migrate, validate
from trellis.plans.reports import Project, open_project
from trellis.sources import directory, project


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_sample_is_valid(spark, tmp_path):
    sample.write(tmp_path)
    p = open_project(spark, str(tmp_path / "src" / "gates"), "graph")
    found = p.issues()
    assert rows(found.where("severity = 'error'"), "code", "node") == []
    assert rows(found.where("code in ('W001', 'W012')"), "code", "node") == [("W001", "gates/gate-driver"), ("W001", "sensors/soil-probe"), ("W012", "sensors/rain-gauge")]
    out, ok = p.validate("plans")
    assert ok and out.startswith("2 nodes scanned\n\n⚠ W002 plans")
    assert p.validate("gone") == ("0 nodes scanned\n\n✗  Node not found: gone\n\n1 errors, 0 warnings.\n", False)
    assert p.build_context("./plans/plan-maker/").endswith("</context-package>Budget status: ok\n")
    with pytest.raises(FileNotFoundError):
        project.find_root(str(tmp_path), "nowhere")


BROKEN = {
    "model/bad/yg-node.yaml": "name: [\n", "model/orphan/deep/notes.txt": "x", "model/plans/broken/yg-node.yaml": "name: B\ntype: wrong\naspects: [{aspect: none}, {aspect: metric-units, anchors: [MetricReader, GateDriver]}]\nrelations:\n  - {target: plans/gone, type: calls}\n  - {target: sensors, type: emits}\nmapping: {paths: [field/gates/driver.py, field/plans]}\n",
    "model/x/yg-node.yaml": "name: X\ntype: strict\nrelations: [{target: y, type: uses}]\n", "model/y/yg-node.yaml": "name: Y\ntype: strict\nrelations: [{target: x, type: uses}]\n",
    "model/wide/yg-node.yaml": "name: W\ntype: module\nrelations:\n" + "  - {target: sensors, type: uses}\n" * 3, "model/wide/responsibility.md": "long " * 800,
    "flows/f/yg-flow.yaml": "name: F\nnodes: [nobody]\naspects: [nothing]\n", "aspects/loop/yg-aspect.yaml": "name: L\nimplies: [loop, lost]\n", "schemas/yg-flow.yaml": None,
    "yg-config.yaml": sample.CONFIG.replace("  context_budget: {warning: 8000, error: 16000}", "  max_direct_relations: 2\n  context_budget: {warning: 900, error: 1000}").replace("  service: {description: s}", "  service: {description: s}\n  strict: {description: t, required_aspects: [leaves-trace]}").replace("description.md: {required: never}", "description.md: {required: {when: 'has_aspect:lost'}}"),
}


def test_every_rule(spark, tmp_path):
    sample.write(tmp_path, changes=BROKEN)
    g = directory.load(spark, str(tmp_path / "graph"))
    found = validate.of_project(spark, g, str(tmp_path)).cache()
    have = {}
    for r in found.collect():
        have.setdefault(r.code, []).append((r.node, r.message))
        assert r.rule == validate.RULES[r.code] and r.severity == ("error" if r.code[0] == "E" else "warning")
    assert set(validate.RULES) - set(have) == {"E012", "E014", "W005"}  # one id has one directory; each size has one level
    nodes = lambda code: sorted(n for n, _ in have[code])
    assert nodes("E001") == ["bad"] and nodes("E002") == ["plans/broken"] and nodes("E003") == ["plans/broken"]
    (e004,) = [m for n, m in have["E004"] if n == "plans/broken"]
    assert "plans/gone" in e004 and "Existing nodes in plans/: broken, plan-maker" in e004 and "Did you mean 'plans'?" in e004
    assert nodes("E009") == ["plans/broken", "plans/plan-maker"] or len(nodes("E009")) == 2
    assert have["E010"] == [(None, "Circular dependency: x -> y -> x")] and have["E017"] == [(None, "Aspect implies cycle: loop → loop")]
    assert nodes("E015") == ["orphan/deep"] and nodes("W013") == ["orphan"]
    assert nodes("W006") == ["wide"] and nodes("W007") == ["wide"] and nodes("W009") == ["plans/broken"] and nodes("W011") == ["x", "y"]
    assert [m for _, m in have["W014"]] == ["Anchor 'MetricReader' for aspect 'metric-units' not found in mapped source files"]
    scoped, n = validate.of_scope(g, found, "plans")
    assert n == 3 and {r.node for r in scoped.select("node").collect()} <= {None, "plans", "plans/broken", "plans/plan-maker"}
    bad, n = validate.of_scope(g, found, "bad/child")
    assert n == 0 and bad.first().code == "E001"
    near = rows(__import__("trellis.operators.rules", fromlist=["x"]).relevant(g, found, "plans/plan-maker"), "code", "node")
    assert ("E010", None) in near and any(c == "E006" for c, _ in near) and ("E002", "plans/broken") not in near


def test_invalid_config_is_a_row(spark, tmp_path):
    sample.write(tmp_path, changes={"yg-config.yaml": "name: ''\n"})
    p = Project(spark, str(tmp_path), "graph", tolerate_invalid_config=True)
    codes = {r.code for r in p.issues().select("code").collect()}
    assert "E012" in codes and not codes & {"E002", "E003", "W001", "W006", "W011"}


def test_drift_sync_and_state(spark, tmp_path):
    graph = sample.write(tmp_path)
    p = Project(spark, str(tmp_path), "graph")
    status = lambda: {r.node: r.status for r in p.drift().report().collect()}
    assert status() == {"gates/gate-driver": "source-drift", "plans/plan-maker": "source-drift", "sensors/rain-gauge": "unmaterialized"}
    out = p.sync()
    assert out.count("Hash: none -> ") == 3 and set(status().values()) == {"ok", "missing"}
    state = json.loads((tmp_path / "graph/.drift-state/gates/gate-driver.json").read_text())
    want = {f"graph/{k}": v for k, v in sample.FILES.items() if k.startswith(("model/gates/yg", "model/gates/resp", "model/gates/gate-driver/yg", "model/gates/gate-driver/resp", "aspects/metric-units", "flows/"))} | {k: v for k, v in sample.SOURCES.items() if "gates" in k}
    hashes = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert state["files"] == hashes and len(hashes) == 11
    assert state["hash"] == hashlib.sha256("\n".join(f"{k}:{hashes[k]}" for k in sorted(hashes)).encode()).hexdigest()
    # A source of one node, a file of the graph of another.
    import os

    for name in ("field/gates/limits.py", "graph/model/plans/responsibility.md"):
        at = tmp_path / name
        at.write_text("changed")
        os.utime(at, (2_000_000_000, 2_000_000_000))
    assert status() == {"gates/gate-driver": "source-drift", "plans/plan-maker": "graph-drift", "sensors/rain-gauge": "missing"}
    report, ok = p.drift_report(limit=1)
    assert not ok and "  [drift]      gates/gate-driver\n               field/gates/limits.py  (changed)\n  ... 1 more (2 total)" in report
    assert "Graph drift:\n  [drift]      plans/plan-maker\n               graph/model/plans/responsibility.md  (changed)" in report
    assert report.endswith("Summary: 1 source-drift, 1 graph-drift, 0 full-drift, 1 missing, 0 unmaterialized, 0 ok\n")
    with pytest.raises(ValueError, match="no mapping"):
        p.drift().report("sensors/soil-probe")
    # The same time stamp means the stored hash, whatever the bytes.
    at = tmp_path / "field/plans/maker.py"
    kept = at.stat()
    at.write_text("other bytes")
    os.utime(at, ns=(kept.st_atime_ns, kept.st_mtime_ns))
    changes = {r.path for r in p.drift().changes().collect()}
    assert "field/plans/maker.py" not in changes
    (tmp_path / "graph/.drift-state/old").mkdir()
    (tmp_path / "graph/.drift-state/old/node.json").write_text('{"hash": "x"}')
    (tmp_path / "graph/.drift-state/broken.json").write_text("{")
    assert "old/node" in {r.node for r in project.read_state(spark, graph).collect()}
    p.sync()
    assert not (tmp_path / "graph/.drift-state/old").exists() and set(status().values()) == {"ok", "missing"}


def test_old_state_file_is_split(spark, tmp_path):
    graph = sample.write(tmp_path, changes={".drift-state": "a/b:\n  hash: h\n  files: {x: y}\nc: old\n"})
    assert [(r.node, r.hash, r.files) for r in project.read_state(spark, graph).collect()] == [("a/b", "h", {"x": "y"})]
    assert json.loads((tmp_path / "graph/.drift-state/a/b.json").read_text()) == {"hash": "h", "files": {"x": "y"}, "mtimes": {}}
    assert project.read_state(spark, graph).count() == 1


def test_a_broken_rewrite_goes_on(spark, tmp_path):
    old = "a/b:\n  hash: h\n  files: {x: y}\n"
    graph = sample.write(tmp_path, changes={".drift-state": old, ".drift-state.new/half.json": '{"hash": "no"}'})
    assert [(r.node, r.hash) for r in project.read_state(spark, graph).collect()] == [("a/b", "h")]
    top = tmp_path / "graph"
    # Stopped after the old file went aside: the new files take their place, the old one goes.
    (top / ".drift-state").rename(top / ".drift-state.new")
    (top / ".drift-state.old").write_text(old)
    assert [(r.node, r.hash) for r in project.read_state(spark, graph).collect()] == [("a/b", "h")]
    assert sorted(p.name for p in top.glob(".drift-state*")) == [".drift-state"] and not [p for p in top.rglob("*.json.*")]


@pytest.mark.parametrize("rules, path, out", [
    ("*.log", "a/b.log", True), ("*.log\n!keep.log", "a/keep.log", False), ("/build", "build/x", True), ("/build", "a/build/x", False), ("build/", "a/build/x", True), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True),
    ("doc/*.txt", "doc/x.txt", True), ("doc/*.txt", "doc/s/x.txt", False), ("# note\n\n", "x", False), ("[ab].c", "b.c", True), ("x?.c", "xy.c", True), ("x?.c", "x/.c", False), ("dir\n!dir/keep", "dir/keep", True), ("out/", "out", True), (r"\!x", "!x", True),
])
def test_ignore_rules(rules, path, out):
    assert project.ignores(rules, path) is out


def test_mapped_directories_follow_ignore_rules(spark, tmp_path):
    sources = {"field/gates/a.ts": "a", "field/gates/a.log": "b", "field/gates/sub/c.tmp": "c", "field/gates/sub/.gitignore": "*.tmp\n", ".gitignore": "*.log\n", "field/gates/.hidden": "MetricReader", "field/gates/node_modules/m.ts": "m", "src/one.log": "d", "field/gates/child/k.ts": "k"}
    changes = {"model/gates/gate-driver/yg-node.yaml": "name: A\ntype: service\nmapping: {paths: [field/gates, src/one.log]}\n", "model/gates/gate-driver/child/yg-node.yaml": "name: C\ntype: service\nmapping: {paths: [field/gates/child]}\n"}
    sample.write(tmp_path, changes=changes, sources=sources)
    d = Project(spark, str(tmp_path), "graph").drift()
    mine = {r.path for r in d.current.where("node = 'gates/gate-driver' and category = 'source'").collect()}
    assert mine == {"field/gates/a.ts", "field/gates/sub/.gitignore", "field/gates/.hidden", "field/gates/node_modules/m.ts", "src/one.log"}
    files = project.project_files(spark, str(tmp_path))
    mappings = spark.createDataFrame([("n", "field/gates")], "node string, mapping string")
    assert sorted(r.content for r in project.anchor_texts(spark, str(tmp_path), files, mappings).collect()) == ["a", "b", "c", "k"]


def test_reports(spark, tmp_path):
    sample.write(tmp_path)
    p = Project(spark, str(tmp_path), "graph")
    assert p.tree() == "model/\n├── gates/ [module] -> 0 relations\n│   └── gate-driver/ [service] -> 0 relations\n├── plans/ [module] aspects:leaves-trace -> 0 relations\n│   └── plan-maker/ [service] aspects:leaves-trace -> 2 relations\n└── sensors/ [module] -> 0 relations\n    ├── rain-gauge/ [service] -> 0 relations\n    └── soil-probe/ [service] -> 0 relations\n"
    assert p.tree("sensors/", 1) == "└── sensors/ [module] -> 0 relations\n"
    assert p.deps("plans/plan-maker") == "plans/plan-maker\n├── uses gates/gate-driver\n└── uses sensors/soil-probe\n" and p.deps("sensors") == "sensors\n"
    assert p.owner("./field/gates/limits.py") == "field/gates/limits.py -> gates/gate-driver\n" and p.owner("src/zzz") == "src/zzz -> no graph coverage (file not found)\n"
    out = p.impact_node("gates/gate-driver")
    assert "Directly dependent:\n  <- plans/plan-maker (uses)\n" in out and "Flows: Morning Round\nAspects (scope covers node): Metric Units\nNodes sharing aspects:\n  plans (metric-units)" in out and out.endswith("Total scope: 1 nodes, 1 flows, 1 aspects\n")
    assert "  plans/plan-maker (own)\n" in p.impact_aspect("leaves-trace") and "Implies: metric-units" in p.impact_aspect("leaves-trace")
    assert "Participants:\n  gates/gate-driver\n  plans/plan-maker\n\nFlow aspects: metric-units" in p.impact_flow("Morning Round") and p.impact_flow("morning-round") == p.impact_flow("Morning Round")
    assert "- id: metric-units\n  name: Metric Units\n  description: Which units to use\n" in p.aspects_yaml() and "  participants: 2\n" in p.flows_yaml()
    out = p.status()
    assert "Nodes: 7 (3 modules, 4 services) + 0 blackbox\nRelations: 2 structural, 0 event\nAspects: 2    Flows: 1\n" in out and "  Artifacts: 10/28 slots filled (36%) — 4 types × 7 nodes\n  Relations: avg 0.3/node, max 2 (plans/plan-maker)\n  Mapping: 3/7 nodes mapped to source\n  Aspects: 3/7 nodes have aspect coverage\n" in out
    text_, ok = p.preflight(quick=True)
    assert ok and "Drift:      skipped (--quick)\n\nStatus:     7 nodes, 2 aspects, 1 flows, 4 mapped paths\n" in text_


def test_git_snapshots_and_simulation(spark, tmp_path):
    sample.write(tmp_path)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    assert project.at_ref(spark, str(tmp_path), "graph") is None and project.last_commit(str(tmp_path), "graph") is None
    run("init")
    run("add", "-A")
    run("commit", "-m", "one")
    (tmp_path / "graph/model/gates/gate-driver/responsibility.md").write_text("Opens and shuts one gate at a time, or two of them in an emergency.\n")
    assert [r.path for r in project.changed_files(spark, str(tmp_path), "graph").collect()] == ["gates/gate-driver/responsibility.md"]
    assert project.last_commit(str(tmp_path), "graph") > 1_500_000_000 and project.at_ref(spark, str(tmp_path), "graph", "nope") is None
    p = Project(spark, str(tmp_path), "graph")
    out = p.impact_node("gates/gate-driver", simulate=True)
    more = len("Opens and shuts one gate at a time, or two of them in an emergency.") - len("Opens and shuts one gate at a time.")
    after = -(-(len("\n\n".join(plain_layers())) + more) // 4)
    assert f"plans/plan-maker:\n  + Changed dependency interface: gates/gate-driver\n  Budget: {TOKENS} -> {after} tokens (ok)\n  Mapped files (on-disk): source-drift" in out
    changed = __import__("trellis.operators.impact", fromlist=["x"]).changed(p.g, project.changed_files(spark, str(tmp_path), "graph"))
    assert rows(changed, "node", "reason") == [("gates/gate-driver", "changed"), ("plans/plan-maker", "dependent")]


OLD = {
    "config.yaml": "name: Old\nnode_types: [module, gadget]\nstack: {language: Python}\nstandards: Be kind.\nquality: {max_direct_relations: 4}\n", "model/a/node.yaml": "name: A\ntype: module\naspects: [x, y]\naspect_exceptions: {x: [e]}\nanchors: {y: [f]}\ntags: [t]\n",
    "aspects/x/aspect.yaml": "name: X\n", "flows/f/flow.yaml": "name: F\nnodes: [a]\n", "schemas/node.yaml": "x: 1\n", ".drift-state": "a: b\n",
}


def test_migration(spark, tmp_path):
    for name, body in OLD.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    assert migrate.detect_version(root) == "1.4.3"
    (done,) = migrate.run_migrations("1.4.3", migrate.MIGRATIONS, root)
    assert migrate.detect_version(root) == "2.0.0" and done.warnings == ["Unknown node type 'gadget' — needs a description"]
    assert migrate.run_migrations("2.0.0", migrate.MIGRATIONS, root) == [] and migrate.run_migrations("x", migrate.MIGRATIONS, root) == []
    assert "- **language:** Python" in (tmp_path / "model/internals.md").read_text() and not (tmp_path / ".drift-state").exists() and (tmp_path / "schemas/yg-node.yaml").exists()
    g = directory.load(spark, root)
    assert rows(g.nodes, "path") == [("",), ("a",)] and g.settings.max_direct_relations == 4
    assert [(r.aspect, r.exceptions, r.anchors) for r in g.node_aspects.orderBy("ord").collect()] == [("x", ["e"], []), ("y", [], ["f"])]
    before = {p: p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    migrate.to_2_0_0(root)
    assert {p: p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == before
    (tmp_path / "yg-config.yaml").unlink()
    assert migrate.detect_version(root) is None


def test_scalars(spark):
    assert text.node_path(" ./a/b// ") == "a/b" and text.project_path("/p", r"x\y/../z") == "x/z"
    for bad in ("", "../x"):
        with pytest.raises(ValueError):
            text.project_path("/p", bad)
    assert [text.pluralize(*x) for x in (("library", 2), ("module", 1), ("service", 3))] == ["libraries", "module", "services"]
    assert text.thousands(12345) == "12,345" and text.rounded(0.25, 1) == "0.3" and text.rounded(2.5) == "3" and text.short_hash("0123456789") == "01234567" and text.short_hash(None) == "none"
    order = ["1.4.3", "2.0.0-alpha.1", "2.0.0-alpha.beta", "2.0.0-rc", "2.0.0", "2.0.10"]
    assert sorted(order[::-1], key=text.semver) == order and text.semver("2.0") is None and text.semver("v1.2.3") == text.semver("1.2.3+x")
    r = spark.range(1).select(text.units(F.lit("a😀é")).alias("u"), text.trim(F.lit("\ufeff\u00a0 x y\u2003\n")).alias("t"), text.escape(F.lit('a"b')).alias("e"), text.tokens(F.lit(5)).alias("k")).first()
    assert (r.u, r.t, r.e, r.k) == (4, "x y", "a&quot;b", 2)
    names = ["b", "A", "a", "B", "a-b", "a/b", "é"]
    assert [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.collated("n")).collect()][0:2] == ["a", "A"]
