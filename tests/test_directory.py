"""The directory source on a small project with broken parts."""

import pytest

from trellis.sources import directory

CONFIG = "name: Shop\nnode_types:\n  module: {description: m}\n  service: {description: s, required_aspects: [audit]}\nartifacts:\n  notes.md: {required: always}\n  api.md: {required: {when: has_incoming_relations}}\n"
FILES = {
    "yg-config.yaml": CONFIG,
    "model/auth/yg-node.yaml": "name: Auth\ntype: module\n",
    "model/auth/notes.md": "Authentication.\n",
    "model/auth/openapi.yaml": "ignored",
    "model/auth/api/yg-node.yaml": "name: Api\ntype: service\naspects:\n  - aspect: audit\n    exceptions: [x]\nrelations:\n  - {target: users, type: uses, consumes: [find]}\n  - {target: users, type: emits, event_name: E}\nmapping:\n  paths: [src/a.ts, src/b]\n",
    "model/bad/yg-node.yaml": "name: [\n",
    "model/bad/child/yg-node.yaml": "name: C\ntype: module\n",
    "model/orphan/notes.md": "no node here",
    "model/deep/inner/yg-node.yaml": "name: I\ntype: module\n",
    "model/users/yg-node.yaml": "name: Users\ntype: wrong\nrelations: null\n",
    "aspects/audit/yg-aspect.yaml": "name: Audit\nimplies: [logging]\nstability: schema\n",
    "aspects/audit/logging/yg-aspect.yaml": "name: Logging\n",
    "flows/checkout/yg-flow.yaml": "name: Checkout\nnodes: [auth/api, 3]\naspects: [audit]\n",
    "schemas/yg-node.yaml": "x: 1\n",
}


def project(tmp_path, **more):
    for name, text in (FILES | more).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_tables(spark, tmp_path):
    g = directory.load(spark, project(tmp_path))
    assert g.config["quality"]["context_budget"] == {"warning": 10_000, "error": 20_000}
    assert rows(g.nodes, "path", "parent_path", "type") == [("auth", None, "module"), ("auth/api", "auth", "service")]
    assert [r[0] for r in rows(g.node_errors, "path")] == ["bad", "users"]
    assert rows(g.node_aspects, "path", "aspect") == [("auth/api", "audit")]
    assert [(r.ord, r.type, r.consumes, r.event_name) for r in g.relations.orderBy("ord").collect()] == [(0, "uses", ["find"], None), (1, "emits", None, "E")]
    assert rows(g.mappings, "node", "ord", "mapping") == [("auth/api", 0, "src/a.ts"), ("auth/api", 1, "src/b")]
    assert rows(g.artifacts, "node", "filename", "content") == [("auth", "notes.md", "Authentication.\n")]
    assert rows(g.aspects, "id") == [("audit",), ("audit/logging",)] and rows(g.implies, "id", "implied") == [("audit", "logging")]
    assert rows(g.flow_nodes, "flow", "node") == [("checkout", "auth/api")] and rows(g.flow_aspects, "flow", "aspect") == [("checkout", "audit")]
    assert rows(g.schemas, "schema") == [("node",)]
    assert rows(g.without_node, "dir", "code") == [("deep", "W013"), ("orphan", "E015")]


def test_one_bad_file_empties_its_table(spark, tmp_path):
    g = directory.load(spark, project(tmp_path, **{"aspects/b/yg-aspect.yaml": "x: 1\n", "flows/empty/readme.md": "no flow file"}))
    assert g.aspects.isEmpty() and g.flows.isEmpty()


def test_root_node_and_bad_config(spark, tmp_path):
    root = project(tmp_path, **{"model/yg-node.yaml": "name: R\ntype: module\n", "yg-config.yaml": "name: ''\n"})
    with pytest.raises(ValueError, match="name"):
        directory.load(spark, root)
    g = directory.load(spark, root, tolerate_invalid_config=True)
    assert g.config_error and rows(g.nodes, "path", "parent_path") == [("", None), ("auth", ""), ("auth/api", "auth")]
    assert ("auth", "openapi.yaml") in rows(g.artifacts, "node", "filename")


@pytest.mark.parametrize("broken", ["{required: sometimes}", "{required: {when: later}}", "3"])
def test_config_rejects(broken):
    with pytest.raises(ValueError, match="required"):
        directory.parse_config(CONFIG.replace("{required: always}", broken))
