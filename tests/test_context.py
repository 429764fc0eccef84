"""Context packages of the sample project: sizes by layer, the texts, and odd graphs."""

import pytest
import sample
from pyspark.sql import functions as F

from trellis.operators import aspects, closure, context
from trellis.sources import directory


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    return directory.load(spark, sample.write(tmp_path_factory.mktemp("sample")))


def blocks(folder, names):
    return "\n\n".join(f"### {n}\n{sample.FILES[f'{folder}/{n}']}" for n in names)


def plain_layers():
    """The layers of the plan maker, put together by hand."""
    both = ["description.md", "responsibility.md"]
    node = sample.FILES["model/plans/plan-maker/yg-node.yaml"].strip()
    return [
        "**Project:** Orchard Watering\n", blocks("model/plans", both), f"### yg-node.yaml\n{node}\n\n" + blocks("model/plans/plan-maker", both),
        blocks("model/gates/gate-driver", both[1:]).rstrip(), blocks("model/sensors/soil-probe", both).rstrip(), blocks("flows/morning-round", ["description.md", "steps.md"]),
        blocks("aspects/leaves-trace", ["content.md"]), blocks("aspects/metric-units", ["content.md"]),
    ]


TOKENS = -(-len("\n\n".join(plain_layers())) // 4)


def test_known_sizes(g):
    rows = context.layers(g).where("node = 'plans/plan-maker'").collect()
    assert sorted(r.units for r in rows) == sorted(map(len, plain_layers()))
    assert {r.node: (r.tokens, r.status) for r in context.budget(g).collect()}["plans/plan-maker"] == (TOKENS, "ok")


def test_texts_have_the_counted_sizes(g):
    sizes = {r.node: r.tokens for r in context.budget(g).collect()}
    for r in context.packages(g).collect():
        assert r.tokens == sizes.pop(r.node) and f'token-count="{r.tokens}"' in r.text
    assert not sizes


def test_markdown_package(g):
    text = context.markdown(g, "plans/plan-maker", "2026-02-10T12:00:00.000Z")
    own = sample.FILES["model/plans/plan-maker/yg-node.yaml"].strip()
    want = "# Context Package: PlanMaker\n# Path: plans/plan-maker\n# Generated: 2026-02-10T12:00:00.000Z\n\n---\n\n"
    want += "## Global\n\n### Global Context\n\n**Project:** Orchard Watering\n\n\n---\n\n"
    want += "## Hierarchy\n\n### Module Context (plans/)\n\n### description.md\nA plan says how many litres each row of trees gets tomorrow.\n\n\n### responsibility.md\nTurns weather and soil into plans.\n\n\n---\n\n"
    want += f"## OwnArtifacts\n\n### Node: PlanMaker\n\n### yg-node.yaml\n{own}\n\n### description.md\nRuns at dusk, once the last reading is in.\n\n\n### responsibility.md\nWrites tomorrow's plan and hands it to the gates.\n\n\n### Materialization Target\n\nfield/plans/maker.py\n\n---\n\n"
    want += f"## Aspects\n\n### Day Book (aspect: leaves-trace)\n\n### content.md\n{sample.TRACE}\n\n### Metric Units (aspect: metric-units)\n\n### content.md\n{sample.UNITS}\n\n---\n\n"
    want += "## Relational\n\n### Dependency: GateDriver (uses) — gates/gate-driver\n\n### responsibility.md\nOpens and shuts one gate at a time.\n\n### Dependency: SoilProbe (uses) — sensors/soil-probe\n\n### description.md\nTwo probes stand in every row.\n\n\n### responsibility.md\nDepth of damp soil by row.\n\n"
    want += "### Flow: Morning Round\n\n### description.md\nWater is out before the sun is.\n\n\n### steps.md\nRead the plan, open, wait, shut, write the day book.\n\n\n---\n\n"
    want += f"Context size: {TOKENS} tokens\nLayers: global, hierarchy, own, relational, relational, flows, aspects, aspects\n"
    assert text == want


def test_tagged_package(g):
    only = g.nodes.sparkSession.createDataFrame([("plans/plan-maker",)], "node string")
    (r,) = context.packages(g, only).collect()
    assert r.text.startswith(f'<context-package node-path="plans/plan-maker" node-name="PlanMaker" token-count="{TOKENS}">\n\n<global>\n**Project:** Orchard Watering\n\n</global>\n\n<hierarchy path="plans" aspects="leaves-trace,metric-units">\n')
    assert '<materialization-target paths="field/plans/maker.py" />\n\n<aspect name="Day Book" id="leaves-trace">' in r.text
    assert '<dependency target="gates/gate-driver" type="uses">\n### responsibility.md\nOpens and shuts one gate at a time.\n</dependency>' in r.text
    assert r.text.endswith('<flow name="Morning Round" aspects="metric-units">\n### description.md\nWater is out before the sun is.\n\n\n### steps.md\nRead the plan, open, wait, shut, write the day book.\n\n</flow>\n\n</context-package>')


def test_aspects_and_provenance(g):
    have = {}
    for r in aspects.effective(g).collect():
        have.setdefault(r.node, set()).add(r.aspect)
    assert have["gates/gate-driver"] == {"metric-units"} and have["plans"] == {"leaves-trace", "metric-units"} and "sensors" not in have
    source = {(r.node, r.aspect): r.source for r in aspects.provenance(g).collect()}
    assert source["gates/gate-driver", "metric-units"] == "flow morning-round" and source["plans", "metric-units"] == "implied"
    assert source["plans", "leaves-trace"] == source["plans/plan-maker", "leaves-trace"] == "own"


def test_odd_relations_flags_and_order(spark, tmp_path):
    config = sample.CONFIG.replace("interface.md: {required: {when: has_incoming_relations}}", "interface.md: {required: never, included_in_relations: true}")
    changes = {
        "yg-config.yaml": config, "model/sensors/soil-probe/interface.md": "find()\n \n", "model/gates/interface.md": "  \n",
        "model/plans/plan-maker/yg-node.yaml": "name: 'Order \"S\"'\ntype: service\naspects:\n  - {aspect: z, exceptions: [one, two]}\n  - {aspect: nowhere}\nrelations:\n  - {target: plans, type: uses}\n  - {target: sensors/soil-probe, type: calls, consumes: [a, b], failure: retry }\n  - {target: sensors, type: emits, consumes: [x], event_name: Made}\n  - {target: sensors, type: listens}\n  - {target: gates, type: uses}\n  - {target: sensors, type: implements, failure: stop}\n",
        "model/sensors/responsibility.md": None, "aspects/z/yg-aspect.yaml": "name: Z\nimplies: [y, metric-units]\nstability: schema\n", "aspects/y/yg-aspect.yaml": "name: Y\nimplies: [metric-units]\n", "aspects/y/b.md": "b", "aspects/y/A.md": "a",
    }
    g = directory.load(spark, sample.write(tmp_path, changes=changes))
    only = spark.createDataFrame([("plans/plan-maker",)], "node string")
    (r,) = context.packages(g, only).collect()
    assert r.tokens == context.budget(g, only).first().tokens
    for piece in (
        'node-name="Order &quot;S&quot;"', '<own-artifacts aspects="z,y,metric-units,nowhere">', '<dependency target="sensors/soil-probe" type="calls" consumes="a, b" failure="retry">\nConsumes: a, b\n\nOn failure: retry\n\n### interface.md\nfind()\n</dependency>',
        '<event target="sensors" type="emits" event-name="Made" consumes="x">\nTarget: sensors\nYou publish Made.\nConsumes: x\n</event>\n\n<event target="sensors" type="listens" event-name="Sensors">\nSource: sensors\nYou listen for Sensors.\n</event>',
        '<dependency target="gates" type="uses">\n### interface.md\n</dependency>', '<dependency target="sensors" type="implements" failure="stop">\nOn failure: stop\n</dependency>',
        "**Stability tier:** schema\n\n⚠ **Exception for this node:** one; two", '<aspect name="Y" id="y">\n### A.md\na\n\n### b.md\nb\n</aspect>',
    ):
        assert piece in r.text, piece
    assert 'target="plans"' not in r.text
    at = [r.text.index(f'id="{x}"') for x in ("leaves-trace", "metric-units", "z", "y")]
    assert at == sorted(at)


def test_nodes_that_cannot_be_assembled(spark, tmp_path):
    changes = {"aspects/a/yg-aspect.yaml": "name: A\nimplies: [b]\n", "aspects/b/yg-aspect.yaml": "name: B\nimplies: [a]\n", "model/sensors/yg-node.yaml": "name: U\ntype: module\naspects: [{aspect: a}]\n", "model/gates/yg-node.yaml": "name: A\ntype: module\nrelations: [{target: gone, type: listens}]\n"}
    g = directory.load(spark, sample.write(tmp_path, changes=changes))
    assert sorted(r.node for r in context.budget(g).collect()) == ["gates/gate-driver", "plans", "plans/plan-maker"]


def test_layer_sums_are_sums_of_layers(spark):
    from trellis.sources import star

    g = star.from_star_schema(spark, "/root/testdata/sf0.001")
    g.relations = closure.written(g.relations.unionAll(g.relations.where("dst like '%/p1'").withColumn("dst", F.lit("gone"))))
    want = context.layers(g).groupBy("node", "layer_type").agg(F.count("*").alias("n_layers"), F.sum("units").alias("units"))
    out = context.layer_sums(g)
    got = {tuple(r) for r in out.collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100
    # No join takes out nodes or ancestors.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_digests_are_those_of_the_texts(g, spark, monkeypatch):
    gates = g.relations.where("dst = 'gates/gate-driver'")
    again = gates.withColumn("type", F.lit("calls")).withColumn("consumes", F.array(F.lit('a"b'))).unionAll(gates).unionAll(gates.withColumn("dst", F.lit("gates")))
    empty = gates.select("src", F.lit(7).cast(g.relations.schema["ord"].dataType).alias("ord"), F.lit("plans/plan-maker").alias("dst"), "type", "consumes", F.lit("wait \n").alias("failure"), "event_name")
    from dataclasses import replace

    more = replace(g, relations=g.relations.unionByName(again).unionByName(empty.withColumn("dst", F.lit("bare"))), nodes=g.nodes.unionByName(g.nodes.where("path = 'gates'").withColumn("path", F.lit("bare"))))
    want = {r.node: (r.tokens, r.status, r.digest) for r in context.packages(more).select("node", "tokens", "status", F.sha2("text", 256).alias("digest")).collect()}
    met, plain = [], closure.Rounds.write
    monkeypatch.setattr(closure.Rounds, "write", lambda self, df, *by: met.append(plain(self, df, *by)) or met[-1])
    assert {r.node: (r.tokens, r.status, r.digest) for r in context.digests(more).collect()} == want and len(want) == 8
    sent = [r for x in met if "start" in x.columns for r in x.collect()]
    assert sum(r.of == "gates/gate-driver" for r in sent) == 3 and not any(r.of and "one gate at a time" in r.tagged for r in sent)
