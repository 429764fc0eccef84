"""Package sizes after a change equal those counted anew, and only touched nodes are counted."""

import dataclasses

import pytest
import sample
from pyspark.sql import functions as F

from trellis.operators import context, delta
from trellis.sources import directory


def load(spark, at, changes=None):
    return directory.load(spark, sample.write(at, changes=changes))


GATE, LATE = "model/gates/gate-driver/responsibility.md", "model/plans/late/yg-node.yaml"
CHANGES = {
    "text, new node": ({GATE: "Now much longer than it was before.\n", LATE: "name: Late\ntype: service\nrelations: [{target: sensors, type: uses}]\n"}, {"gates/gate-driver", "plans/plan-maker", "plans/late"}),
    "parent, flow": ({"model/sensors/responsibility.md": None, "flows/morning-round/steps.md": "Go."}, {"sensors", "sensors/rain-gauge", "sensors/soil-probe", "gates/gate-driver", "plans/plan-maker"}),
    "lost node, cycle": ({f"model/sensors/soil-probe/{f}": None for f in ("yg-node.yaml", "description.md", "responsibility.md")} | {"aspects/metric-units/yg-aspect.yaml": "name: Metric Units\nimplies: [leaves-trace]\n"}, {"sensors/soil-probe", "gates/gate-driver", "plans", "plans/plan-maker"}),
}


@pytest.mark.parametrize("kind", CHANGES)
def test_like_counting_anew(spark, tmp_path, kind):
    changes, nodes = CHANGES[kind]
    before, after = load(spark, tmp_path / "a"), load(spark, tmp_path / "b", changes)
    assert {r.node for r in delta.touched(before, after).collect()} == nodes
    stored = context.budget(before)
    old, new = ({r.node: (r.tokens, r.status) for r in context.budget(g).collect()} for g in (before, after))
    got = {r.node: r for r in delta.budget_changes(before, after, stored).collect()}
    assert set(got) == set(old) | set(new)
    for n, r in got.items():
        assert (r.tokens_before, r.tokens_after, r.status) == (old.get(n, (None,))[0], *new.get(n, (None, None)))


def test_nothing_and_everything(spark, tmp_path):
    g = load(spark, tmp_path)
    assert delta.touched(g, dataclasses.replace(g, nodes=g.nodes.orderBy(F.rand()))).count() == 0
    assert delta.touched(g, dataclasses.replace(g, settings=dataclasses.replace(g.settings, error=1))).count() == g.nodes.count()
