"""A small project of our own, the watering of an orchard: seven nodes, two aspects, one flow."""

TRACE = """Whoever moves water leaves a trace: one line per valve and movement in the day book.
A line names the valve, the litres, the plan that asked for them, and the minute.

Lines are added, never rewritten; a wrong one is followed by a line that takes it back.
"""
UNITS = """Volumes are litres, depths are millimetres, temperatures are degrees Celsius.
Convert where a reading enters, and nowhere else.
"""
CONFIG = """name: Orchard Watering
quality:
  context_budget: {warning: 8000, error: 16000}
node_types:
  module: {description: m}
  service: {description: s}
artifacts:
  responsibility.md: {required: always}
  interface.md: {required: {when: has_incoming_relations}}
  constraints.md: {required: never}
  description.md: {required: never}
"""
FILES = {
    "yg-config.yaml": CONFIG,
    "model/gates/yg-node.yaml": "name: Gates\ntype: module\n",
    "model/gates/responsibility.md": "Everything that lets water through or holds it back.\n",
    "model/gates/gate-driver/yg-node.yaml": "name: GateDriver\ntype: service\nmapping:\n  paths:\n    - field/gates/driver.py\n    - field/gates/limits.py\n",
    "model/gates/gate-driver/responsibility.md": "Opens and shuts one gate at a time.\n",
    "model/gates/gate-driver/wiring.csv": "pin,gate\n",
    "model/plans/yg-node.yaml": "name: Plans\ntype: module\naspects:\n  - aspect: leaves-trace\n",
    "model/plans/description.md": "A plan says how many litres each row of trees gets tomorrow.\n",
    "model/plans/responsibility.md": "Turns weather and soil into plans.\n",
    "model/plans/plan-maker/yg-node.yaml": "name: PlanMaker\ntype: service\naspects:\n  - aspect: leaves-trace\nrelations:\n  - target: gates/gate-driver\n    type: uses\n  - target: sensors/soil-probe\n    type: uses\nmapping:\n  paths:\n    - field/plans/maker.py\n",
    "model/plans/plan-maker/description.md": "Runs at dusk, once the last reading is in.\n",
    "model/plans/plan-maker/responsibility.md": "Writes tomorrow's plan and hands it to the gates.\n",
    "model/sensors/yg-node.yaml": "name: Sensors\ntype: module\n",
    "model/sensors/responsibility.md": "Readings from the field.\n",
    "model/sensors/soil-probe/yg-node.yaml": "name: SoilProbe\ntype: service\n",
    "model/sensors/soil-probe/description.md": "Two probes stand in every row.\n",
    "model/sensors/soil-probe/responsibility.md": "Depth of damp soil by row.\n",
    "model/sensors/rain-gauge/yg-node.yaml": "name: RainGauge\ntype: service\nmapping:\n  paths: [field/sensors/rain.py]\n",
    "model/sensors/rain-gauge/responsibility.md": "Rain since midnight.\n",
    "aspects/leaves-trace/yg-aspect.yaml": "name: Day Book\nimplies: [metric-units]\n",
    "aspects/leaves-trace/content.md": TRACE,
    "aspects/metric-units/yg-aspect.yaml": "name: Metric Units\ndescription: Which units to use\n",
    "aspects/metric-units/content.md": UNITS,
    "flows/morning-round/yg-flow.yaml": "name: Morning Round\nnodes:\n  - plans/plan-maker\n  - gates/gate-driver\naspects:\n  - metric-units\n",
    "flows/morning-round/description.md": "Water is out before the sun is.\n",
    "flows/morning-round/steps.md": "Read the plan, open, wait, shut, write the day book.\n",
    "schemas/yg-node.yaml": "x: 1\n", "schemas/yg-aspect.yaml": "x: 1\n", "schemas/yg-flow.yaml": "x: 1\n",
}
SOURCES = {"field/gates/driver.py": "# GateDriver\n", "field/gates/limits.py": "# Limits\n", "field/plans/maker.py": "# PlanMaker\n"}


def write(project, graph="graph", changes=None, sources=None):
    """The project under ``project`` with its graph in the directory ``graph``; a change to None removes a file."""
    files = {f"{graph}/{k}": v for k, v in {**FILES, **(changes or {})}.items()} | (SOURCES if sources is None else sources)
    for name, text in files.items():
        at = project / name
        if text is None:
            at.unlink(missing_ok=True)
            continue
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(project / graph)
