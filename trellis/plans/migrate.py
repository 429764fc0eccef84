"""Migration of a stored graph directory from older layouts; a driver-side rewrite of files, safe to repeat."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.text import semver
from ..sources.directory import CONFIG, NODE, yaml

#: The version of a directory whose configuration names none.
UNVERSIONED = "1.4.3"
# Descriptions of known node types, the artifact types of version 2, and renamed files.
TYPES = {
    "module": "Business logic unit with clear domain responsibility",
    "service": "Component providing functionality to other nodes",
    "library": "Shared utility code with no domain knowledge",
    "infrastructure": "Guards, middleware, interceptors — invisible in call graphs but affect blast radius",
}
TODO = "TODO: add description"
ARTIFACTS = {
    "responsibility.md": {"required": "always", "description": "What this node is responsible for, and what it is not", "included_in_relations": True},
    "interface.md": {"required": {"when": "has_incoming_relations"}, "description": "Public API — methods, parameters, return types, contracts, failure modes, exposed data structures", "included_in_relations": True},
    "internals.md": {"required": "never", "description": "How the node works and why — algorithms, business rules, state machines, design decisions with rejected alternatives"},
}
MARK = "<!-- migrated-stack-standards-v2 -->"


@dataclass
class Result:
    actions: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Migration:
    to: str
    description: str
    run: Callable[[str], Result]


def detect_version(root: str) -> str | None:
    """The configuration's version; UNVERSIONED if it names none or has the old name; None without one."""
    at = Path(root)
    try:
        raw = yaml.safe_load((at / CONFIG).read_text())
        return raw["version"].strip() if isinstance(raw, dict) and isinstance(raw.get("version"), str) else UNVERSIONED
    except (OSError, yaml.YAMLError):
        return UNVERSIONED if (at / "config.yaml").exists() else None


def run_migrations(current: str, migrations: list[Migration], root: str) -> list[Result]:
    """Runs those whose target is beyond the current version, lowest first; none from an invalid version."""
    now = semver(current)
    if now is None:
        return []
    ahead = [m for m in migrations if (v := semver(m.to)) is not None and v > now]
    return [m.run(root) for m in sorted(ahead, key=lambda m: semver(m.to))]


def _dump(path: Path, data) -> None:
    path.write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True, width=120))


def _node_types(raw, out: Result) -> dict:
    types: dict[str, dict] = {}
    given = {n: {} for n in raw if isinstance(n, str)} if isinstance(raw, list) else raw if isinstance(raw, dict) else {}
    for name, entry in given.items():
        entry = entry if isinstance(entry, dict) else {}
        own = entry.get("description")
        types[name] = {"description": TYPES.get(name) or (own if isinstance(own, str) else TODO)}
        if entry.get("required_aspects"):
            types[name]["required_aspects"] = entry["required_aspects"]
        if types[name]["description"] in ("", TODO):
            out.warnings.append(f"Unknown node type '{name}' — needs a description")
    if isinstance(raw, list):
        out.actions.append("Converted node_types from array to object format")
    if "infrastructure" not in types:
        types["infrastructure"] = {"description": TYPES["infrastructure"]}
        out.actions.append("Added infrastructure node type")
    return types


def _stack(model: Path, stack, standards, out: Result) -> None:
    """Moves the old configuration's stack and standards to the text of a root node."""
    lines = ["## Technology Stack", "", *(f"- **{k}:** {v}" for k, v in stack.items()), ""] if stack else []
    lines += ["## Standards", "", standards, ""] if standards else []
    if not lines or not model.exists():
        return
    if not any((model / n).exists() for n in (NODE, "node.yaml")):
        _dump(model / NODE, {"name": "Root", "type": "module"})
        (model / "responsibility.md").write_text("TBD\n")
        out.actions.append("Created root node in model/ for stack/standards migration")
    text = model / "internals.md"
    before = text.read_text() if text.exists() else ""
    if MARK not in before:
        text.write_text((before.rstrip() + "\n\n" if before else "") + MARK + "\n" + "\n".join(lines))
        out.actions.append("Migrated stack/standards to model/internals.md")


def _rename(folder: Path, old: str, out: Result) -> None:
    for path in sorted(folder.rglob(old)):
        if path.is_file() and not path.with_name(f"yg-{old}").exists():
            path.rename(path.with_name(f"yg-{old}"))
            out.actions.append(f"Renamed {old} → yg-{old} in {path.parent}")


def _node(path: Path, out: Result) -> None:
    """Aspect ids become entries with their exceptions and anchors; tags go."""
    raw = yaml.safe_load(path.read_text())
    if not isinstance(raw, dict):
        out.warnings.append(f"Skipped {path}: not a valid YAML object")
        return
    before = dict(raw)
    if isinstance(raw.get("aspects"), list) and raw["aspects"] and isinstance(raw["aspects"][0], str):
        extra = {"exceptions": raw.pop("aspect_exceptions", None) or {}, "anchors": raw.pop("anchors", None) or {}}
        raw["aspects"] = [{"aspect": a} | {k: v[a] for k, v in extra.items() if v.get(a)} for a in raw["aspects"]]
    raw.pop("tags", None)
    if raw != before:
        _dump(path, raw)
        out.actions.append(f"Transformed {path.parent.name}/{NODE}")


def to_2_0_0(root: str) -> Result:
    at, out = Path(root), Result()
    if (at / "config.yaml").exists():
        (at / "config.yaml").rename(at / CONFIG)
        out.actions.append(f"Renamed config.yaml → {CONFIG}")
    raw = yaml.safe_load((at / CONFIG).read_text()) or {}
    types = _node_types(raw.get("node_types"), out)
    _stack(at / "model", raw.get("stack"), raw.get("standards"), out)
    _dump(at / CONFIG, {"version": "2.0.0", "name": raw.get("name"), "node_types": types, "artifacts": ARTIFACTS} | ({"quality": raw["quality"]} if raw.get("quality") else {}))
    out.actions.append("Updated config: version, artifacts, removed stack/standards")
    for folder, old in (("model", "node.yaml"), ("aspects", "aspect.yaml"), ("flows", "flow.yaml")):
        _rename(at / folder, old, out)
    for path in sorted((at / "model").rglob(NODE)):
        _node(path, out)
    for name in ("config", "node", "aspect", "flow"):
        old, new = at / "schemas" / f"{name}.yaml", at / "schemas" / f"yg-{name}.yaml"
        if old.exists() and not new.exists():
            old.rename(new)
            out.actions.append(f"Renamed schemas/{name}.yaml → yg-{name}.yaml")
    state = at / ".drift-state"
    if state.is_file():  # the single file of the old layout; a directory is of this one
        state.unlink()
        out.actions.append("Deleted .drift-state (a full sync is needed)")
    return out


MIGRATIONS = [Migration("2.0.0", "One file per entry, typed node types, structured aspects", to_2_0_0)]
