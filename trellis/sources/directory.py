"""Graph tables from a directory of YAML and Markdown files.

One listing of the graph directory by the tree source feeds every table; files are read and YAML is parsed in tasks.
Directories whose names start with '.' are not entered; other names count, whatever they start with.
Unreadable node files become rows of ``node_errors``; one bad aspect or flow file empties its whole table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import Rounds
from .tables import GraphTables, Settings
from .tree import contents, tree

try:
    import yaml
except ImportError:  # only this source needs it
    yaml = None

# File names, relation types, stabilities, conditions and defaults of the format.
NODE, ASPECT, FLOW, CONFIG = "yg-node.yaml", "yg-aspect.yaml", "yg-flow.yaml", "yg-config.yaml"
RELATIONS = ["uses", "calls", "extends", "implements", "emits", "listens"]
STABILITIES = ["schema", "protocol", "implementation"]
WHEN, WHEN_PREFIX = ["has_incoming_relations", "has_outgoing_relations"], ("has_aspect:", "has_tag:")
QUALITY = {"min_artifact_length": 50, "max_direct_relations": 10}
BUDGET = {"warning": 10_000, "error": 20_000}
_DOT = r"(^|/)[.]"  # a path with a directory that is not entered

NODE_COLS = "path string, error string, name string, type string, blackbox boolean, yaml_raw string, aspects array<struct<aspect:string,exceptions:array<string>,anchors:array<string>>>, relations array<struct<ord:long,dst:string,type:string,consumes:array<string>,failure:string,event_name:string>>, mapping array<string>"
ASPECT_COLS = "id string, error string, name string, description string, implies array<string>, stability string"
FLOW_COLS = "flow string, error string, name string, nodes array<string>, aspects array<string>"


def _require(ok, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _mapping(text: str) -> dict:
    if yaml is None:
        raise ImportError("the directory source needs PyYAML")
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not valid YAML: {e}") from e
    _require(isinstance(raw, dict) and raw, "empty or not a YAML mapping")
    return raw


def _text(raw: dict, key: str) -> str:
    value = raw.get(key)
    _require(isinstance(value, str) and value.strip(), f"missing or empty '{key}'")
    return value.strip()


def _strings(values, what: str) -> list[str]:
    _require(isinstance(values, list), f"'{what}' must be an array")
    return [v for v in values if isinstance(v, str)]


def _optional(raw: dict, key: str) -> list[str]:
    """Non-blank strings of a list that may be absent or null."""
    return [v for v in _strings(raw[key], key) if v.strip()] if raw.get(key) is not None else []


def parse_config(text: str) -> dict:
    """name, version, node_types, artifacts and quality with defaults; ValueError if the file breaks the format."""
    raw = _mapping(text)
    out = {"name": _text(raw, "name"), "version": raw["version"].strip() if isinstance(raw.get("version"), str) else None}
    for key in ("node_types", "artifacts"):
        _require(isinstance(raw.get(key), dict) and raw[key], f"'{key}' must be a non-empty object")
    out["node_types"], out["artifacts"] = {}, {}
    for kind, entry in raw["node_types"].items():
        _require(isinstance(entry, dict), f"node_types.{kind} must have a description")
        required = entry.get("required_aspects")
        out["node_types"][str(kind)] = {"description": _text(entry, "description"), "required_aspects": _strings(required, "required_aspects") if isinstance(required, list) else []}
    for name, entry in raw["artifacts"].items():
        _require(name != NODE, f"artifact name '{NODE}' is reserved")
        need = entry.get("required") if isinstance(entry, dict) else None
        when = need.get("when") if isinstance(need, dict) else None
        _require(need in ("always", "never") or when in WHEN or isinstance(when, str) and when.startswith(WHEN_PREFIX), f"artifact '{name}' has an invalid 'required'")
        out["artifacts"][str(name)] = {"required": need if when is None else "when", "when": when, "description": entry.get("description") or "", "included_in_relations": bool(entry.get("included_in_relations"))}
    quality = raw.get("quality") or {}
    given = lambda d, base: {k: base[k] if d.get(k) is None else d[k] for k in base}
    out["quality"] = given(quality, QUALITY) | {"context_budget": given(quality.get("context_budget") or {}, BUDGET)}
    budget = out["quality"]["context_budget"]
    _require(budget["error"] >= budget["warning"], "quality.context_budget.error must be >= warning")
    return out


def parse_node(text: str) -> dict:
    raw = _mapping(text)
    out = {"name": _text(raw, "name"), "type": _text(raw, "type"), "blackbox": raw.get("blackbox") or False, "yaml_raw": text}
    _require(isinstance(out["blackbox"], bool), "'blackbox' must be a boolean")
    listed = raw.get("aspects") if raw.get("aspects") is not None else []
    _require(isinstance(listed, list) and all(isinstance(a, dict) for a in listed), "'aspects' must be an array of objects with 'aspect'")
    out["aspects"] = [{"aspect": _text(a, "aspect"), "exceptions": _optional(a, "exceptions"), "anchors": _optional(a, "anchors")} for a in listed]
    ids = [a["aspect"] for a in out["aspects"]]
    _require(len(ids) == len(set(ids)), "duplicate aspect in 'aspects'")
    edges = raw.get("relations", [])  # null is an error, unlike above
    _require(isinstance(edges, list) and all(isinstance(r, dict) for r in edges), "'relations' must be an array of objects")
    _require(all(r.get("type") in RELATIONS for r in edges), "a relation's type is invalid")
    event = lambda r: r["event_name"].strip() or None if isinstance(r.get("event_name"), str) else None
    out["relations"] = [
        {"ord": i, "dst": _text(r, "target"), "type": r["type"], "consumes": _strings(r["consumes"], "consumes") if isinstance(r.get("consumes"), list) else None, "failure": r["failure"] if isinstance(r.get("failure"), str) else None, "event_name": event(r)}
        for i, r in enumerate(edges)
    ]
    where = raw.get("mapping") if isinstance(raw.get("mapping"), dict) else {}
    out["mapping"] = [p.strip() for p in _strings(where["paths"], "mapping.paths")] if isinstance(where.get("paths"), list) else []
    _require(out["mapping"] or not {"paths", "path", "type"} & set(where), "'mapping' must have a non-empty array 'paths'")
    _require(all(p and not p.startswith("/") for p in out["mapping"]), "mapping paths must be non-empty and relative")
    return out


def parse_aspect(text: str) -> dict:
    raw = _mapping(text)
    _require("stability" not in raw or raw["stability"] in STABILITIES, "'stability' must be one of: " + ", ".join(STABILITIES))
    about = raw.get("description")
    return {"name": _text(raw, "name"), "description": about.strip() if isinstance(about, str) else None, "implies": _strings(raw["implies"], "implies") if "implies" in raw else [], "stability": raw.get("stability")}


def parse_flow(text: str) -> dict:
    raw = _mapping(text)
    nodes = _strings(raw.get("nodes"), "nodes")
    _require(nodes, "'nodes' must hold node paths")
    return {"name": _text(raw, "name"), "nodes": nodes, "aspects": _strings(raw["aspects"], "aspects") if "aspects" in raw else None}


def listing(spark: SparkSession, entries: DataFrame, root: str) -> DataFrame:
    """(dir, filename, content) of the files among ``entries``, which the tree source gave for ``root``."""
    files = entries.where(~F.col("folder") & ~F.col("dir").rlike(_DOT)).select("path", "dir", F.col("name").alias("filename"))
    return contents(spark, root, files.repartition("path")).drop("path")


def _parsed(files: DataFrame, key: str, columns: str, parse) -> DataFrame:
    """One row per file (``key``, content): the parsed columns, or ``error``."""
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def batches(stream):
        for batch in stream:
            rows = []
            for at, data in zip(batch[key].to_pylist(), batch["content"].to_pylist()):
                try:
                    rows.append({key: at, **parse(data.decode("utf-8", "replace"))})
                except ValueError as e:
                    rows.append({key: at, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(key, "content").mapInArrow(batches, columns)


def _below(files: DataFrame, part: str) -> DataFrame:
    """Files under one top directory, with ``dir`` relative to it."""
    return files.where((F.col("dir") == part) | F.col("dir").startswith(part + "/")).withColumn("dir", F.expr(f"substring(dir, {len(part) + 2})"))


def _all_or_none(parsed: DataFrame) -> DataFrame:
    """The rows if none has an error, else no rows."""
    bad = parsed.agg(F.max(F.col("error").isNotNull()).alias("bad"))
    return parsed.crossJoin(F.broadcast(bad)).where("not bad").drop("bad", "error")


def load(spark: SparkSession, root: str, tolerate_invalid_config: bool = False) -> GraphTables:
    """Read a graph directory. ValueError for a bad configuration unless tolerated; then every file is an artifact."""
    # Files are listed and read once, and YAML is parsed once, into written tables.
    rounds = Rounds(spark, "directory")
    entries = rounds.write(tree(spark, root, ["model", "aspects", "flows", "schemas", CONFIG]))
    files = rounds.write(listing(spark, entries, root))
    config, config_error = None, None
    try:
        found = files.where((F.col("dir") == "") & (F.col("filename") == CONFIG)).select("content").first()
        _require(found, f"no {CONFIG}")
        config = parse_config(bytes(found[0]).decode("utf-8", "replace"))
    except ValueError as e:
        if not tolerate_invalid_config:
            raise
        config_error = str(e)

    model = _below(files, "model")
    read = rounds.write(_parsed(model.where(F.col("filename") == NODE).withColumn("path", F.col("dir")), "path", NODE_COLS, parse_node))
    # A node is loaded if every directory above it holds a node that could be read; the model directory itself may hold none.
    parts = F.split("path", "/")
    up = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("")), F.slice(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), 1, F.size(parts) - 1)))
    ok = read.select(F.col("path").alias("above"), F.col("error").isNull().alias("ok"))
    gaps = read.select("path", F.explode(up).alias("above")).join(ok, "above", "left").where(~F.coalesce("ok", F.col("above") == "")).select("path").distinct()
    kept = read.join(gaps, "path", "left_anti")
    top = ok.where("above = '' and ok").select(F.lit("").alias("top"))
    nodes = rounds.write(kept.where("error is null").drop("error"))
    hierarchy = nodes.select("path", "name", "type", "blackbox", "yaml_raw", F.size(parts).cast("long").alias("depth")).join(F.broadcast(top), F.lit(True), "left")
    hierarchy = hierarchy.withColumn("parent_path", F.when(F.col("path") == "", F.lit(None)).when(F.col("depth") == 1, F.col("top")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))).drop("top")
    text = lambda df, key: df.select(F.col("dir").alias(key), "filename", F.decode("content", "UTF-8").alias("content"))
    notes = model.where(F.col("filename") != NODE)
    if config:
        notes = notes.where(F.col("filename").isin(list(config["artifacts"])))

    # A directory without a node is told if it holds files, or if it holds directories that a scan enters.
    inside = entries.where(F.col("path").startswith("model/") & ~F.col("dir").rlike(_DOT)).withColumn("above", F.expr("substring(dir, 7)"))
    held = inside.groupBy("above").agg(F.max(~F.col("folder") & (F.col("name") == NODE)).alias("node"), F.max(~F.col("folder")).alias("file"), F.max(F.col("folder") & ~F.col("name").startswith(".")).alias("sub"))
    without = held.where("above <> '' and not node and (file or sub)").select(F.col("above").alias("dir"), F.when(F.col("file"), "E015").otherwise("W013").alias("code"))

    aspect_files = _below(files, "aspects")
    aspects = rounds.write(_all_or_none(_parsed(aspect_files.where(F.col("filename") == ASPECT).withColumn("id", F.col("dir")), "id", ASPECT_COLS, parse_aspect)))
    flow_files = _below(files, "flows").where("dir <> ''")
    named = flow_files.select(F.split("dir", "/")[0].alias("flow")).distinct()
    definitions = flow_files.where((F.col("filename") == FLOW) & ~F.col("dir").contains("/")).select(F.col("dir").alias("flow"), "content")
    lacking = named.join(definitions, "flow", "left").select("flow", F.coalesce("content", F.lit(b"")).alias("content"))  # an empty file is an error
    flows = rounds.write(_all_or_none(_parsed(lacking, "flow", FLOW_COLS, parse_flow)))
    schemas = _below(files, "schemas").where("dir = '' and filename rlike '[.]ya?ml$'").select(F.regexp_replace(F.regexp_replace("filename", "[.]ya?ml$", ""), "^yg-", "").alias("schema"))
    make = spark.createDataFrame
    kinds = [(name, k, c["required"], c["when"], c["description"], c["included_in_relations"]) for k, (name, c) in enumerate((config or {"artifacts": {}})["artifacts"].items())]
    types = [(name, c["required_aspects"]) for name, c in (config or {"node_types": {}})["node_types"].items()]
    quality = (config or {}).get("quality", {})
    settings = Settings(config["name"], config["version"], quality["min_artifact_length"], quality["max_direct_relations"], **quality["context_budget"]) if config else Settings()
    beside = lambda some, name, key, known: text(some.where(F.col("filename") != name), key).join(known, key, "left_semi")
    return GraphTables(
        nodes=hierarchy, node_errors=kept.where("error is not null").select("path", "error"),
        node_aspects=nodes.select("path", F.posexplode("aspects").alias("ord", "a")).select("path", "ord", "a.aspect", "a.exceptions", "a.anchors"),
        relations=nodes.select(F.col("path").alias("src"), F.inline("relations")), mappings=nodes.select(F.col("path").alias("node"), F.posexplode("mapping").alias("ord", "mapping")),
        artifacts=text(notes, "node").join(nodes.select(F.col("path").alias("node")), "node", "left_semi"),
        aspects=aspects.drop("implies"), implies=aspects.select("id", F.posexplode("implies").alias("ord", "implied")),
        aspect_artifacts=beside(aspect_files, ASPECT, "aspect", aspects.select(F.col("id").alias("aspect"))),
        flows=flows.select("flow", "name"), flow_nodes=flows.select("flow", F.posexplode("nodes").alias("ord", "node")), flow_aspects=flows.select("flow", F.posexplode("aspects").alias("ord", "aspect")),
        flow_artifacts=beside(flow_files, FLOW, "flow", flows.select("flow")), schemas=schemas, without_node=without,
        artifact_types=make(kinds, "filename string, ord int, required string, when string, description string, included boolean"), node_types=make(types, "type string, required_aspects array<string>"),
        settings=settings, config=config, config_error=config_error, root=root,
    )
