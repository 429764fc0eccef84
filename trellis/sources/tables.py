"""The graph as a set of DataFrames; every operator takes one and answers for all nodes at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Settings:
    """One project's name and limits; the defaults are fixed values."""

    name: str = ""
    version: str | None = None
    min_artifact_length: int = 50
    max_direct_relations: int = 10
    warning: int = 10_000
    error: int = 20_000


@dataclass
class GraphTables:
    """nodes(path, parent_path, depth, type, blackbox, name, yaml_raw), relations(src, ord, dst, type, consumes, failure,
    event_name), node_aspects(path, aspect, ord, exceptions, anchors), aspects(id, name, description, stability),
    implies(id, ord, implied), flows(flow, name), flow_nodes(flow, node, ord), flow_aspects(flow, aspect, ord),
    artifacts(node, filename, content), aspect_artifacts(aspect, filename, content), flow_artifacts(flow, filename,
    content), artifact_types(filename, ord, required, when, description, included), node_types(type, required_aspects),
    mappings(node, mapping, ord), schemas(schema), node_errors(path, error), without_node(dir, code), settings, and
    config_error where the configuration could not be read.

    Of a projection besides: files(file), anchors(anchor), baseline and current(node, path, hash, category).
    Load order is that of path segments (nodes, aspects) and of names (flows), compared as bytes.
    """

    nodes: DataFrame
    relations: DataFrame
    node_aspects: DataFrame
    aspects: DataFrame
    implies: DataFrame
    flows: DataFrame
    flow_nodes: DataFrame
    flow_aspects: DataFrame
    artifacts: DataFrame
    mappings: DataFrame
    aspect_artifacts: DataFrame | None = None
    flow_artifacts: DataFrame | None = None
    artifact_types: DataFrame | None = None
    node_types: DataFrame | None = None
    schemas: DataFrame | None = None
    node_errors: DataFrame | None = None
    without_node: DataFrame | None = None
    files: DataFrame | None = None
    anchors: DataFrame | None = None
    baseline: DataFrame | None = None
    current: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    config: dict | None = None
    config_error: str | None = None
    root: str = ""
    implied: tuple[DataFrame, DataFrame] | None = None  # implications, and their closure once it is made
