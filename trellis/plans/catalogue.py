"""Registered queries over the star-schema projection, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import functions as F

from ..operators import aspects, closure, context, drift, impact, rules
from ..sources.star import from_star_schema

C = F.col

# The projection as common table expressions, named like the graph tables.
CTES = {
    "npath": "SELECT n_nationkey, 'r'||n_regionkey||'/n'||n_nationkey AS npath FROM nation",
    "parts": "SELECT p_partkey, p_size, 'lib/'||replace(p_brand,'#','-')||'/p'||p_partkey AS path, 'lib/'||replace(p_brand,'#','-') AS module FROM part",
    "s_path": "SELECT s_suppkey, s_acctbal, npath||'/s'||s_suppkey AS path, npath FROM supplier JOIN npath ON s_nationkey = n_nationkey",
    "c_path": "SELECT c_custkey, c_mktsegment, npath||'/c'||c_custkey AS path, npath FROM customer JOIN npath ON c_nationkey = n_nationkey",
    "nodes0": "SELECT 'r'||r_regionkey AS path, NULL::VARCHAR AS parent_path, 'module' AS type, false AS blackbox FROM region UNION ALL SELECT 'r'||n_regionkey||'/n'||n_nationkey, 'r'||n_regionkey, 'module', false FROM nation UNION ALL SELECT 'lib', NULL, 'module', false UNION ALL SELECT DISTINCT module, 'lib', 'module', false FROM parts UNION ALL SELECT path, npath, 'service', s_acctbal < 0 FROM s_path UNION ALL SELECT path, npath, 'service', false FROM c_path UNION ALL SELECT path, module, 'library', false FROM parts",
    "nodes": "SELECT *, len(string_split(path,'/'))::BIGINT AS depth, string_split(path,'/')[-1] AS name FROM nodes0",
    "deep": "SELECT a.path AS src, 0 AS ord, b.path AS dst, 'extends' AS type, NULL::VARCHAR AS consumes, NULL::VARCHAR AS failure, NULL::VARCHAR AS event_name FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey // 2 WHERE a.p_partkey >= 1 UNION ALL SELECT a.path, 1, b.path, 'uses', NULL, CASE WHEN a.p_partkey % 5 = 0 THEN 'use the last known part' END, NULL FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey // 3 WHERE a.p_partkey >= 1",
    "wide": "SELECT s.path AS src, 2 + p_partkey AS ord, p.path AS dst, 'calls' AS type, consumes, NULL::VARCHAR AS failure, NULL::VARCHAR AS event_name FROM (SELECT l_suppkey, l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS consumes FROM lineitem GROUP BY 1, 2) JOIN s_path s ON l_suppkey = s_suppkey JOIN parts p ON l_partkey = p_partkey",
    "ev": "SELECT DISTINCT CASE WHEN event_type = 'purchase' THEN c.path ELSE p.path END AS src, 0 AS ord, CASE WHEN event_type = 'purchase' THEN p.path ELSE c.path END AS dst, CASE WHEN event_type = 'purchase' THEN 'emits' ELSE 'listens' END AS type, NULL::VARCHAR AS consumes, NULL::VARCHAR AS failure, CASE WHEN event_type = 'purchase' THEN 'Purchase' END AS event_name FROM events JOIN parts p ON p_partkey = event_id % 50 JOIN c_path c ON c_custkey = user_id WHERE event_type IN ('purchase', 'view')",
    "relations": "SELECT * FROM deep UNION ALL SELECT * FROM wide UNION ALL SELECT * FROM ev",
    "prio": "SELECT DISTINCT o_custkey, substr(o_orderpriority, 1, 1) AS p FROM orders",
    "node_aspects": "SELECT path, 'size/'||p_size AS aspect FROM parts UNION ALL SELECT DISTINCT module, 'brand/'||substr(module, 5) FROM parts UNION ALL SELECT path, 'seg/'||c_mktsegment FROM c_path",
    "aspects": "SELECT 'size/'||i AS id FROM range(1, 51) t(i) UNION ALL SELECT DISTINCT 'brand/'||substr(module, 5) FROM parts UNION ALL SELECT DISTINCT 'prio/'||p FROM prio UNION ALL SELECT DISTINCT 'seg/'||c_mktsegment FROM customer",
    "implies": "SELECT 'size/'||i AS id, 'size/'||(i // 2) AS implied FROM range(2, 51) t(i)",
    "flow_nodes": "SELECT 'prio-'||p AS flow, path AS node FROM prio JOIN c_path ON o_custkey = c_custkey WHERE o_custkey % 10 = 0 UNION ALL SELECT 'tour', npath FROM npath WHERE n_nationkey = 0",
    "flow_aspects": "SELECT DISTINCT 'prio-'||p AS flow, 'prio/'||p AS aspect FROM prio UNION ALL SELECT 'tour', 'size/8'",
    "owner": "SELECT path AS node, doc_id, text, source, CASE doc_id % 3 WHEN 0 THEN 'responsibility.md' WHEN 1 THEN 'interface.md' ELSE 'internals.md' END AS filename FROM documents JOIN parts ON p_partkey = doc_id // 3",
    "files": "SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file FROM pages",
    "mappings": "SELECT DISTINCT 'web/'||split_part(file,'/',1) AS node, split_part(file,'/',1) AS mapping FROM files UNION ALL SELECT DISTINCT 'web/'||split_part(file,'/',1)||'/'||split_part(file,'/',2), split_part(file,'/',1)||'/'||split_part(file,'/',2) FROM files",
    "state": "SELECT node, 'd'||lpad(doc_id::VARCHAR, 12, '0') AS path, doc_id, text, CASE WHEN source = 'src0' THEN 'graph' ELSE 'source' END AS category FROM owner",
    "baseline": "SELECT node, path, sha256(text) AS hash, category FROM state WHERE doc_id % 13 <> 5",
    "curr": "SELECT node, path, sha256(CASE WHEN doc_id % 7 = 0 THEN text||'!' ELSE text END) AS hash, category FROM state WHERE doc_id % 11 <> 3",
    "anc": "SELECT path AS node, array_to_string(string_split(path,'/')[1:i], '/') AS ancestor, (depth - i)::BIGINT AS distance FROM nodes, range(1, 5) t(i) WHERE i < depth",
    "impl": "SELECT id AS aspect, implied, 1 AS depth FROM implies UNION ALL SELECT impl.aspect, i.implied, impl.depth + 1 FROM impl JOIN implies i ON impl.implied = i.id",
    "member": "SELECT DISTINCT node, flow FROM (SELECT node, flow FROM flow_nodes UNION ALL SELECT anc.node, flow FROM anc JOIN flow_nodes f ON f.node = anc.ancestor)",
    "src": "SELECT path AS node, aspect, 0 AS prio, '0' AS rank, 'own' AS source FROM node_aspects UNION ALL SELECT node, aspect, 1, lpad(distance::VARCHAR, 6, '0'), 'hierarchy '||ancestor FROM anc JOIN node_aspects ON path = ancestor UNION ALL SELECT node, aspect, 2, member.flow, 'flow '||member.flow FROM member JOIN flow_aspects a ON a.flow = member.flow",
    "eff": "SELECT DISTINCT node, aspect FROM (SELECT node, aspect FROM src UNION ALL SELECT node, implied FROM src JOIN impl ON src.aspect = impl.aspect)",
    "cfg": "SELECT * FROM (VALUES ('responsibility.md', 0, true), ('interface.md', 1, true), ('internals.md', 2, false)) t(filename, ord, inc)",
    "art": "SELECT o.node, o.filename, ord, inc, 5 + length(o.filename) + length(coalesce(text, '')) AS u, '### '||o.filename||chr(10)||coalesce(text, '') AS block, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\\s\\x0b]+$', '')) + CASE WHEN regexp_replace(coalesce(text, ''), '[\\s\\x0b]+$', '') = '' THEN 1 ELSE 0 END AS t FROM owner o JOIN cfg ON cfg.filename = o.filename",
    "own_units": "SELECT node, sum(u) + 2 * (count(*) - 1) AS all_u, sum(u) + 2 * count(*) AS own_u, CASE WHEN count(*) FILTER (inc) > 0 THEN sum(u) FILTER (inc) + 2 * (count(*) FILTER (inc) - 1) - arg_max(t, ord) FILTER (inc) ELSE sum(u) + 2 * (count(*) - 1) - arg_max(t, filename) END AS rel_u, string_agg(block, chr(10)||chr(10) ORDER BY filename) AS all_t, string_agg(block, chr(10)||chr(10) ORDER BY ord) FILTER (inc) AS inc_t FROM art GROUP BY 1",
    "asp": "SELECT id, 'Aspect '||id AS name, CASE WHEN id LIKE 'size/%' THEN ['schema', 'protocol', 'implementation'][substr(id, 6)::INT % 3 + 1] END AS tier, '### content.md'||chr(10)||'Rule of '||id||'.'||chr(10)||CASE WHEN id LIKE 'size/%0' THEN chr(10)||chr(10)||'### notes.md'||chr(10)||'Notes on '||id ELSE '' END AS t FROM aspects",
    "asp_t": "SELECT id, name, t || coalesce(chr(10)||'**Stability tier:** '||tier, '') AS t FROM asp",
    "note": "SELECT path AS node, aspect, chr(10)||chr(10)||'⚠ **Exception for this node:** old packaging; samples' AS note FROM node_aspects WHERE aspect LIKE 'size/%' AND path LIKE '%0'",
    "flow_t": "SELECT DISTINCT flow, CASE WHEN flow = 'tour' THEN '(no artifacts)' ELSE '### description.md'||chr(10)||'Steps of '||flow||'.'||chr(10) END AS t FROM flow_aspects",
    "rels": "SELECT r.*, n.name AS dst_name, CASE WHEN consumes <> '' THEN 'Consumes: '||replace(consumes, ',', ', ')||chr(10)||chr(10) ELSE '' END || CASE WHEN failure <> '' THEN 'On failure: '||failure||chr(10)||chr(10) ELSE '' END AS pre, CASE r.type WHEN 'emits' THEN 'Target: '||dst||chr(10)||'You publish ' ELSE 'Source: '||dst||chr(10)||'You listen for ' END || coalesce(event_name, n.name) || '.' AS said FROM relations r JOIN nodes n ON n.path = r.dst WHERE NOT EXISTS (SELECT 1 FROM anc WHERE anc.node = r.src AND ancestor = r.dst)",
    "layers": "SELECT path AS node, 'global' AS layer_type, 18::BIGINT AS units FROM nodes UNION ALL SELECT path, 'own', 17 + length('name: '||name||chr(10)||'type: '||type) + coalesce(own_u, 0) FROM nodes LEFT JOIN own_units ON node = path UNION ALL SELECT anc.node, 'hierarchy', coalesce(all_u, 0) FROM anc LEFT JOIN own_units o ON o.node = ancestor UNION ALL SELECT src, 'relational', CASE WHEN rel_u IS NULL THEN length(rtrim(pre, chr(10))) ELSE length(pre) + rel_u END FROM rels LEFT JOIN own_units ON node = dst WHERE type IN ('uses', 'calls', 'extends', 'implements') UNION ALL SELECT src, 'relational', length(said) FROM rels WHERE type IN ('emits', 'listens') UNION ALL SELECT node, 'flows', length(t) FROM member JOIN flow_t ON flow_t.flow = member.flow UNION ALL SELECT eff.node, 'aspects', length(t) + coalesce(length(note), 0) FROM eff JOIN asp_t ON id = eff.aspect LEFT JOIN note ON note.node = eff.node AND note.aspect = eff.aspect",
    "budget": "SELECT node, tokens, CASE WHEN tokens >= 20000 THEN 'error' WHEN tokens >= 10000 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT node, ceil((sum(units) + 2 * (count(*) - 1)) / 4.0)::BIGINT AS tokens FROM layers GROUP BY 1)",
    "dfiles": "SELECT coalesce(b.node, c.node) AS node, coalesce(b.path, c.path) AS path, CASE WHEN b.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'deleted' ELSE 'changed' END AS change, coalesce(c.category, b.category) AS category FROM baseline b FULL OUTER JOIN curr c ON b.node = c.node AND b.path = c.path WHERE b.hash IS DISTINCT FROM c.hash",
    "dstatus": "SELECT n.node, CASE WHEN b.node IS NULL THEN CASE WHEN c.node IS NULL THEN 'unmaterialized' ELSE 'source-drift' END WHEN c.node IS NULL THEN 'missing' WHEN d.node IS NULL THEN 'ok' WHEN d.g AND d.s THEN 'full-drift' WHEN d.g THEN 'graph-drift' ELSE 'source-drift' END AS status FROM (SELECT path AS node FROM parts) n LEFT JOIN (SELECT DISTINCT node FROM baseline) b ON b.node = n.node LEFT JOIN (SELECT DISTINCT node FROM curr) c ON c.node = n.node LEFT JOIN (SELECT node, bool_or(category = 'graph') AS g, bool_or(category = 'source') AS s FROM dfiles GROUP BY 1) d ON d.node = n.node",
    "node_ok": "SELECT path FROM nodes EXCEPT SELECT path FROM parts WHERE p_partkey % 97 = 13",
    "aspect_ok": "SELECT id FROM aspects WHERE id <> 'prio/5' AND NOT (id LIKE 'size/%' AND coalesce(try_cast(substr(id, 6) AS INT) % 7, 1) = 0)",
    "direct": "SELECT dst AS target, src AS dependent, arg_max(type, ord) AS type, coalesce(arg_max(coalesce(consumes, ''), ord), '') AS consumes FROM relations WHERE type IN ('uses', 'calls', 'extends', 'implements') GROUP BY 1, 2",
    "links": "SELECT * FROM deep UNION ALL SELECT * FROM wide",
    "up": "SELECT DISTINCT dst AS target, src AS node FROM links UNION SELECT up.target, d.src FROM up JOIN links d ON d.dst = up.node",
}


def _need(sql: str, found: dict[str, str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            found[name] = body
            _need(body, found)


def _sql(query: str) -> str:
    """The query with the expressions it uses, in the order of CTES."""
    found: dict[str, str] = {}
    _need(query, found)
    with_ = ", ".join(f"{k} AS ({CTES[k]})" for k in CTES if k in found)
    return f"WITH RECURSIVE {with_} {query}" if with_ else query


def _nodes_ok(spark, d, g):
    gone = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 97 = 13").select(F.concat(F.lit("lib/"), F.regexp_replace("p_brand", "#", "-"), F.lit("/p"), C("p_partkey").cast("string")).alias("path"))
    return g.nodes.select("path", "parent_path").join(gone, "path", "left_anti")


def _aspects_ok(g):
    return g.aspects.where("id <> 'prio/5' and not (id like 'size/%' and cast(substring(id, 6) as int) % 7 = 0)")


def _star(f):
    """A query (spark, sf_dir) from a function of the graph, or of (graph, spark, sf_dir)."""
    def run(spark, sf_dir):
        g = from_star_schema(spark, sf_dir)
        return f(g, spark, sf_dir) if f.__code__.co_argcount == 3 else f(g)

    return run


def _mapped(g):
    """Every part is mapped: those without a document in either snapshot were never made."""
    return g.nodes.where("type = 'library'").select(C("path").alias("node"))


def _stages(g):
    """Stages of the nodes that may be built, services with libraries; blackboxes are no candidates."""
    candidates = g.nodes.where("type in ('library', 'service') and not blackbox").select(C("path").alias("node"))
    return closure.stages(candidates, closure.structural(g.relations))


def _cycle_edges(spark):
    return spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("a", "b"), ("b", "a"), ("s", "s"), ("q", "x")], "src string, dst string")


_BOXED = "SELECT * FROM (SELECT src, dst FROM links UNION SELECT * FROM (VALUES ('x','y'),('y','z'),('z','x'),('a','b'),('b','a'),('s','s'),('q','x')) e(src, dst)) WHERE src <> 'b' AND dst <> 'b' AND src NOT IN (SELECT path FROM nodes WHERE blackbox)"

_ALL = {
    "context_budget": (lambda g: context.budget(g), "SELECT node, tokens, status FROM budget"),
    "context_layers": (lambda g: context.layer_sums(g), "SELECT node, layer_type, count(*) AS n_layers, sum(units)::BIGINT AS units FROM layers GROUP BY 1, 2"),
    "hierarchy_closure": (lambda g: closure.ancestors(g.nodes), "SELECT node, ancestor, distance FROM anc"),
    "descendant_counts": (lambda g: closure.ancestors(g.nodes).groupBy(C("ancestor").alias("node")).agg(F.count("*").alias("n")), "SELECT ancestor AS node, count(*) AS n FROM anc GROUP BY 1"),
    "tree_depth_limited": (lambda g: g.nodes.where("depth <= 2").select(C("path").alias("node"), "depth"), "SELECT path AS node, depth FROM nodes WHERE depth <= 2"),
    "deps_tree_depth3": (lambda g: closure.dependency_paths(closure.structural(g.relations), 3), "SELECT src AS root, src||' > '||dst AS path, dst AS node, 1::BIGINT AS depth FROM links UNION ALL SELECT a.src, a.src||' > '||a.dst||' > '||b.dst, b.dst, 2 FROM links a JOIN links b ON a.dst = b.src AND b.dst <> a.src AND b.dst <> a.dst UNION ALL SELECT a.src, a.src||' > '||a.dst||' > '||b.dst||' > '||c.dst, c.dst, 3 FROM links a JOIN links b ON a.dst = b.src AND b.dst <> a.src AND b.dst <> a.dst JOIN links c ON b.dst = c.src AND c.dst NOT IN (a.src, a.dst, b.dst)"),
    "deps_transitive": (lambda g: closure.reach(closure.structural(g.relations)).select("root", "node", C("depth").alias("min_depth")), "SELECT root, node, min(d)::BIGINT AS min_depth FROM r GROUP BY 1, 2"),
    "deps_stages": (_stages, "SELECT path AS node, coalesce(max(d) + 1, 1)::BIGINT AS stage FROM nodes LEFT JOIN r ON root = path WHERE type IN ('library', 'service') AND NOT blackbox GROUP BY 1"),
    "impact_direct": (lambda g: impact.direct(g), "SELECT target, dependent, type, consumes FROM direct"),
    "impact_transitive": (lambda g: impact.dependents(closure.structural(g.relations)), "SELECT target, (SELECT count(DISTINCT src) FROM links WHERE dst = target) AS n_direct, count(*) AS n_total FROM up GROUP BY 1"),
    "impact_method": (lambda g: impact.by_methods(g), "SELECT target, method, count(*) AS n_direct FROM direct JOIN (SELECT DISTINCT unnest(string_split(consumes, ',')) AS method FROM direct WHERE consumes <> '') ON consumes = '' OR list_contains(string_split(consumes, ','), method) GROUP BY 1, 2"),
    "impact_chains": (lambda g: impact.chains(closure.structural(g.relations), g.nodes.where("path like 'lib/%/p3'").select(C("path").alias("target"))), "SELECT target, '<- '||replace(array_to_string(p, ' <- '), chr(1), '/') AS chain FROM walk WHERE len(p) > 1"),
    "impact_events": (lambda g: impact.events(g), "SELECT dst AS target, src AS node, ev.type, coalesce(event_name, name) AS event FROM ev JOIN nodes ON path = src UNION ALL SELECT a.src, b.src, b.type, coalesce(b.event_name, a.event_name, a.dst) FROM ev a JOIN ev b ON a.dst = b.dst AND a.type = 'emits' AND b.type = 'listens' AND a.src <> b.src"),
    "effective_aspects": (lambda g: aspects.effective(g), "SELECT node, aspect FROM eff"),
    "aspect_provenance": (lambda g: aspects.provenance(g), "SELECT node, aspect, arg_min(source, (prio, rank, source)) AS source FROM (SELECT * FROM src UNION ALL SELECT node, implied, 3, '', 'implied' FROM src JOIN impl ON src.aspect = impl.aspect) GROUP BY 1, 2"),
    "aspect_impact_counts": (lambda g: aspects.effective(g).groupBy("aspect").agg(F.count("*").alias("n_nodes")).join(g.flow_aspects.groupBy("aspect").agg(F.count("*").alias("n")), "aspect", "left").select("aspect", "n_nodes", F.coalesce("n", F.lit(0)).cast("long").alias("n_flows")), "SELECT aspect, count(*) AS n_nodes, (SELECT count(*) FROM flow_aspects f WHERE f.aspect = eff.aspect) AS n_flows FROM eff GROUP BY 1"),
    "implies_closure": (lambda g: aspects.implies_closure(g).select("aspect", "implied", C("depth").alias("pos")), "SELECT aspect, implied, depth::BIGINT AS pos FROM impl"),
    "flow_participants": (lambda g: impact.flow_scope(g), "SELECT flow, node, (flow, node) IN (SELECT (flow, node) FROM flow_nodes) AS declared FROM member"),
    "status_coverage": (lambda g: aspects.effective(g).agg(F.countDistinct("node").alias("covered")).crossJoin(g.nodes.agg(F.count("*").alias("nodes"))).crossJoin(g.relations.agg(F.count("*").alias("r"))).crossJoin(g.mappings.agg(F.countDistinct("node").alias("mapped"), F.count("*").alias("mapped_paths"))).select("nodes", "covered", "mapped", "mapped_paths", F.floor(C("r") * 10 / C("nodes") + 0.5).cast("long").alias("avg_relations_x10")), "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT node) FROM eff) AS covered, (SELECT count(DISTINCT node) FROM mappings) AS mapped, (SELECT count(*) FROM mappings) AS mapped_paths, floor((SELECT count(*) FROM relations) * 10.0 / (SELECT count(*) FROM nodes) + 0.5)::BIGINT AS avg_relations_x10"),
    "co_aspect_pairs": (lambda g, spark, d: impact.co_aspect(aspects.effective(g), "lib/Brand-11"), "SELECT 'lib/Brand-11' AS a, node AS b, count(*) AS n_shared, string_agg(aspect, ', ' ORDER BY aspect) AS shared FROM eff WHERE node <> 'lib/Brand-11' AND aspect IN (SELECT aspect FROM eff WHERE node = 'lib/Brand-11') GROUP BY 2"),
    "v_unknown_type": (lambda g: rules.unknown_type(g, ["module", "service"]), "SELECT path AS node, type FROM nodes WHERE type NOT IN ('module', 'service')"),
    "v_unknown_aspect": (lambda g: rules.unknown_aspect(g, _aspects_ok(g)), "SELECT path AS node, aspect FROM node_aspects WHERE aspect NOT IN (SELECT id FROM aspect_ok)"),
    "v_broken_relation": (lambda g, spark, d: rules.broken_relation(g, _nodes_ok(spark, d, g)), "SELECT DISTINCT src AS node, dst AS target, regexp_replace(dst, '/[^/]*$', '') AS suggestion FROM relations WHERE dst NOT IN (SELECT path FROM node_ok)"),
    "v_broken_siblings": (lambda g, spark, d: rules.siblings(rules.broken_relation(g, _nodes_ok(spark, d, g)), _nodes_ok(spark, d, g)), "SELECT target, count(*) AS n_siblings, string_agg(name, ', ' ORDER BY name) AS siblings FROM (SELECT DISTINCT dst AS target FROM relations WHERE dst NOT IN (SELECT path FROM node_ok)) JOIN (SELECT n.* FROM nodes n JOIN node_ok k ON k.path = n.path) n ON n.parent_path = regexp_replace(target, '/[^/]*$', '') GROUP BY 1"),
    "v_broken_flow_ref": (lambda g, spark, d: rules.broken_flow_ref(g, g.nodes.where("path not like '%0'")), "SELECT flow, node FROM flow_nodes WHERE node NOT IN (SELECT path FROM nodes WHERE path NOT LIKE '%0')"),
    "v_broken_flow_aspect": (lambda g: rules.broken_flow_aspect(g, _aspects_ok(g)), "SELECT flow, aspect FROM flow_aspects WHERE aspect NOT IN (SELECT id FROM aspect_ok)"),
    "v_implied_missing": (lambda g: rules.implied_missing(g, _aspects_ok(g)), "SELECT id AS aspect, implied FROM implies WHERE implied NOT IN (SELECT id FROM aspect_ok)"),
    "v_structural_cycle": (lambda g, spark, d: rules.structural_cycle(closure.structural(g.relations).select("src", "dst").unionAll(_cycle_edges(spark)), g.nodes.where("blackbox").select(C("path").alias("node")).unionAll(spark.createDataFrame([("b",)], "node string"))), "SELECT DISTINCT root AS node FROM cyc WHERE root = node"),
    "v_missing_artifact": (lambda g, spark, d: rules.missing_artifact(g, g.artifact_types.select("filename", "required", "when").unionAll(spark.createDataFrame(_MORE_TYPES, "filename string, required string, when string"))), "SELECT node, artifact, kind AS reason_kind, n FROM (SELECT path AS node, 'responsibility.md' AS artifact, 'always' AS kind, 1::BIGINT AS n FROM nodes WHERE NOT blackbox UNION ALL SELECT dst, 'interface.md', 'incoming', count(*) FROM relations GROUP BY 1 UNION ALL SELECT src, 'plan.md', 'outgoing', count(*) FROM relations GROUP BY 1 UNION ALL SELECT DISTINCT path, 'audit.md', 'aspect', 1::BIGINT FROM node_aspects WHERE aspect = 'size/7') w WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE o.node = w.node AND o.filename = w.artifact)"),
    "v_incoming_sources": (lambda g: rules.first_sources(g), "SELECT dst AS node, count(DISTINCT src) AS n_sources, array_to_string(list_sort(list_distinct(list(src)))[1:5], ', ') AS sources FROM relations GROUP BY 1"),
    "v_shallow": (lambda g: rules.shallow(g), "SELECT node, filename AS artifact, length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))::BIGINT AS n FROM owner WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 50"),
    "v_budget": (lambda g: rules.over_budget(g), "SELECT node, CASE WHEN status = 'error' THEN 'W006' ELSE 'W005' END AS code FROM budget JOIN nodes ON path = node WHERE status <> 'ok' AND NOT blackbox"),
    "v_fanout": (lambda g: rules.fan_out(g), "SELECT src AS node, count(*) AS n FROM relations GROUP BY 1 HAVING count(*) > 10"),
    "v_unpaired_event": (lambda g: rules.unpaired_event(g), "SELECT src AS node, dst AS other, type AS direction FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.src = a.dst AND b.dst = a.src AND b.type <> a.type)"),
    "v_required_aspect": (lambda g: rules.required_aspect(g), "SELECT path AS node, need.a AS aspect FROM nodes, (VALUES ('size/1'), ('size/3')) need(a) WHERE type = 'library' AND NOT blackbox AND NOT EXISTS (SELECT 1 FROM node_aspects n LEFT JOIN impl ON impl.aspect = n.aspect WHERE n.path = nodes.path AND (n.aspect = need.a OR implied = need.a))"),
    "v_overlap": (lambda g: rules.overlapping(g.mappings.select("node", "mapping").unionAll(g.mappings.where("mapping like '%/en'").select(F.lit("zz").alias("node"), "mapping"))), "SELECT a.mapping AS mapping_a, b.mapping AS mapping_b, CASE WHEN replace(a.node, '/', chr(1)) < replace(b.node, '/', chr(1)) THEN b.node ELSE a.node END AS blamed FROM claims a JOIN claims b ON a.node <> b.node AND ((a.mapping = b.mapping AND replace(a.node, '/', chr(1)) < replace(b.node, '/', chr(1))) OR (starts_with(a.mapping, b.mapping||'/') AND NOT starts_with(a.node, b.node||'/') AND NOT starts_with(b.node, a.node||'/')))"),
    "v_anchor_missing": (lambda g: rules.anchors_missing(g), "SELECT DISTINCT substr(b.text, 1, 60) AS anchor FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE contains(o.text, substr(b.text, 1, 60)))"),
    "v_anchor_not_found": (lambda g: rules.anchor_not_found(g, g.artifacts), "SELECT node, aspect, anchor FROM (SELECT o.node, 'size/'||p_size AS aspect, substr(text, 5, 20)||CASE WHEN doc_id % 3 = 1 THEN '~' ELSE '' END AS anchor FROM owner o JOIN parts ON path = o.node WHERE text IS NOT NULL) w WHERE NOT EXISTS (SELECT 1 FROM owner o WHERE o.node = w.node AND contains(o.text, anchor)) GROUP BY 1, 2, 3"),
    "owner_of_file": (lambda g: drift.owners(g), "SELECT file, node, mapping, mapping = file AS direct FROM (SELECT file, m.node, m.mapping, row_number() OVER (PARTITION BY file ORDER BY length(m.mapping) DESC, replace(m.node, '/', chr(1))) AS k FROM files JOIN mappings m ON file = m.mapping OR starts_with(file, m.mapping||'/')) WHERE k = 1"),
    "drift_files": (lambda g: drift.files(g), "SELECT node, path, change, category FROM dfiles"),
    "drift_status": (lambda g: drift.status(g, _mapped(g)), "SELECT node, status FROM dstatus"),
    "drift_counts": (lambda g: drift.status(g, _mapped(g)).groupBy("status").agg(F.count("*").alias("n")), "SELECT status, count(*) AS n FROM dstatus GROUP BY 1"),
    "drift_sections_topn": (lambda g: drift.sections(drift.status(g, _mapped(g)), 10), "SELECT section, node, rn, total FROM (SELECT section, node, row_number() OVER (PARTITION BY section ORDER BY node) AS rn, count(*) OVER (PARTITION BY section) AS total FROM (SELECT 'source' AS section, node FROM dstatus WHERE status IN ('source-drift', 'full-drift', 'missing', 'unmaterialized') UNION ALL SELECT 'graph', node FROM dstatus WHERE status IN ('graph-drift', 'full-drift'))) WHERE rn <= 10"),
    "canonical_digest": (lambda g: drift.digest(g.current), "SELECT node, sha256(string_agg(path||':'||hash, chr(10) ORDER BY path)) AS digest FROM curr GROUP BY 1"),
    "state_gc": (lambda g, spark, d: drift.garbage(g, _nodes_ok(spark, d, g)), "SELECT DISTINCT node FROM baseline WHERE node NOT IN (SELECT path FROM node_ok)"),
    "tracked_files": (lambda g: drift.tracked(g), "SELECT node, path, min(category) AS category FROM trk GROUP BY 1, 2"),
    "child_exclusions": (lambda g: drift.exclusions(g), "SELECT DISTINCT a.node, b.mapping AS prefix FROM mappings a JOIN mappings b ON starts_with(b.node, a.node||'/') AND (b.mapping = a.mapping OR starts_with(b.mapping, a.mapping||'/'))"),
    "status_nodes": (lambda g: g.nodes.groupBy("type").agg(F.count("*").alias("n"), F.sum(C("blackbox").cast("long")).alias("n_blackbox")), "SELECT type, count(*) AS n, sum(blackbox::INT)::BIGINT AS n_blackbox FROM nodes GROUP BY 1"),
    "status_relations": (lambda g: g.relations.groupBy(F.when(C("type").isin(closure.STRUCTURAL), "structural").otherwise("event").alias("class")).agg(F.count("*").alias("n")), "SELECT CASE WHEN type IN ('uses', 'calls', 'extends', 'implements') THEN 'structural' ELSE 'event' END AS class, count(*) AS n FROM relations GROUP BY 1"),
    "status_quality": (lambda g, spark, d: g.artifacts.agg(F.count("*").alias("filled")).crossJoin(g.nodes.agg((F.count("*") * 3).alias("slots"))).select("filled", "slots", F.floor(C("filled") * 100 / C("slots") + 0.5).cast("long").alias("percent")), "SELECT filled, slots, floor(filled * 100.0 / slots + 0.5)::BIGINT AS percent FROM (SELECT count(*) AS filled FROM owner), (SELECT count(*) * 3 AS slots FROM nodes)"),
    "fanout_argmax": (lambda g: g.relations.groupBy("src").agg(F.count("*").alias("n")).agg(F.min(F.struct((-C("n")).alias("k"), "src")).alias("b")).select(C("b.src").alias("node"), (-C("b.k")).alias("n")), "SELECT src AS node, count(*) AS n FROM relations GROUP BY 1 ORDER BY n DESC, node LIMIT 1"),
}
_MORE_TYPES = [("plan.md", "when", "has_outgoing_relations"), ("audit.md", "when", "has_aspect:size/7"), ("old.md", "when", "has_tag:gone")]
_CONDITIONS = [("responsibility.md", "always"), ("audit.md", "has_aspect:size/7"), ("plan.md", "has_aspect:size/3"), ("old.md", "has_tag:gone")]
_ALL |= {
    "deps_changed_expand": (lambda g: impact.changed(g, drift.files(g).select(F.concat_ws("/", "node", "path").alias("path"))), "SELECT DISTINCT node, 'changed' AS reason FROM dfiles UNION ALL SELECT DISTINCT src, 'dependent' FROM relations WHERE type IN ('uses', 'calls', 'extends', 'implements') AND dst IN (SELECT node FROM dfiles) AND src NOT IN (SELECT node FROM dfiles)"),
    "impact_scope_total": (lambda g: impact.scope_total(g, closure.structural(g.relations)), "SELECT path AS target, coalesce(n, 0) AS n_nodes, coalesce(f, 0) AS n_flows, coalesce(e, 0) AS n_aspects FROM nodes LEFT JOIN (SELECT target, count(*) AS n FROM (SELECT target, node FROM up UNION SELECT ancestor, node FROM anc UNION SELECT dst, src FROM ev UNION SELECT a.src, b.src FROM ev a JOIN ev b ON a.dst = b.dst AND a.type = 'emits' AND b.type = 'listens' AND a.src <> b.src) GROUP BY 1) a ON a.target = path LEFT JOIN (SELECT node, count(DISTINCT flow) AS f FROM flow_nodes GROUP BY 1) b ON b.node = path LEFT JOIN (SELECT node, count(*) AS e FROM eff GROUP BY 1) c ON c.node = path"),
    "v_bad_condition": (lambda g, spark, d: rules.bad_condition(spark.createDataFrame(_CONDITIONS, "artifact string, condition string"), _aspects_ok(g)), "SELECT artifact, split_part(c, ':', 2) AS aspect FROM (VALUES ('responsibility.md', 'always'), ('audit.md', 'has_aspect:size/7'), ('plan.md', 'has_aspect:size/3'), ('old.md', 'has_tag:gone')) t(artifact, c) WHERE c LIKE 'has_%:%' AND split_part(c, ':', 2) NOT IN (SELECT id FROM aspect_ok)"),
    "v_duplicate_aspect": (lambda g: rules.duplicate_aspect(g.aspects.unionAll(g.aspects.where("id like 'seg/%'"))), "SELECT id, count(*) AS n FROM (SELECT id FROM aspects UNION ALL SELECT id FROM aspects WHERE id LIKE 'seg/%') GROUP BY 1 HAVING count(*) > 1"),
    "v_implies_cycle": (lambda g, spark, d: rules.implies_cycle(g.implies.select("id", "implied").unionAll(spark.createDataFrame([("size/3", "size/50")], "id string, implied string"))), "SELECT DISTINCT root AS aspect FROM icyc WHERE root = node"),
    "v_missing_schema": (
        lambda g: rules.missing_schema(g.artifacts.select(F.regexp_replace("filename", r"\.md$", "").alias("schema")), ("interface", "internals", "notes")),
        "SELECT schema FROM (VALUES ('interface'), ('internals'), ('notes')) t(schema) WHERE schema NOT IN (SELECT regexp_replace(filename, '\\.md$', '') FROM owner)",
    ),
    "v_mapping_missing": (lambda g: rules.mapping_missing(g.mappings, g.files.where("file not like '%/en/%'")), "SELECT node, mapping FROM mappings WHERE NOT EXISTS (SELECT 1 FROM files WHERE file NOT LIKE '%/en/%' AND (file = mapping OR starts_with(file, mapping||'/')))"),
}
CTES["r"] = "SELECT src AS root, dst AS node, 1 AS d FROM links UNION SELECT r.root, e.dst, r.d + 1 FROM r JOIN links e ON e.src = r.node"
CTES["back0"] = "SELECT dst AS root, src AS node, 1 AS d FROM links WHERE dst LIKE 'lib/%/p3' UNION SELECT b.root, e.src, b.d + 1 FROM back0 b JOIN links e ON e.dst = b.node"
CTES["back"] = "SELECT root, node, min(d) AS d FROM back0 WHERE root <> node GROUP BY 1, 2"
CTES["walk"] = "SELECT dst AS target, src AS node, [replace(src, '/', chr(1))] AS p FROM (SELECT DISTINCT src, dst FROM links WHERE dst LIKE 'lib/%/p3' AND src <> dst) UNION ALL SELECT w.target, e.src, list_append(min(w.p), replace(e.src, '/', chr(1))) FROM walk w JOIN links e ON e.dst = w.node WHERE e.src <> w.node AND e.src <> w.target AND (w.target, e.src, len(w.p) + 1) IN (SELECT (root, node, d) FROM back) GROUP BY 1, 2"
CTES["own_ids"] = "SELECT path, string_agg(aspect, ',' ORDER BY depth) AS ids FROM (SELECT path, aspect, 0 AS depth FROM node_aspects UNION ALL SELECT path, implied, depth FROM node_aspects n JOIN impl ON impl.aspect = n.aspect) GROUP BY 1"
CTES["flow_ids"] = "SELECT flow, string_agg(aspect, ',' ORDER BY depth) AS ids FROM (SELECT flow, aspect, 0 AS depth FROM flow_aspects UNION ALL SELECT flow, implied, depth FROM flow_aspects n JOIN impl ON impl.aspect = n.aspect) GROUP BY 1"
CTES["seeds"] = "SELECT path AS node, aspect, 1 AS rank, 0 AS k, '' AS flow FROM node_aspects UNION ALL SELECT node, aspect, 0, -distance, '' FROM anc JOIN node_aspects ON path = ancestor UNION ALL SELECT node, aspect, 2, 0, member.flow FROM member JOIN flow_aspects f ON f.flow = member.flow"
CTES["placed"] = "SELECT node, aspect, min((rank, k, flow, depth)) AS pos FROM (SELECT *, 0 AS depth FROM seeds UNION ALL SELECT node, implied, rank, k, flow, depth FROM seeds JOIN impl ON impl.aspect = seeds.aspect) GROUP BY 1, 2"
CTES["tagged"] = (
    "SELECT path AS node, 0 AS section, (0, 0, '', 0) AS pos, '<global>'||chr(10)||'**Project:** Star'||chr(10)||chr(10)||'</global>' AS x FROM nodes"
    " UNION ALL SELECT anc.node, 1, (0, -distance, '', 0), '<hierarchy path=\"'||ancestor||'\"'||coalesce(' aspects=\"'||ids||'\"', '')||'>'||chr(10)||coalesce(all_t, '')||chr(10)||'</hierarchy>' FROM anc LEFT JOIN own_units o ON o.node = ancestor LEFT JOIN own_ids i ON i.path = ancestor"
    " UNION ALL SELECT n.path, 2, (0, 0, '', 0), '<own-artifacts'||coalesce(' aspects=\"'||ids||'\"', '')||'>'||chr(10)||'### yg-node.yaml'||chr(10)||'name: '||name||chr(10)||'type: '||type||coalesce(chr(10)||chr(10)||all_t, '')||chr(10)||'</own-artifacts>' FROM nodes n LEFT JOIN own_units o ON o.node = n.path LEFT JOIN own_ids i ON i.path = n.path"
    " UNION ALL SELECT p.node, 3, pos, '<aspect name=\"'||name||'\" id=\"'||id||'\">'||chr(10)||t||coalesce(note, '')||chr(10)||'</aspect>' FROM placed p JOIN asp_t ON id = p.aspect LEFT JOIN note ON note.node = p.node AND note.aspect = p.aspect"
    " UNION ALL SELECT src, 4, (0, ord, '', 0), '<dependency target=\"'||dst||'\" type=\"'||type||'\"'||CASE WHEN consumes <> '' THEN ' consumes=\"'||replace(consumes, ',', ', ')||'\"' ELSE '' END||CASE WHEN failure <> '' THEN ' failure=\"'||failure||'\"' ELSE '' END||'>'||chr(10)||regexp_replace(pre||coalesce(inc_t, all_t, ''), '[\\s\\x0b]+$', '')||chr(10)||'</dependency>' FROM rels LEFT JOIN own_units ON node = dst WHERE type IN ('uses', 'calls', 'extends', 'implements')"
    " UNION ALL SELECT src, 4, (0, ord, '', 0), '<event target=\"'||dst||'\" type=\"'||type||'\" event-name=\"'||coalesce(event_name, dst_name)||'\">'||chr(10)||said||chr(10)||'</event>' FROM rels WHERE type IN ('emits', 'listens')"
    " UNION ALL SELECT node, 5, (0, 0, member.flow, 0), '<flow name=\"Flow '||member.flow||'\"'||coalesce(' aspects=\"'||ids||'\"', '')||'>'||chr(10)||t||chr(10)||'</flow>' FROM member JOIN flow_t ON flow_t.flow = member.flow LEFT JOIN flow_ids i ON i.flow = member.flow"
)
CTES["bodies"] = "SELECT node, string_agg(x, chr(10)||chr(10) ORDER BY section, pos, x) AS body FROM tagged GROUP BY 1"
_ALL["context_text_digest"] = (
    lambda g: context.digests(g),
    "SELECT b.node, tokens, status, sha256('<context-package node-path=\"'||b.node||'\" node-name=\"'||name||'\" token-count=\"'||tokens||'\">'||chr(10)||chr(10)||body||chr(10)||chr(10)||'</context-package>') AS digest FROM bodies b JOIN budget ON budget.node = b.node JOIN nodes ON path = b.node",
)
CTES["own_files"] = "SELECT path AS node, 'graph/model/'||path||'/yg-node.yaml' AS f FROM nodes UNION ALL SELECT node, 'graph/model/'||node||'/'||filename FROM owner"
CTES["trk"] = (
    "SELECT node, f AS path, 'graph' AS category FROM own_files UNION ALL SELECT anc.node, f, 'graph' FROM anc JOIN own_files o ON o.node = anc.ancestor"
    " UNION ALL SELECT node, 'graph/aspects/'||aspect||'/'||x, 'graph' FROM eff, (VALUES ('yg-aspect.yaml'), ('content.md'), ('notes.md')) v(x) WHERE x <> 'notes.md' OR aspect LIKE 'size/%0'"
    " UNION ALL SELECT src, 'graph/model/'||o.node||'/'||o.filename, 'graph' FROM links JOIN owner o ON o.node = dst WHERE o.filename <> 'internals.md' OR NOT EXISTS (SELECT 1 FROM owner p WHERE p.node = o.node AND p.filename <> 'internals.md')"
    " UNION ALL SELECT node, 'graph/flows/'||flow||'/'||x, 'graph' FROM member, (VALUES ('yg-flow.yaml'), ('description.md')) v(x) WHERE x <> 'description.md' OR flow <> 'tour'"
    " UNION ALL SELECT node, mapping, 'source' FROM mappings"
)
CTES["claims"] = "SELECT node, mapping FROM mappings UNION ALL SELECT 'zz', mapping FROM mappings WHERE mapping LIKE '%/en'"
CTES["cyc"] = f"SELECT src AS root, dst AS node FROM ({_BOXED}) UNION SELECT cyc.root, e.dst FROM cyc JOIN ({_BOXED}) e ON e.src = cyc.node"
CTES["imp2"] = "SELECT id AS src, implied AS dst FROM implies UNION ALL SELECT 'size/3', 'size/50'"
CTES["icyc"] = "SELECT src AS root, dst AS node FROM imp2 UNION SELECT icyc.root, i.dst FROM icyc JOIN imp2 i ON i.src = icyc.node"

# Codes and severities are fixed values: (rule, code, severity, column of the node); a rule of no node has none.
_ISSUES = [
    ("v_unknown_type", "E002", "error", "node"), ("v_unknown_aspect", "E003", "error", "node"), ("v_broken_relation", "E004", "error", "node"),
    ("v_broken_flow_ref", "E006", "error", None), ("v_broken_flow_aspect", "E007", "error", None), ("v_overlap", "E009", "error", "blamed"),
    ("v_structural_cycle", "E010", "error", "node"), ("v_bad_condition", "E013", "error", None), ("v_duplicate_aspect", "E014", "error", None),
    ("v_implied_missing", "E016", "error", None), ("v_implies_cycle", "E017", "error", None), ("v_missing_artifact", "W001", "warning", "node"),
    ("v_shallow", "W002", "warning", "node"), ("v_budget", "W005", "warning", "node"), ("v_fanout", "W007", "warning", "node"),
    ("v_unpaired_event", "W009", "warning", "node"), ("v_missing_schema", "W010", "warning", None), ("v_required_aspect", "W011", "warning", "node"),
    ("v_mapping_missing", "W012", "warning", "node"), ("v_anchor_not_found", "W014", "warning", "node"),
]


def _shared(spark, d):
    """The graph with the tables that many rules read written once; texts stay where they are."""
    g = from_star_schema(spark, d)
    tables = ("nodes", "relations", "node_aspects", "aspects", "implies", "flow_nodes", "flow_aspects", "mappings", "files")
    return dataclasses.replace(g, **{t: closure.written(getattr(g, t)) for t in tables})


def _issues(spark, d, listed=_ISSUES):
    """(code, severity, node): the rows of all rules together, over one graph."""
    g, out = _shared(spark, d), None
    for name, code, severity, node in listed:
        rule = _ALL[name][0]
        one = rules.issue(rule(g, spark, d) if rule.__code__.co_argcount == 3 else rule(g), code, severity, node)
        out = one if out is None else out.unionAll(one)
    return out


_ISSUES_SQL = " UNION ALL ".join(f"SELECT {'code' if name == 'v_budget' else repr(code)} AS code, '{severity}' AS severity, {node or 'NULL::VARCHAR'} AS node FROM ({_ALL[name][1]})" for name, code, severity, node in _ISSUES)
_ALL |= {
    "v_issue_counts": (lambda g, spark, d: _issues(spark, d).groupBy("code", "severity").agg(F.count("*").alias("n")), f"SELECT code, severity, count(*) AS n FROM ({_ISSUES_SQL}) GROUP BY 1, 2"),
    "v_scoped": (lambda g, spark, d: rules.scoped(_issues(spark, d), "lib/Brand-11", g.nodes).groupBy("code").agg(F.count("*").alias("n")), f"SELECT code, count(*) AS n FROM ({_ISSUES_SQL}) WHERE node IS NULL OR node = 'lib/Brand-11' OR starts_with(node, 'lib/Brand-11/') GROUP BY 1"),
}
QUERIES = {k: _star(f) for k, (f, _) in _ALL.items()}
ORACLES = {k: _sql(q) for k, (_, q) in _ALL.items() if q}
