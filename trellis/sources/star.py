"""Projection of the star schema to graph tables (lazy but for the few return flags; each query reads only the columns it needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import GraphTables, Settings

# The artifact types of the projection, as the default configuration has them, and its node types.
ARTIFACT_TYPES = [("responsibility.md", 0, "always", None, "What it does", True), ("interface.md", 1, "when", "has_incoming_relations", "How it is called", True), ("internals.md", 2, "never", None, "", False)]
NODE_TYPES = [("module", []), ("service", []), ("library", ["size/1", "size/3"])]
SCHEMAS = [("node",), ("flow",)]
#: As many different flags have a bit of a long each.
MOST_FLAGS = 63


def flags_of(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by..., consumes): the distinct return flags of each group of lines, sorted. Few flags are bits of a long, which a hash
    aggregate takes; sets are gathered where there are more."""
    flag = F.col("l_returnflag")
    known = sorted(r[0] for r in lines.where(flag.isNotNull()).select(flag).distinct().limit(MOST_FLAGS + 1).collect())
    if not 0 < len(known) <= MOST_FLAGS:
        return lines.groupBy(*by).agg(F.sort_array(F.collect_set(flag)).alias("consumes"))
    bit = F.lit(0).cast("long")
    for k, x in enumerate(known):
        bit = F.when(flag == x, F.lit(1 << k).cast("long")).otherwise(bit)
    has = lambda k: F.getbit("flags", F.lit(k)) == 1
    return lines.groupBy(*by).agg(F.bit_or(bit).alias("flags")).select(*by, F.array_compact(F.array(*(F.when(has(k), x) for k, x in enumerate(known)))).alias("consumes"))


def from_star_schema(spark: SparkSession, sf_dir: str) -> GraphTables:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cat = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    c = F.col
    region, nation, supplier, customer, part = (t(x) for x in ("region", "nation", "supplier", "customer", "part"))
    npath = nation.select("n_nationkey", cat("r", c("n_regionkey"), "/n", c("n_nationkey")).alias("npath"))
    brand = F.regexp_replace("p_brand", "#", "-")
    parts = part.select("p_partkey", "p_size", cat("lib/", brand, "/p", c("p_partkey")).alias("path"), cat("lib/", brand).alias("module"))
    s_path = supplier.join(F.broadcast(npath), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "s_acctbal", cat(c("npath"), "/s", c("s_suppkey")).alias("path"), c("npath"))
    c_path = customer.join(F.broadcast(npath), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_mktsegment", cat(c("npath"), "/c", c("c_custkey")).alias("path"), c("npath"))

    def node(df: DataFrame, path, parent, kind: str, blackbox=None) -> DataFrame:
        return df.select(path.alias("path"), parent.alias("parent_path"), F.lit(kind).alias("type"), (F.lit(False) if blackbox is None else blackbox).alias("blackbox"))

    none = F.lit(None).cast("string")
    nodes = node(region, cat("r", c("r_regionkey")), none, "module")
    for more in (
        node(nation, cat("r", c("n_regionkey"), "/n", c("n_nationkey")), cat("r", c("n_regionkey")), "module"),
        node(spark.range(1), F.lit("lib"), none, "module"),
        node(parts.select("module").distinct(), c("module"), F.lit("lib"), "module"),
        node(s_path, c("path"), c("npath"), "service", c("s_acctbal") < 0),
        node(c_path, c("path"), c("npath"), "service"),
        node(parts, c("path"), c("module"), "library"),
    ):
        nodes = nodes.unionAll(more)
    name = F.element_at(F.split("path", "/"), -1)
    nodes = nodes.withColumns({"depth": F.size(F.split("path", "/")).cast("long"), "name": name, "yaml_raw": F.concat(F.lit("name: "), name, F.lit("\ntype: "), "type", F.lit("\n"))})

    key = parts.select("p_partkey", "path")
    dst = key.select(c("p_partkey").alias("d"), c("path").alias("dst"))
    deep = key.where("p_partkey >= 1").select(c("path").alias("src"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("ord"), F.floor(c("p_partkey") / 2).alias("d"), F.lit("extends").alias("type")),
        F.struct(F.lit(1).cast("long").alias("ord"), F.floor(c("p_partkey") / 3).alias("d"), F.lit("uses").alias("type")))).alias("e"), "p_partkey")
    fails = F.when((c("type") == "uses") & (c("p_partkey") % 5 == 0), "use the last known part").alias("failure")
    deep = deep.select("src", "e.ord", "e.d", "e.type", "p_partkey").join(dst, "d").select("src", "ord", "dst", "type", F.lit(None).cast("array<string>").alias("consumes"), fails, none.alias("event_name"))
    wide = flags_of(t("lineitem"), ["l_suppkey", "l_partkey"])
    wide = wide.join(s_path.select("s_suppkey", c("path").alias("src")), c("l_suppkey") == c("s_suppkey")).join(dst, c("l_partkey") == c("d"))
    wide = wide.select("src", (F.lit(2) + c("l_partkey")).cast("long").alias("ord"), "dst", F.lit("calls").alias("type"), "consumes", none.alias("failure"), none.alias("event_name"))
    ev = t("events").where(c("event_type").isin("purchase", "view")).select("event_type", "user_id", (c("event_id") % 50).alias("d")).distinct()
    ev = ev.join(dst, "d").join(c_path.select("c_custkey", c("path").alias("cpath")), c("user_id") == c("c_custkey"))
    buys = c("event_type") == "purchase"
    ev = ev.select(F.when(buys, c("cpath")).otherwise(c("dst")).alias("src"), F.lit(0).cast("long").alias("ord"), F.when(buys, c("dst")).otherwise(c("cpath")).alias("dst"), F.when(buys, "emits").otherwise("listens").alias("type"), F.lit(None).cast("array<string>").alias("consumes"), none.alias("failure"), F.when(buys, "Purchase").alias("event_name"))

    sizes = spark.range(1, 51)
    size = lambda x: cat("size/", x)
    prio = t("orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("p")).distinct()
    aspects = sizes.select(size(c("id")).alias("id")).unionAll(parts.select(cat("brand/", F.substring("module", 5, 100)).alias("id")).distinct()).unionAll(prio.select(cat("prio/", c("p")).alias("id")).distinct()).unionAll(customer.select(cat("seg/", c("c_mktsegment")).alias("id")).distinct())
    node_aspects = parts.select("path", size(c("p_size")).alias("aspect")).unionAll(parts.select(c("module").alias("path"), cat("brand/", F.substring("module", 5, 100)).alias("aspect")).distinct()).unionAll(c_path.select("path", cat("seg/", c("c_mktsegment")).alias("aspect")))
    flow_nodes = prio.where("o_custkey % 10 = 0").join(c_path, c("o_custkey") == c("c_custkey")).select(cat("prio-", c("p")).alias("flow"), c("path").alias("node")).unionAll(npath.where("n_nationkey = 0").select(F.lit("tour").alias("flow"), c("npath").alias("node")))
    flow_aspects = prio.select(cat("prio-", c("p")).alias("flow"), cat("prio/", c("p")).alias("aspect")).distinct().unionAll(spark.range(1).select(F.lit("tour").alias("flow"), F.lit("size/8").alias("aspect")))
    k = F.when(c("id").like("size/%"), F.substring("id", 6, 10).cast("int"))
    aspects = aspects.select("id", F.concat(F.lit("Aspect "), "id").alias("name"), none.alias("description"), F.when(k % 3 == 0, "schema").when(k % 3 == 1, "protocol").when(k % 3 == 2, "implementation").alias("stability"))
    rule = aspects.select(c("id").alias("aspect"), F.lit("content.md").alias("filename"), F.concat(F.lit("Rule of "), "id", F.lit(".\n")).alias("content"))
    aspect_artifacts = rule.unionAll(rule.where("aspect like 'size/%0'").select("aspect", F.lit("notes.md").alias("filename"), F.concat(F.lit("Notes on "), "aspect").alias("content")))
    flows = flow_aspects.select("flow").distinct().select("flow", F.concat(F.lit("Flow "), "flow").alias("name"))
    flow_artifacts = flows.where("flow <> 'tour'").select("flow", F.lit("description.md").alias("filename"), F.concat(F.lit("Steps of "), "flow", F.lit(".\n")).alias("content"))
    zero = F.lit(0).cast("long").alias("ord")
    legacy = F.when(c("aspect").like("size/%") & c("path").endswith("0"), F.array(F.lit("old packaging"), F.lit("samples"))).alias("exceptions")

    docs = t("documents")
    name = F.element_at(F.array(*map(F.lit, ("responsibility.md", "interface.md", "internals.md"))), (c("doc_id") % 3 + 1).cast("int"))
    owner = docs.select((F.floor(c("doc_id") / 3)).alias("p"), "doc_id", "text", "source", name.alias("filename")).join(key, c("p") == c("p_partkey"))
    artifacts = owner.select(c("path").alias("node"), "filename", c("text").alias("content"))
    url = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    files = t("pages").select(url.alias("file")).distinct()
    host, lang = F.split("file", "/")[0], F.concat_ws("/", F.split("file", "/")[0], F.split("file", "/")[1])
    mappings = files.select(cat("web/", host).alias("node"), host.alias("mapping")).distinct().unionAll(files.select(cat("web/", lang).alias("node"), lang.alias("mapping")).distinct())
    anchors = t("benchmark").select(F.substring("text", 1, 60).alias("anchor"))
    state = owner.select(c("path").alias("node"), cat("d", F.lpad(c("doc_id").cast("string"), 12, "0")).alias("path"), "doc_id", "text", F.when(c("source") == "src0", "graph").otherwise("source").alias("category"))
    baseline = state.where("doc_id % 13 <> 5").select("node", "path", F.sha2("text", 256).alias("hash"), "category")
    current = state.where("doc_id % 11 <> 3").select("node", "path", F.sha2(F.when(c("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("hash"), "category")
    # The first words of each document of a part, changed for every third document, are anchors of the part's own aspect.
    found = owner.select(c("path"), F.concat(F.substring("text", 5, 20), F.when(c("doc_id") % 3 == 1, "~").otherwise("")).alias("anchor"), "doc_id")
    found = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "anchor"))), lambda x: x["anchor"]).alias("anchors"))
    return GraphTables(
        nodes=nodes, relations=deep.unionAll(wide).unionAll(ev), node_aspects=node_aspects.join(found, "path", "left").select("path", "aspect", zero, legacy, "anchors"),
        aspects=aspects, implies=sizes.where("id >= 2").select(size(c("id")).alias("id"), zero, size(F.floor(c("id") / 2)).alias("implied")),
        flows=flows, flow_nodes=flow_nodes.withColumn("ord", F.lit(0).cast("long")), flow_aspects=flow_aspects.withColumn("ord", F.lit(0).cast("long")), artifacts=artifacts, mappings=mappings.withColumn("ord", F.lit(0).cast("long")), files=files, anchors=anchors, baseline=baseline, current=current,
        aspect_artifacts=aspect_artifacts, flow_artifacts=flow_artifacts, settings=Settings("Star"),
        artifact_types=spark.createDataFrame(ARTIFACT_TYPES, "filename string, ord int, required string, when string, description string, included boolean"),
        node_types=spark.createDataFrame(NODE_TYPES, "type string, required_aspects array<string>"), schemas=spark.createDataFrame(SCHEMAS, "schema string"),
    )
