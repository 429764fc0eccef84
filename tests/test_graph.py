"""Tiny graphs, and a sample of the catalogue against DuckDB."""

import duckdb
import pytest

from trellis.operators import closure, impact, rules
from trellis.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def edges(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src string, dst string")


def staged(spark, text):
    e = edges(spark, text)
    nodes = spark.createDataFrame([(n,) for n in sorted(set(text.replace(" ", "")))], "node string")
    return {r.node: r.stage for r in closure.stages(nodes, e).collect()}


def test_stages(spark):
    assert staged(spark, "AB BC") == {"C": 1, "B": 2, "A": 3}
    assert staged(spark, "AB AC BD CD") == {"D": 1, "B": 2, "C": 2, "A": 3}
    with pytest.raises(ValueError, match="circular"):
        staged(spark, "AB BA")


def test_cycles_without_blackboxes(spark):
    box = spark.createDataFrame([("b",)], "node string")
    found = lambda text: sorted(r[0] for r in rules.structural_cycle(edges(spark, text), box).collect())
    assert found("ab ba") == [] and found("xy yz zx qx") == ["x", "y", "z"] and found("ss") == ["s"]


def test_reach_on_a_cycle(spark):
    assert sorted(tuple(r) for r in closure.reach(edges(spark, "ab bc ca")).where("root = 'a'").collect()) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2)]


def test_reverse_diamond(spark):
    out = {r.target: (r.n_direct, r.n_total) for r in impact.dependents(edges(spark, "ba ca cb")).collect()}
    assert out["a"] == (2, 2) and out["b"] == (1, 1)
    one = spark.createDataFrame([("c",)], "target string")
    assert [r.chain for r in impact.chains(edges(spark, "ab bc"), one).collect()] == ["<- b <- a"]
    assert sorted(r.chain for r in impact.chains(edges(spark, "bc ac xb xa yx ca"), one).collect()) == ["<- a <- x", "<- a <- x <- y"]


def test_scope(spark):
    nodes = spark.createDataFrame([("a",), ("a/b",), ("ab",)], "path string")
    issues = spark.createDataFrame([("X", "error", n) for n in ("a", "a/b", "ab", None)], "code string, severity string, node string")
    assert sorted(str(r.node) for r in rules.scoped(issues, "a", nodes).collect()) == ["None", "a", "a/b"]
    with pytest.raises(ValueError, match="invalid scope"):
        rules.scoped(issues, "c", nodes)


@pytest.mark.parametrize("name", ["context_budget", "aspect_provenance", "impact_events", "v_overlap", "owner_of_file", "drift_status", "canonical_digest", "v_unpaired_event", "deps_changed_expand", "impact_scope_total", "v_bad_condition", "v_duplicate_aspect", "v_implies_cycle", "v_missing_schema", "v_mapping_missing", "v_scoped"])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_reach_against_breadth_first(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        pairs = {(r.randint(0, 40), r.randint(0, 40)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(30)}
        df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
        for cap in (None, 1, 3, 7):
            want = {}
            for root in {a for a, _ in pairs}:
                seen, now, d = {}, {root}, 0
                while now and (cap is None or d < cap):
                    d += 1
                    now = {b for a, b in pairs if a in now} - set(seen)
                    seen |= dict.fromkeys(now, d)
                want |= {(str(root), str(n)): d for n, d in seen.items()}
            assert {(x.root, x.node): x.depth for x in closure.reach(df, cap).collect()} == want


def test_stages_ignore_targets_outside(spark):
    a = spark.createDataFrame([("a",), ("b",)], "node string")
    e = spark.createDataFrame([("a", "x"), ("b", "a"), ("b", "a"), ("x", "a")], "src string, dst string")
    assert {r.node: r.stage for r in closure.stages(a, e).collect()} == {"a": 1, "b": 2}
    assert [(r.stage, r.parallel, r.nodes) for r in closure.stage_list(a, e.limit(0)).collect()] == [(1, True, ["a", "b"])]
    assert closure.stages(a.limit(0), e).count() == 0


def test_dependencies_and_tree(spark):
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "path string, blackbox boolean")
    rel = spark.createDataFrame([("a", 0, "b", "uses"), ("a", 1, "c", "emits"), ("b", 0, "a", "calls"), ("b", 1, "c", "calls"), ("a", 2, "b", "calls"), ("c", 0, "gone", "listens")], "src string, ord long, dst string, type string")
    deps = closure.dependencies(nodes, rel)
    assert sorted(tuple(r) for r in deps.where("root = 'a'").collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    with pytest.raises(ValueError, match="gone"):
        closure.dependencies(nodes, rel, "all")
    with pytest.raises(ValueError, match="not found: z"):
        closure.dependencies(nodes, rel, roots=spark.createDataFrame([("z",)], "root string"))
    tree = closure.dependency_tree(nodes, rel, "a").orderBy("ords").collect()
    assert [(r.ords, r.node, r.type, r.blackbox) for r in tree] == [([0], "b", "uses", True), ([0, 1], "c", "calls", False), ([1], "c", "emits", False), ([2], "b", "calls", True), ([2, 1], "c", "calls", False)]
    assert closure.dependency_tree(nodes, rel, "a", "structural", 1).count() == 2


def test_stages_of_nodes_that_nothing_leads_to(spark):
    assert staged(spark, "AB BC XA XC YC") == {"C": 1, "B": 2, "A": 3, "X": 4, "Y": 2}
    a = spark.createDataFrame([("a",), ("b",), ("lone",)], "node string")
    assert {r.node: r.stage for r in closure.stages(a, edges(spark, "ab")).collect()} == {"a": 2, "b": 1, "lone": 1}
    with pytest.raises(ValueError, match="circular dependency among: A, B, T$"):
        staged(spark, "AB BA TA AL")
