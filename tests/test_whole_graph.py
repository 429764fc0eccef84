"""Operators and queries over every relation of the graph, not the part DAG alone."""

from types import SimpleNamespace

import duckdb
import pytest

from trellis.operators import rules
from trellis.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


WHOLE = ["context_text_digest", "context_layers", "v_budget", "v_issue_counts", "deps_tree_depth3", "deps_transitive", "deps_stages", "impact_transitive", "impact_method", "impact_chains", "impact_events"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_queries(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_suppliers_are_dependents(spark):
    direct = QUERIES["impact_direct"](spark, SF).groupBy("target").count()
    total = QUERIES["impact_transitive"](spark, SF)
    assert total.join(direct, "target", "full_outer").where("not n_direct <=> count").isEmpty()
    assert {r.method for r in QUERIES["impact_method"](spark, SF).select("method").distinct().collect()} == {"A", "N", "R"}
    assert QUERIES["impact_chains"](spark, SF.replace("0.001", "0.01")).where("chain rlike '/s[0-9]+$'").count() > 0


def test_many_anchors(spark):
    texts = [(f"<{i}> filler",) for i in range(0, 10_500, 5)] + [(None,)]
    g = SimpleNamespace(anchors=spark.createDataFrame([(f"<{i}>",) for i in range(10_500)] + [("<0>",)], "anchor string"), artifacts=spark.createDataFrame(texts, "content string"))
    want = {f"<{i}>" for i in range(10_500) if i % 5}
    got = [r.anchor for r in rules.anchors_missing(g).collect()]
    assert len(got) == len(want) and set(got) == want
    assert "NestedLoop" not in rules.anchors_missing(g)._jdf.queryExecution().toString()
