"""Queries of the training-data operators against their SQL, and the registry."""

import duckdb
import pytest

from trellis.llm.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    cols = sorted(want.columns)
    rows = lambda some: sorted((tuple(r) for r in some), key=str)
    assert sorted(got.columns) == cols and rows(got.select(*cols).collect()) == rows(want.select(", ".join(cols)).fetchall())


def test_registry():
    assert sorted(QUERIES) == sorted([f"op{k}_{n}" for k, n in enumerate("warc toxicity sharding quality line_dedup licenses near_dedup sentencepiece pii decontamination throttle vector_codes substring".split(), 1)] + ["pipeline"])
