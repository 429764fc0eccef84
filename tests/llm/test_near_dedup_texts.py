"""Documents whose rows share a doc_id but not their text, and columns with clashing names."""

import itertools

import pyarrow as pa
from pyspark.sql import functions as F

from trellis.llm import near_dedup

X, Y, Z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")


def clustered(spark, rows):
    out = near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=str)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, X), (5, Y), (3, Y), (9, X), (7, Z), (8, None), (5, "")]
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 7, True), (8, 8, True), (9, 3, False)]
    for order in (rows, rows[::-1]):
        assert clustered(spark, order) == want


def test_near_copies_of_either_text_link(spark):
    assert clustered(spark, [(1, X), (1, Y), (4, X + " end"), (2, Y + " end"), (6, Z)]) == [(1, 1, True), (1, 1, True), (2, 1, False), (4, 1, False), (6, 6, True)]


def test_block_links_ignore_row_order():
    rows = [(1, X, 1), (2, X + " end", 2), (3, Y + " end", 3), (4, "", 4), (5, Y, 5)]
    for order in itertools.permutations(rows):
        ids, texts, comps = zip(*order)
        table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "comp": pa.array(comps, pa.int64()), "query": [True] * len(rows)})
        out = near_dedup._block_links(table).to_pydict()
        assert sorted(zip(out["a"], out["b"])) == [(1, 2), (3, 5)]


def test_strips_count_every_shared_shingle(monkeypatch):
    import numpy as np

    monkeypatch.setattr(near_dedup, "STRIP", 3)
    sets = [np.unique(np.random.default_rng(k).integers(0, 40, 15).astype(np.uint64)) for k in range(12)]
    got = near_dedup._shared(sets, np.array([0, 5, 11]))
    assert got.tolist() == [[len(set(sets[q].tolist()) & set(s.tolist())) for s in sets] for q in (0, 5, 11)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, X), (2, X), (None, X)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_gone", "_id", "_row", "id", "t", "component")})
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
