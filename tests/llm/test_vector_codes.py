"""Vector codes against brute force, the screen's bound, and odd input."""

import numpy as np
from pyspark.sql import Row

from trellis.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string"


def plain(rows, entries, rounds):
    """rows: (vec_id, integers) by vec_id; codes and errors by argmin over all entries."""
    x = np.array([v for _, v in rows], np.int64)
    p = x.shape[1] // 4
    books = [x[:entries, i * p : (i + 1) * p].copy() for i in range(4)]
    for step in range(rounds + 1):
        d = [((x[:, None, i * p : (i + 1) * p] - books[i][None]) ** 2).sum(2) for i in range(4)]
        best = [m.argmin(1) for m in d]
        for i in range(4 if step < rounds else 0):
            for e in set(best[i].tolist()):
                mine = x[best[i] == e, i * p : (i + 1) * p]
                books[i][e] = [sum(c) // len(mine) for c in mine.T.tolist()]
    codes = ["".join(f"{best[i][r]:02x}" for i in range(4)) for r in range(len(x))]
    return codes, [int(sum(d[i][r].min() for i in range(4))) for r in range(len(x))], books


def test_screen_keeps_every_nearest_entry():
    rng = np.random.default_rng(0)
    for scale in (3, 600, 2**24):
        x, book = rng.integers(-scale, scale, (3000, 16)), rng.integers(-scale, scale, (256, 16))
        book[100:140] = book[:40]  # equal entries: the lower index counts
        x[:256] = book
        x[256:300] = (book[:44] + book[44:88]) // 2  # near ties
        index, least = V.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert np.array_equal(index, d.argmin(1)) and np.array_equal(least, d.min(1))


def test_screen_is_a_screen():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-500, 500, (500, 16)), rng.integers(-500, 500, (256, 16))
    assert V.screened(x, book).sum() < 600


def test_like_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (90, 8)).astype(np.float32)
    v[40:60] = v[5]  # a common vector
    rows = [(i * 3, v[i].tolist(), int(i) % 3 if i % 5 else None, "x", "y") for i in range(90)]
    coded, books = V.compress(spark.createDataFrame(rows, SCHEMA), entries=16, rounds=3)
    codes, errors, plain_books = plain([(r[0], np.floor(1024 * np.array(r[1], np.float64)).astype(np.int64)) for r in rows], 16, 3)
    got = {r["vec_id"]: (r["code"], r["error"], r["label"]) for r in coded.collect()}
    assert got == {r[0]: (c, e, r[2]) for r, c, e in zip(rows, codes, errors)}
    assert np.array_equal(books, np.array(plain_books))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2, -0.3, 0.4], 1, None, None), (1, [0.1, 0.2, -0.3, 0.4], 1, None, None), (2, [0.0, 0.0, 0.0, 0.0], None, None, None),
        (None, [0.1, 0.2, -0.3, 0.4], None, None, None), (3, None, 1, None, None), (4, [0.1, None, 0.2, 0.3], 1, None, None),
        (5, [nan, 0.0, 0.0, 0.0], 1, None, None), (6, [0.0, -inf, 0.0, 0.0], 1, None, None), (7, [0.0, 0.0], 1, None, None), (8, [1e30, 0.0, 0.0, 0.0], 1, None, None), (9, [], 1, None, None),
    ]
    coded, books = V.compress(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in coded.collect()), key=str)
    assert got == sorted([(1, 1, "00000000", 0)] * 2 + [(2, None, "01010101", 0), (None, None, "00000000", 0)] + [(k, 1, None, None) for k in (7, 8, 9)], key=str)
    assert books.shape == (4, 2, 1) and books[:, 0, 0].tolist() == [102, 204, -308, 409]


def test_nothing_to_code(spark):
    for rows in ([], [(1, [0.1, 0.2, 0.3], 1, None, None)], [(None, [0.1, 0.2, 0.3, 0.4], 1, None, None)]):
        coded, books = V.compress(spark.createDataFrame(rows, SCHEMA))
        assert books is None and [r["code"] for r in coded.collect()] == [None] * len(rows)
    assert V.digest(None) == V.hashlib.sha256(b"").hexdigest()


def test_label_sums_meet_by_a_join_where_labels_are_many(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    rows = [Row(vec_id=i, embedding=[float(x) for x in rng.normal(0, 1, 8)], label=None if i % 4 == 0 else i % 4) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(map(tuple, V.op12_vector_codes(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(V, "MOST_LABELS", 0)
    assert sorted(map(tuple, V.op12_vector_codes(spark, str(tmp_path)).collect())) == want
    sums = {}
    for r, (_, _, error, _, _) in zip(rows, want):
        sums[r.label] = sums.get(r.label, 0) + error
    assert [w[3] for w in want] == [sums[r.label] for r in rows]
