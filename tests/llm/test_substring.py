"""Repeated windows against brute force, hashes of windows, and odd input."""

import random

import numpy as np
import pytest

from trellis.llm import substring as S

SCHEMA = "doc_id long, text string, k long, row string, spans int"


def plain(rows, window):
    """(doc_id, n_words, n_removed, left) by comparing all windows as word tuples."""
    split = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for r, ws in zip(rows, split):
        for i in range(len(ws) - window + 1) if r[0] is not None else ():
            x = tuple(ws[i : i + window])
            first[x] = min(first.get(x, r[0]), r[0])
    out = []
    for r, ws in zip(rows, split):
        keep = [True] * len(ws)
        for i in range(len(ws) - window + 1) if r[0] is not None else ():
            if first[tuple(ws[i : i + window])] < r[0]:
                keep[i : i + window] = [False] * window
        out.append((r[0], len(ws), keep.count(False), b" ".join(w for w, k in zip(ws, keep) if k).decode()))
    return sorted(out, key=str)


def run(spark, rows, window, inner):
    got = S.dedup(spark.createDataFrame(rows, SCHEMA), None, window, inner)
    return sorted((tuple(r) for r in got.select("row.doc_id", "n_words", "n_removed", "left").collect()), key=str), got


@pytest.mark.parametrize("window, inner", [(5, 3), (4, 4), (3, 1)])
def test_like_brute_force(spark, window, inner):
    rng = random.Random(window)
    said = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    long = " ".join(rng.choice(["x", "y", "é", "好"]) for _ in range(400))
    rows = [(k // 2 if k % 7 == 0 else k, t, 1, "r", 2) for k, t in enumerate(said)] + [(100 - k, f"s{k} {long} {k}\x0b\x0c t", k, None, None) for k in range(5)]
    rows += [(None, long, 0, "", 0), (200, long, 0, "", 0), (201, long, 0, "", 0), (201, long, 0, "", 0), (300, None, 0, "", 0), (301, "", 0, "", 0), (302, " \n\t", 0, "", 0), (303, "a b   c", 0, "", 0)]
    got, _ = run(spark, rows, window, inner)
    assert got == plain(rows, window)


def test_spans_are_maximal(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words), 0, "", 0), (2, " ".join(["a", "b", *words[3:20], "c", *words[20:25], "d"]), 0, "", 0)]
    _, df = run(spark, rows, 5, 3)
    assert {r["row"]["doc_id"]: r["spans"] and [tuple(s) for s in r["spans"]] for r in df.collect()} == {1: None, 2: [(2, 19), (20, 25)]}


def test_empty_table(spark):
    assert run(spark, [], 13, 7)[0] == []


def test_marks_are_no_longer_than_windows(spark):
    with pytest.raises(ValueError):
        run(spark, [], 5, 6)


def test_rolling_hashes_follow_the_words():
    words = [b"a", b"b", b"c", b"a", b"b", b"c", b"d"]
    v = S._values(words)
    for base, values in zip(S.BASES, v):
        for size in (1, 2, 3):
            h = S.Rolling(values, base).windows(size)
            same = [[words[i : i + size] == words[j : j + size] for j in range(len(h))] for i in range(len(h))]
            assert np.array_equal(h[:, None] == h[None], np.array(same))
    assert len(S.Rolling(v[0], S.BASES[0]).windows(8)) == 0
    one = S.Rolling(v[0], S.BASES[0])
    marks, inner = S.window_marks(one, 5, 2), one.windows(2)
    assert marks.tolist() == [inner[i : i + 4].min() for i in range(3)]
