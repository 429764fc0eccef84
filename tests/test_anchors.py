"""The block index against plain search: lengths around every block size, alignments, texts of many pieces."""

import random

import pytest

from trellis.operators import anchors


def test_like_plain_search(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé好") for _ in range(n))
    texts = [(k % 3, word(rng.choice([0, 1, 5, 40, 700]))) for k in range(30)] + [(1, None), (None, "abab"), (4, "x" * 300)]
    some = [t for _, t in texts if t]
    wanted = []
    for n in (0, 1, 2, 3, 6, 7, 8, 14, 15, 16, 33):
        for _ in range(8):
            t = rng.choice([x for x in some if len(x) >= n])
            at = rng.randrange(len(t) - n + 1)
            wanted += [(rng.randrange(5), t[at : at + n]), (rng.randrange(5), word(n))]
    wanted += [(None, "ab"), (1, None), (4, "x" * 20)]
    got = anchors.found(spark.createDataFrame(texts, "node long, content string"), spark.createDataFrame(wanted, "node long, anchor string"), ["node"])
    want = {(n, a) for n, a in wanted if n is not None and a is not None and any(m == n and t is not None and a in t for m, t in texts)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    whole = anchors.found(spark.createDataFrame(texts, "node long, content string"), spark.createDataFrame(wanted, "node long, anchor string"), [])
    assert {r.anchor for r in whole.collect()} == {a for _, a in wanted if a is not None and any(t is not None and a in t for _, t in texts)}


def test_nothing(spark):
    none = spark.createDataFrame([], "content string")
    assert anchors.found(none, spark.createDataFrame([("",), ("a",)], "anchor string"), []).count() == 0
    assert anchors.found(spark.createDataFrame([("abc",)], "content string"), spark.createDataFrame([], "anchor string"), []).count() == 0


@pytest.mark.parametrize("few", [0, 2, 64])
def test_anchors_of_a_key_meet_its_texts(spark, monkeypatch, few):
    texts = [("a", "one two three"), ("a", "four"), ("b", "one two three"), ("c", None), (None, "one")]
    some = [("a", "two"), ("a", "four"), ("a", "fourth"), ("a", ""), ("b", "four"), ("b", "three"), ("c", ""), (None, "one"), ("d", "one")]
    blocks, plain = [], anchors.found
    monkeypatch.setattr(anchors, "found", lambda t, a, by: blocks.append(a.count()) or plain(t, a, by))
    monkeypatch.setattr(anchors, "FEW", few)
    got = anchors.found_near(spark.createDataFrame(texts, "node string, content string"), spark.createDataFrame(some, "node string, anchor string"), ["node"])
    assert sorted(map(tuple, got.collect())) == [("a", ""), ("a", "four"), ("a", "two"), ("b", "three")]
    assert blocks == {0: [8], 2: [4], 64: []}[few]
