"""The scan of giant documents: tree of products, long stretches without blanks, the whole document decoded."""

import json
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from trellis.llm import pieces
from trellis.llm.common import Workspace

with open(pieces.MODEL, "rb") as f:
    CODEC = pieces.Codec(f.read())


def chunked(text, chunk):
    s, around = " " + text, CODEC.longest + 2
    n = -(-len(s) // chunk)
    out = []
    for i in range(n):
        lo, hi = max(0, i * chunk - around), min(len(s), (i + 1) * chunk)
        out.append(pieces.transfer(CODEC, s[lo : (i + 1) * chunk + around], i * chunk - lo, hi - lo, i == 0, i == n - 1))
    return out


def text(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["the ", "of", "tion", " ", "é", "漢字", "a\n", "water"]) for _ in range(n))


def test_product_is_associative_and_finds_the_walk():
    for seed in range(5):
        ms = chunked(text(seed, 150), 23)
        left = ms[0]
        for m in ms[1:]:
            left = pieces.product(left, m)
        right = ms[-1]
        for m in reversed(ms[:-1]):
            right = pieces.product(m, right)
        assert left["0|"] == right["0|"] and len(left["0|"]) == 1


@pytest.mark.parametrize("span", [2, 3, 64])
def test_tree_gives_the_states_of_the_walk(spark, span):
    want, rows = {}, []
    for doc in range(6):
        ms = chunked(text(doc, 40 + 60 * doc), 17)
        total = ms[0]
        for m in ms[1:]:
            total = pieces.product(total, m)
        at = pieces.inner_states(ms, "0|", total["0|"][0])
        for i, m in enumerate(ms):
            want[doc, i] = (at[i], at[i + 1])
            rows.append((doc, 7, i, len(ms), json.dumps(m)))
    df = spark.createDataFrame(rows, "k1 long, k2 long, i long, n long, m string")
    got = pieces._border_states(Workspace(spark, "test-pieces"), df, ["k1", "k2"], span).collect()
    assert {(r.k1, r.i): (r.start, r.stop) for r in got} == want and len(got) == len(rows)


def test_giants_without_blanks_and_ties(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["漢字かな" * 60, "x" * 500, "ab" * 300 + " " + "c" * 300, "▁" * 90 + "a ▁b", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k1", "k2", "i", "ids", "exact")})
    out = pieces.encode(df, chunk=31).collect()
    assert len(out) == 8 and all(r.exact and r.n_tokens == len(r.ids) for r in out)
    for r in out:
        if r.doc_id in (0, 1, 2):
            assert r.ids == library.encode(texts[r.doc_id])
        assert r.doc_id is None or CODEC.decode(r.ids) == (texts[r.doc_id] or "")


def test_a_gap_between_stretches_is_seen():
    ids = CODEC.encode("the water of the river")
    assert CODEC.decode(ids) == "the water of the river" and CODEC.decode(ids[:2] + ids[3:]) != "the water of the river"
    with pytest.raises(ValueError, match="unique"):
        pieces.inner_states([{"0|": ["0|a", "0|b"]}, {"0|a": ["0|"], "0|b": ["0|"]}], "0|", "0|")
