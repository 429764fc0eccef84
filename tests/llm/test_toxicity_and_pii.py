"""Held-out accuracy of the chain, one training row per doc_id; personal data against plain patterns and plain Viterbi."""

import hashlib
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import pii, toxicity

DATA = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    chain = toxicity.train(docs, labels.where(half))
    out = toxicity.score(docs.join(labels.where(~half), "doc_id", "left_semi"), chain).withColumnRenamed("toxic", "said").join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").toPandas()
    recall, left_alone = out[out.y == 1].said.mean(), 1 - out[out.y == 0].said.mean()
    print("held out:", len(out), "recall", round(recall, 3), "clean left alone", round(left_alone, 3), "lexicon", len(chain.lexicon), "columns", len(chain.known))
    assert recall >= 0.75 and left_alone >= 0.98


def test_copies_train_once_and_share_a_fold(spark):
    rows = [(k, f"plain words number {'abcdefghij'[k % 10]} {'idiot ' if k % 4 == 0 else ''}here{'xyz'[k % 3]}", int(k % 4 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows + [(4, "another text", 1)] * 50, "doc_id long, text string, toxic int")
    a = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").distinct())
    b = toxicity.train(df.select("doc_id", "text").orderBy(F.desc("text")), df.select("doc_id", "toxic").distinct())
    assert len(a.out_of_fold) == 200 and np.array_equal(a.out_of_fold, b.out_of_fold)
    base = [np.arange(k, k + 30) * 7 for k in range(0, 3000, 40)]
    f = toxicity.folds(base + [np.append(base[3], 999_999)] * 3)
    assert len({*f[-3:], f[3]}) == 1


def test_many_copies_lie_in_one_fold():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40_000, 80)) for _ in range(400)]
    copies = [np.unique(np.r_[rows[7][rng.random(len(rows[7])) < 0.98], rng.integers(50_000, 60_000, 1)]) for _ in range(21)]  # 5 %
    f = toxicity.folds(rows + copies)
    assert len({*f[400:], f[7]}) == 1 and len(set(f[:400])) == toxicity.FOLDS
    order = rng.permutation(len(f))
    assert np.array_equal(toxicity.folds([(rows + copies)[i] for i in order]), f[order])


def test_a_fold_has_no_say_in_what_tells_it():
    rng = np.random.default_rng(6)
    toxic = (rng.random(300) < 0.3).astype(float)
    rows = [np.unique(np.r_[rng.integers(100, 3000, 30), rng.integers(0, 12, 3) if t else rng.integers(40, 80, 3)]) for t in toxic]
    one = toxicity.Chain(rows, toxic)
    mine = one.fold == 2
    shuffled = toxic.copy()
    shuffled[mine] = rng.permutation(toxic[mine])
    two = toxicity.Chain(rows, shuffled)
    assert not np.array_equal(toxic, shuffled) and len(one.lexicon) and len(one.known)
    for a, b in zip(one.by_fold[2][3:5], two.by_fold[2][3:5]):
        assert np.array_equal(a, b)
    assert np.array_equal(one.out_of_fold[mine, 0], two.out_of_fold[mine, 0])


def test_probabilities_of_one_kind_are_their_share(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, "idiot")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.train(df, one)).collect()
    assert len(out) == 3 and all(r.p_toxic > 0.99 for r in out)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if "0" <= c <= "9"]
            even = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and even % 10 == 0 or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(k, a, e) for a, _, k, e in sorted(out)]


def test_base_spans_against_plain_patterns(spark):
    r = random.Random(8)
    bits = ["ann@mail.org", "a.b@c", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4012888888881881", "5555 5555 5555 4444", "+1 (212) 555-0147", "+12", "é", "\n", " ", "x@y.z.w@q.r", "0012.3.4.5", "4012-8888-8888-1882", "+44 20 7946 0958.", "@", "..", "-"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["".join(r.choice("0123456789 -.+@a()") for _ in range(60)) for _ in range(1500)] + [None, ""]
    assert all(pii.base_spans(t or "") == plain(t or "") for t in texts)
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    for x in rows:
        want = plain(texts[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in want).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w[0] == k for w in want) for k in PATTERNS]
        spans = [s.split(":") for s in x.spans.split(",")] if x.spans else []
        got = [(k, int(a), int(e)) for k, a, e in spans]
        assert set(want) <= set(got) and x.n_found == len(got) and x.n_added == len(got) - len(want) and x.n_secret == sum(k == "secret" for k, _, _ in got)


FIELD = pii.Field(pii.training())


def test_viterbi_against_every_labelling():
    n = len(pii.LABELS)
    for seed in range(6):
        x = np.random.default_rng(seed).normal(size=(4, n)) * 2
        best = max(itertools.product(range(n), repeat=4), key=lambda y: sum(x[t, k] for t, k in enumerate(y)) + sum(FIELD.move[a, b] for a, b in zip(y, y[1:])))
        assert tuple(FIELD.decode([x.astype(np.float32), x[:1].astype(np.float32)])[0]) == best


def test_lines_left_out_have_no_labels():
    finder = pii.Finder(FIELD)
    r = random.Random(3)
    words = "the of water, River it's 1,200 3.5 % $5.00 Ab12 a=b <x> 2020-01-31 #tag word-word (see) password=da90f32ccfa9408d1c 212-555-0188 U.S. é漢".split()
    for _ in range(300):
        line = [r.choice(words) for _ in range(r.randint(1, 14))]
        ids = finder._ids(line)
        if finder.safe[ids].all():
            assert not FIELD.decode([finder.table[ids]])[0].any()


def test_whole_shapes():
    long = "Ab1-" * 20
    assert pii.word_features(long)[0] == "shape " + pii.shape(long.strip(pii._TRIM)) and len(pii.shape(long)) > 24


def test_long_words_are_not_kept(monkeypatch):
    monkeypatch.setattr(pii, "MOST_ROWS", 300)
    monkeypatch.setattr(pii, "MOST_KEPT", 20_000)
    finder = pii.Finder(pii.Field(pii.training()))
    rng = random.Random(1)
    for _ in range(40):
        text = " ".join("".join(rng.choice("aB3-") for _ in range(rng.randrange(60, 90))) for _ in range(40))
        finder.spans([text])
        assert len(finder.rows) <= 340 and finder.kept <= 20_000 + 40 * 200
    assert len(finder.table) <= 1024
