"""The benchmark query against brute force: parts, inserted text, odd items, whole rows kept."""

import random

from pyspark.sql import functions as F

from trellis.llm import decontaminate as D

WORDS = "the of and river stone cloud table green seven paper light north music water glass".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


ITEMS = [(k, prose(100 + k, 12 + k % 40)) for k in range(60)] + [(900, "word"), (901, None), (902, " "), (None, prose(7, 20)), (3, prose(103, 15))]


def brute(docs):
    """Pairs by overlap of the whole text; the texts are short enough to be one passage."""
    out = set()
    for d, text in docs:
        terms = D._terms(text)
        here = D._shingles(terms)
        for i, item in ITEMS:
            t = D._terms(item)
            if not t:
                continue
            if len(t) < D.SHINGLE:
                if any(terms[k : k + len(t)] == t for k in range(len(terms) - len(t) + 1)):
                    out.add((d, i))
                continue
            cut = len(t) // 2
            share = lambda s: sum(x in here for x in s) / len(s) if s and len(next(iter(s))) == D.SHINGLE else 1.0  # noqa: E731, B023
            if share(D._shingles(t)) >= D.OVERLAP and share(D._shingles(t[:cut])) >= D.HALF and share(D._shingles(t[cut:])) >= D.HALF:
                out.add((d, i))
    return out


def documents():
    r = random.Random(2)
    out = []
    for k in range(90):
        w = ITEMS[k % 60][1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        out.append((k, prose(500 + k, r.randint(0, 25)) + " " + " ".join(w) + " " + prose(900 + k, r.randint(0, 25))))
    return out + [(200, "a Word, here"), (201, None), (202, ""), (203, prose(7, 20)), (203, prose(7, 20))]


def test_query_and_parts_against_brute_force(spark):
    docs, items = documents(), spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    whole = {(r.doc_id, r.item_id): (round(r.score, 9), r.overlap) for r in D.contaminated(df, items).collect()}
    assert set(whole) == brute(docs)
    parts = {(r.doc_id, r.item_id): (round(r.score, 9), r.overlap) for r in D.contaminated(df, items, most_items=9).collect()}
    assert parts == whole
    left = D.drop_contaminated(df, items, most_items=20)
    gone = {d for d, _ in whole}
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in gone)
    assert D.drop_contaminated(df, items.limit(0)).count() == len(docs)


def test_inserted_text_at_every_offset():
    items = [(k, prose(100 + k, 40)) for k in range(20)]
    index = D.Index(items)
    w = items[3][1].split()
    for gap in (10, 30, 39):
        for offset in range(0, 3 * index.longest, 7):
            text = prose(1, offset) + " " + " ".join(w[:20]) + " " + prose(2, gap) + " " + " ".join(w[20:]) + " " + prose(3, 150)
            assert set(index.matches(text)) == {3}


def test_passages_left_out_have_no_item():
    """What the test over blocks drops, an exhaustive scoring of the passage drops too."""
    index = D.Index(ITEMS[:60])
    for seed in range(40):
        terms = sorted({int(x) for x in index.ids(prose(seed, 60)) if x >= 0} | ({int(x) for x in index.ids(ITEMS[seed % 60][1])} if seed % 2 else set()))
        scores = {}
        for k in terms:
            for a, x in zip(*index.postings[k]):
                scores[a] = scores.get(a, 0.0) + x
        want = {a for a, x in scores.items() if x >= 1}
        assert {a for a, _ in index.search(terms)} == want
        import numpy as np

        if want:
            assert index._alive(np.zeros(len(terms), np.int64), np.array(terms), np.array([0])).all()


def test_copies_spread_over_a_long_text_against_brute_force():
    """Halves, and parts of five to nine words kept in any order, far apart; the shares of the whole text decide."""
    index, r = D.Index(ITEMS), random.Random(4)
    found = 0
    for gap in (100, 140, 160, 240, 1000):
        for offset in range(0, 130, 13):
            k = r.choice(range(28, 40))
            w = ITEMS[k][1].split()
            cut = len(w) // 2
            halves = " ".join([prose(1, offset), *w[:cut], prose(2, gap), *w[cut:], prose(3, 150)])
            parts = [w[i : i + 12] for i in range(0, len(w), 8)]
            r.shuffle(parts)
            mixed = " ".join([prose(4, offset), *(" ".join([*p, prose(gap + j, gap)]) for j, p in enumerate(parts))])
            scrambled = " ".join([prose(5, offset), *(f"{x} {prose(6 + j, gap // 20)}" for j, x in enumerate(w)), prose(9, 300)])
            for d, text in enumerate((halves, mixed, scrambled)):
                got = {(d, index.items[i][0]) for i in index.matches(text)}
                assert got == brute([(d, text)])
                found += len(got)
            assert any(index.items[i][0] == k for i in index.matches(mixed))
    assert found >= 50
    assert index.matches(prose(8, 4000)) == {}


def test_shingle_hashes_tell_unknown_words_apart():
    index = D.Index(ITEMS[:5])
    ids = index.ids(ITEMS[0][1] + " unknownword " + ITEMS[1][1])
    import numpy as np

    hit = np.isin(D._hashed(ids), index.hashes)
    n, m = len(ITEMS[0][1].split()), len(ITEMS[1][1].split())
    assert hit[: n - 4].all() and not hit[n - 4 : n + 1].any() and hit[n + 1 :].all() and len(hit) == n + m + 1 - 4
    assert len(D._hashed(ids[:4])) == 0
