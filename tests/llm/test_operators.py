"""The training-data operators against brute force on small tables, and on odd input."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

from trellis.llm import decontaminate, licenses, line_dedup, near_dedup, pieces, pii, quality, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, row string"
WORDS = "the of and river stone cloud table green seven paper light north music water glass".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long = prose(1, 9000)
    rows = [
        (1, prose(2, 80), "en", "s", 5, 1, "x"), (1, prose(2, 80), "en", "s", 5, 1, "x"), (2, prose(2, 80), "en", "s", 5, 1, "x"),
        (3, None, None, None, None, None, None), (None, prose(3, 60), "xx", "s", 1, 0, "y"), (None, None, None, None, None, None, None),
        (4, "", "fr", "s", 0, 1, ""), (5, " \n\t ", "de", "s", 4, 1, ""), (6, long, "en", "s", 1, 1, "z"), (7, long + " end", "en", "s", 1, 1, "z"),
        (8, "word", "es", "s", 4, 1, ""), (9, "a\nb\n" + prose(4, 70) + "\n" + prose(5, 70), "en", "s", 1, 1, ""), (10, prose(4, 70) + "\nnew line\n" + prose(4, 70), "en", "s", 1, 1, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_input_does_not_crash(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, " ".join(prose(4, 70).split()[5:40])), (2, None), (None, ""), (3, "word")], "item_id long, text string")
    for df, n in ((odd, 13), (odd.limit(0), 0)):
        assert quality.judge(df, "doc_id").count() == n
        assert set(quality.keep_good(df).columns) == set(df.columns)
        assert line_dedup.dedup(df).count() == n
        assert line_dedup.drop_repeats(df).columns == df.columns
        assert near_dedup.cluster(df).count() == n
        assert near_dedup.keep_one(df).columns == df.columns
        assert pieces.encode(df).where("exact").count() == n
        assert pii.find(df).count() == n
        assert sharding.shard(df).count() == n
        assert toxicity.score(df, toxicity.train(df, labels)).count() == n
        assert toxicity.score(df, toxicity.train(df, labels.limit(0))).count() == n
        assert decontaminate.contaminated(df, items.limit(0)).count() == 0
        assert decontaminate.contaminated(df, items).count() == (3 if n else 0)
        assert warc.round_trip(df.select(F.col("doc_id").alias("page_id"), "source", F.col("lang").alias("url"), F.col("text").alias("html"))).count() == n
        files = df.select(F.col("doc_id").alias("key"), F.concat_ws("/", "source", "lang").alias("path"), "text")
        assert licenses.inherit(licenses.scan(files)).count() == n


def test_base_counts(spark, odd):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    extra = [(20, "a b c a b c a b c d", "en"), (21, "a\x0bb\x0cc\rd e f # $$ <x>\na\n\na", "en"), (22, "é 漢 é 漢 é 漢 é", "fr"), (23, "x x x", None), (24, "x x x x", None)]
    df = odd.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    for r in quality.judge(df.withColumn("raw", F.col("text")), "doc_id", "raw").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.raw)
        assert not (r.base_failed and r.kept)


def test_lines_meet_by_shuffles(spark, monkeypatch):
    gone, plain = [], line_dedup.Workspace.drop
    monkeypatch.setattr(line_dedup.Workspace, "drop", lambda self, *names: gone.extend(names) or plain(self, *names))
    docs = [(k, "\n".join(["one two three", "four five six", f"alone {k}"])) for k in range(20)]
    out = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 * plan.count("SortMergeJoin") == 2  # the bits, for both kinds of rows, and the lines that go
    assert {"line", "rank0", "spans"} <= set(gone)
    assert {r.row.doc_id: r.text for r in out.collect()} == {k: t if k == 0 else f"alone {k}" for k, t in docs}


@pytest.mark.parametrize("least", [3, 7])
def test_line_runs(spark, least):
    r = random.Random(least)
    lines = ["a b", "c", "d e f", "g", "h i", "", " "]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for i in range(50)]
    seqs = {d: [(i, x) for i, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs}
    gone = defaultdict(set)
    for d, s in seqs.items():
        for p in range(len(s)):
            best = 0
            for e, z in seqs.items():
                for q in range(len(z)):
                    if (e, q) < (d, p):
                        m = 0
                        while p + m < len(s) and q + m < len(z) and s[p + m][1] == z[q + m][1]:
                            m += 1
                        best = max(best, m)
            if sum(len(s[p + k][1].split()) for k in range(best)) >= least:
                gone[d] |= {s[p + k][0] for k in range(best)}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least).select("row.doc_id", "text").collect()}
    assert got == want and any(gone.values())


@pytest.mark.parametrize("small", [64, 6])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    r = random.Random(5)
    base = [f"w{r.randint(0, 3000)}" for _ in range(120)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 16)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 200)}"
        docs.append((i * 3 + 1, " ".join(w)))
    docs += [(1000 + i, " ".join(f"t{r.randint(0, 3)}" for _ in range(r.randint(0, 7)))) for i in range(40)] + [(2000, None), (2001, "A"), (2002, "a")]
    sets = {}
    for d, t in docs:
        w = (t or "").lower().split()
        sets[d] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == {d: (len(s), find(d)) for d, s in sets.items()}


def test_scan_of_giant_documents_is_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(2)
    texts = ["".join(r.choice("ab  é漢<the>\n") for _ in range(300)) for _ in range(20)] + [prose(k, 200).replace(" ", "" if k % 2 else " ") for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (37, 100):
        out = pieces.encode(df, chunk=chunk).collect()
        assert all(x.exact and x.ids == library.encode(texts[x.doc_id]) for x in out) and len(out) == len(texts)
    assert pieces.encode(spark.createDataFrame([(1, "a▁b ▁")], "doc_id long, text string")).first().exact


def test_decontamination_is_exact():
    items = [(k, prose(100 + k, 20 + k)) for k in range(40)]
    index = decontaminate.Index(items)
    r = random.Random(1)
    for k in range(200):
        w = dict(items)[k % 40].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        text = prose(500 + k, r.randint(0, 90)) + " " + " ".join(w) + " " + prose(900 + k, r.randint(0, 90))
        shingles = decontaminate._shingles(decontaminate._terms(text))
        want = set()
        for i, (whole, question, answer) in enumerate(index.parts):
            share = lambda s: sum(x in shingles for x in s) / len(s)
            if share(whole) >= 0.8 and share(question) >= 0.5 and share(answer) >= 0.5:
                want.add(i)
        assert set(index.matches(text)) == want


def test_warc_round_trip(spark):
    pages = [(3, "http://a/", "x"), (1, None, "x"), (2, "http://b/\r\nX: y", "é" * 5000), (4, "u", ""), (5, "u", None), (None, "u", "x")]
    out = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out}
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {(1, 1, sha("x"), "response", None), (3, 1, sha("x"), "revisit", 1), (None, 1, sha("x"), "revisit", 1), (2, 10000, sha("é" * 5000), "response", None), (4, 0, sha(""), "response", None), (5, 0, sha(""), "revisit", 4)}


def test_normaliser_index_gives_every_record():
    import io
    import json

    raws = [warc.record(k, f"u{k}", bytes([k]) * k * 1000) for k in range(20)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(z.compress(b"".join(raws)) + z.flush()), out, index) == 20
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    assert [zlib.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]], 31) for e in entries] == raws


def test_shards_are_even_and_maps_move_little(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(5000)], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 120
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weights = {k: 100 + k % 7 for k in range(600)}
    old = sharding.assign(weights, 600, 24)
    new = sharding.rebalance(old, weights, 25)
    moved = [k for k in old if old[k] != new[k]]
    assert all(new[k] == 24 for k in moved) and 20 <= len(moved) <= 30
    versions = sharding.SlotMap(spark, sharding.shared_dir(spark) + "/test-map")
    versions.write(1, old)
    assert versions.edit(1, weights, 23) == versions.read(2) and set(versions.read(2).values()) == set(range(23))


def test_a_map_outlives_a_run(spark):
    root = sharding.shared_dir(spark) + "/lasting-map"
    base = [(i, f"text {i} " + "y" * (i % 53)) for i in range(1500)]
    hot = [(9999, "z" * 3000)] * 60
    rows = lambda some: {(r.doc_id, r.text_crc32): (r.shard, r.virtual_slot) for r in sharding.shard(spark.createDataFrame(some, "doc_id long, text string"), 4, 64, root).collect() if r.doc_id != 9999}
    one = rows(base)
    assert sharding.SlotMap(spark, root).last() == 2 and rows(base) == one and sharding.SlotMap(spark, root).last() == 3
    # A slot that becomes hot is cut; the other records keep their slots, and few of them move.
    two = rows(base + hot)
    kept = sharding.pieces_of(sharding.SlotMap(spark, root).read(4), 64)
    assert kept and all(n & (n - 1) == 0 for n in kept.values())
    assert all(two[k][1] == v[1] for k, v in one.items() if v[1] % 64 not in kept)
    again = rows(base + hot)
    assert all(again[k][1] == v[1] for k, v in two.items()) and sum(again[k][0] != v[0] for k, v in two.items()) <= len(base) // 10


def test_toxic_documents_held_out(spark):
    r = random.Random(3)
    bad = ["vile", "moronic", "scummy", "worthless"]
    text = lambda k, t: " ".join(prose(k, 60).split() + ([r.choice(bad) for _ in range(4)] if t else []))
    rows = [(k, text(k, k % 8 == 0), int(k % 8 == 0)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.train(df.select("doc_id", "text"), df.where("doc_id < 500").select("doc_id", "toxic"))
    held = toxicity.score(df.where("doc_id >= 500").select("doc_id", "text"), chain).collect()
    right = sum(x.toxic == (x.doc_id % 8 == 0) for x in held) / len(held)
    assert right >= 0.97 and chain.out_of_fold.shape[1] == len(toxicity.CATEGORIES)


def test_licences_inherit_from_the_nearest_directory(spark):
    apache, mit = licenses.TEMPLATES["Apache-2.0"][0], licenses.TEMPLATES["MIT"][1]
    files = [(1, "a/LICENSE", mit), (2, "a/b/LICENSE", apache), (3, "a/b/c/x.py", prose(1, 50)), (4, "a/y.py", prose(2, 50)), (5, "z/q.py", prose(3, 50)), (6, "a/b/h.py", prose(4, 30) + "\nReleased under the MIT License.\n" + prose(5, 30))]
    out = {r.key: r for r in licenses.inherit(licenses.scan(spark.createDataFrame(files, "key long, path string, text string"))).collect()}
    assert (out[1].licence, out[2].licence, out[6].licence) == ("MIT", "Apache-2.0", "MIT") and out[1].is_file and not out[6].is_file
    assert (out[3].inherited, out[3].from_dir, out[4].inherited, out[5].inherited) == ("Apache-2.0", "a/b", "MIT", None)


def test_base_patterns_and_added_spans(spark):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"]
    r = random.Random(4)
    for _ in range(2000):
        t = "".join(r.choice("a1@.-+ 9") for _ in range(40))
        assert list(pii._emails(t)) == [m.span() for m in re.finditer(patterns[0], t)]
        assert [m.span() for m in pii._IP.finditer(t)] == [m.span() for m in re.finditer(patterns[1], t)]
    text = "write to ann.lee@mail.org or 10.0.0.300 or 10.0.0.30, card 4012888888881881 not 4012888888881882, call +1 (212) 555-0147\nthe password=da90f32ccfa9408d1c was here"
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",")) if k == "secret"] == ["password=da90f32ccfa9408d1c"]


def test_positions_beyond_any_packing(spark):
    """Counts of texts whose length is just below, at and above a power of two."""
    texts = [" ".join(["a b c"] + [f"w{i}" for i in range(n - 6)] + ["a b c"]) for n in (15, 16, 17, 127, 128, 129, 4095, 4096, 70000)]
    got = quality.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), "doc_id").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_repeat_words) for r in got] == [(len(t.split()), 6) for t in texts]


def test_shards_are_even_with_equal_rows(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(20000)] + [(None, None)] * 10000 + [(7, "y" * 50)] * 3000, "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == 33000 and len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 0.011 * sum(sizes.values()) / 24 + 150
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r.map_version for r in rows} == {2}
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in [(i, "x" * (i % 97)) for i in range(20000)] + [(None, "")] * 10000 + [(7, "y" * 50)] * 3000)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
