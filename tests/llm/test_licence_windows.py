"""Licence notices that are wrapped, inside longer lines, or whole licence files."""

import random
from collections import Counter

import pytest

from trellis.llm import licenses

T = licenses.Templates(full=licenses.bodies())
GPL, BSD, APACHE = licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["BSD-3-Clause"][0], licenses.TEMPLATES["Apache-2.0"][0]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"{r.choice(['river', 'the', 'stone', 'of', 'table'])}{r.randint(0, 30)}" for _ in range(n))


def wrapped(text, mark, width):
    words = text.split()
    return "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
@pytest.mark.parametrize("name, notice", [("GPL-3.0", GPL), ("BSD-3-Clause", BSD)])
def test_wrapped(mark, name, notice):
    for width in (4, 7, 11):
        assert T.scan(prose(1, 90) + "\n" + wrapped(notice, mark, width) + "\n" + prose(2, 200))[::2] == (name, False)


def test_inside_a_line():
    assert T.scan(prose(3, 80) + " " + APACHE + " " + prose(4, 80))[0] == "Apache-2.0"
    assert T.scan(prose(3, 300)) == (None, 0.0, False)


def test_licence_files():
    for name, (text,) in licenses.bodies().items():
        assert T.scan(text)[::2] == (name, True), name
        assert T.scan(" ".join(text.split()))[::2] == (name, True), name


def test_windows_against_brute_force():
    r = random.Random(5)
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for _ in range(20):
        words = licenses._tokens(prose(r.random(), 20) + " " + " ".join(w for w in r.choice(every).split() if r.random() > 0.15) + " " + prose(r.random(), 20))
        all_ = [(T.cosine(k, Counter(words[i : i + n])), T.names[k]) for k, n in enumerate(T.widths) for i in range(max(1, len(words) - n + 1))]
        best = min(((-c, name) for c, name in all_ if c >= licenses.MIN_COSINE), default=None)
        assert best == min(((-c, name) for c, name, _, _ in T.windows(words)), default=None)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    notices = [None, None, None, GPL, BSD, APACHE, licenses.bodies()["MIT"][0] if "MIT" in licenses.bodies() else BSD]
    rows = []
    for k in range(140):
        notice = rng.choice(notices)
        text = rng.choice([None, ""]) if k % 19 == 0 else prose(k, 60) + (" " + notice if notice else "")
        rows.append((None if k % 23 == 0 else k * 5, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s/2", None])))
    rows.append(rows[3])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in licenses.op6_licenses(spark, str(tmp_path)).select("doc_id", "licence", "is_file", "inherited", "from_dir").collect()), key=str)
    part = lambda x: (x or "?").replace("/", "_") if x is not None else "?"
    one = [(d, None if d is None else f"{part(s)}/{part(l)}/{d // 64}", T.scan(t)) for d, t, l, s in rows]
    by = {}
    for _, at, (name, _, is_file) in one:
        if at and name:
            by.setdefault(at, {}).setdefault(name, [0, 0])
            by[at][name][0] -= bool(is_file)
            by[at][name][1] -= 1
    best = {at: min((*n, name) for name, n in some.items())[2] for at, some in by.items()}
    want = []
    for d, at, (name, _, is_file) in one:
        up = ["/".join(at.split("/")[:k]) for k in range(len(at.split("/")), -1, -1)] if at else []
        near = next((u for u in up if u in best), None) if name is None else None
        want.append((d, name, is_file, best.get(near), near))
    assert got == sorted(want, key=str)
    assert all(r[3] is None for r in got if r[0] is None)


def test_directories_are_not_broadcast(spark, tmp_path):
    rows = [(i, f"s{i % 3}/en/{i // 8}/{i}", "MIT" if i % 7 == 0 else None, 0.0, i % 14 == 0) for i in range(200)] + [(200, None, None, 0.0, False)]
    spark.createDataFrame(rows, "key long, path string, licence string, cosine double, is_file boolean").write.parquet(f"{tmp_path}/scanned")
    out = licenses.inherit(spark.read.parquet(f"{tmp_path}/scanned"))
    found = {r.key: r.inherited for r in out.collect()}
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    own = {i: f"s{i % 3}/en/{i // 8}" for i in range(200)}
    have = {own[i] for i in range(200) if i % 7 == 0}
    assert found == {i: "MIT" if i % 7 and own[i] in have else None for i in range(200)} | {200: None}
