"""What is shuffled and written grows with the tables: one row for a class, a parent or an edge, none for their pairs."""

from types import SimpleNamespace

import pytest

from trellis.operators import bitmaps, closure, impact, rules


@pytest.fixture
def tables(monkeypatch):
    """The row counts of the tables that rounds count."""
    seen, plain = [], closure.Rounds.counted

    def counted(self, df, which=None):
        out, n = plain(self, df, which)
        seen.append(out.count())
        return out, n

    monkeypatch.setattr(closure.Rounds, "counted", counted)
    return seen


def test_shared_aspects_by_class(spark, monkeypatch):
    rows = [(f"n{i}", a) for i in range(60) for a in (("x", "y") if i % 3 else ("z",))] + [("n0", "y"), ("alone", "w")]
    have = {}
    for n, a in rows:
        have.setdefault(n, set()).add(a)
    want = {n: sum(m != n and bool(have[m] & have[n]) for m in have) for n in have}
    met, plain = [], bitmaps.along
    monkeypatch.setattr(bitmaps, "along", lambda steps, sets: met.append(steps.count()) or plain(steps, sets))
    got = impact.co_aspect_counts(SimpleNamespace(nodes=spark.range(1)), spark.createDataFrame(rows, "node string, aspect string"))
    assert {r.target: r.n_nodes for r in got.collect()} == want
    assert met == [6]  # {x, y}, {z}, {y, z} and {w}


def test_siblings_are_gathered_once_for_a_parent(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"m/n{i}", "m") for i in range(3)] + [("m", None)], "path string, parent_path string")
    broken = spark.createDataFrame([("m/a",), ("m/b",), ("top",), ("q/x",)], "target string")
    met, plain = [], rules.written
    monkeypatch.setattr(rules, "written", lambda df: met.append(plain(df)) or met[-1])
    got = {r.target: (r.n_siblings, r.siblings) for r in rules.siblings(broken, nodes).collect()}
    assert got == {"m/a": (3, "n0, n1, n2"), "m/b": (3, "n0, n1, n2"), "top": (1, "m")}
    assert {r.parent for r in met[-1].collect()} == {"m", ""} and met[-1].count() == 2


def test_reach_from_roots_leaves_other_nodes_out(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d")] + [(f"x{i}", "b") for i in range(20)]
    pairs, names = closure.numbered_reach(spark.createDataFrame(rows, "src string, dst string"), None, spark.createDataFrame([("a",)], "root string"))
    assert {r.name for r in names.collect()} == set("abcd") and sorted(r.depth for r in pairs.collect()) == [1, 2, 3]


def test_levels_run_over_what_others_lead_to(spark, tables):
    rows = [("a", "b"), ("b", "c")] + [(f"x{i}", "a") for i in range(20)]
    nodes = spark.createDataFrame([(n,) for n in sorted({n for r in rows for n in r})], "node string")
    got = {r.node: r.stage for r in closure.stages(nodes, spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {"c": 1, "b": 2, "a": 3} | {f"x{i}": 4 for i in range(20)}
    assert max(tables) == 3


@pytest.mark.parametrize("n", [2, 70])
def test_flags_of_pairs(spark, n):
    from trellis.sources import star

    rows = [(i % 5, 1, f"f{i % n}") for i in range(2 * n)] + [(9, 9, None), (0, 1, None)]
    want = {}
    for s, _, f in rows:
        want.setdefault(s, set()).update({f} - {None})
    out = star.flags_of(spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_returnflag string"), ["l_suppkey", "l_partkey"])
    assert {r.l_suppkey: r.consumes for r in out.collect()} == {s: sorted(f) for s, f in want.items()}
    assert ("ObjectHashAggregate" in out._jdf.queryExecution().toString()) == (n > 63)


def test_numbers_follow_numbers_in_names(spark):
    names = ["lib/a/p10", "lib/b/p9", "x/p100", "lib/a/p9"]
    rows = spark.createDataFrame([(n, 0) for n in names] + [("a", 1)], "name string, group int")
    got = bitmaps.numbered(closure.Rounds(spark, "test"), rows).orderBy("id").collect()
    assert [r.name for r in got] == ["lib/a/p9", "lib/b/p9", "lib/a/p10", "x/p100", "a"]


def test_sets_of_tops_stay_out_of_rounds(spark, monkeypatch):
    n = 3 * bitmaps.NEAR
    edges = [(1, 2), (2, 3), (3, 1), (3, n), (n, n + 1)] + [(100 + i, 1 + i % 2) for i in range(20)] + [(200, n + 1), (200, 200)]
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
    want = {}
    for a in down:
        seen, todo = set(), [a]
        while todo:
            more = down.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        want[a] = seen
    met, plain = [], closure.Rounds.write
    monkeypatch.setattr(closure.Rounds, "write", lambda self, df: met.append(plain(self, df)) or met[-1])
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    out = bitmaps.reach_bits(closure.Rounds(spark, "test"), spark.createDataFrame(edges, "root long, node long")).collect()
    got = {}
    for r in out:
        got.setdefault(r.root, set()).update(r.block * bitmaps.BITS + 64 * j + i for j in range(bitmaps.WORDS) for i in range(64) if r[f"w{j}"] >> i & 1)
    assert got == want and len({(r.root, r.block) for r in out}) == len(out)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    sets = [{r.root for r in x.select("root").distinct().collect()} for x in met if "block" in x.columns]
    assert sets == [{1, 2, 3, n, 200}, {100 + i for i in range(20)}]


def test_packages_join_nodes_by_shuffles(spark):
    from trellis.operators import context
    from trellis.sources import star

    a = context.Assembly(star.from_star_schema(spark, "/root/testdata/sf0.001"))
    for df in (a.here(a.member), closure.written(a.g.node_aspects.select("path")).withColumnRenamed("path", "node").transform(a.here)):
        plan = df._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_changes_read_written_relations(spark, monkeypatch):
    from trellis.plans import deep

    seen = []
    monkeypatch.setattr(deep.context, "budget", lambda g: spark.range(1))
    monkeypatch.setattr(deep.delta, "budget_changes", lambda before, after, stored: seen.extend([before, after]))
    deep.budget_changes(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any("lineitem" in f for g in seen for f in g.relations.inputFiles())


def test_pairs_are_no_rows_of_rounds(spark, tables):
    n, tops = 9, 200
    rows = [(f"c{i}", f"c{i + 1}") for i in range(n)] + [(f"c{n}", f"c{n - 1}")] + [(f"t{i}", "c0") for i in range(tops)]
    down, want = {}, {}
    for a, b in rows:
        down.setdefault(a, []).append(b)
    for a in down:
        near = now = set(down[a])
        want, d = want | {(a, x): 1 for x in now}, 1
        while now:
            now, d = {y for x in now for y in down[x]} - near, d + 1
            near, want = near | now, want | {(a, x): d for x in now}
    got = closure.reach(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert {(r.root, r.node): r.depth for r in got} == want and len(got) == len(want) > n * tops
    assert max(tables) < 40


def test_tracked_files_leave_relations_as_they_are(spark):
    import re

    from trellis.operators import drift
    from trellis.sources import star

    out = drift.tracked(star.from_star_schema(spark, "/root/testdata/sf0.001"))
    assert not re.search(r"Aggregate \[node#\d+, dst#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
    assert out.count() == out.select("node", "path").distinct().count() > 0


def test_text_of_a_relation_is_made_once(spark):
    from trellis.functions.text import units
    from trellis.operators import context
    from trellis.sources import star

    texts = ["", "plain", "né", "\U0001d11e x", " ", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", units("t").alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: None if t is None else len(t.encode("utf-16-be")) // 2 for i, t in enumerate(texts)}
    plan = context.sums(star.from_star_schema(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS said#") == 1 and "octet_length(said#" in plan


@pytest.mark.parametrize("depths", [False, True])
def test_sets_by_levels_against_breadth_first(spark, depths):
    import random

    r = random.Random(5)
    n, far = 40, 3 * bitmaps.BITS
    rows = {(a, r.randrange(max(a - 9, 0), a)) for a in range(1, n) for _ in range(2)} | {(far + i, r.randrange(n)) for i in range(60)}
    rows |= {(100, 101), (101, 102), (102, 100), (102, 30), (7, 103), (103, 104), (104, 103), (50, 50), (50, 3), (5, 5), (200, 201), (201, 201), (far + 1, 100)}
    down, want = {}, {}
    for a, b in rows:
        down.setdefault(a, set()).add(b)
    for a in down:
        near, now, d = set(), down[a], 1
        while now:
            want |= {(a, x): d for x in now}
            near, now, d = near | now, {y for x in now for y in down.get(x, ())} - near - now, d + 1
    df = spark.createDataFrame(sorted(rows) + sorted(rows)[:5], "root long, node long")
    out = bitmaps.reached(closure.Rounds(spark, "test"), df, depths).collect()
    bits = [((x.block * bitmaps.BITS + 64 * j + i, x.root), x.depth if depths else 1) for x in out for j in range(bitmaps.WORDS) for i in range(64) if x[f"w{j}"] >> i & 1]
    assert len(bits) == len(dict(bits)) and dict(bits) == {k: d if depths else 1 for k, d in want.items()}
    if depths:
        short = bitmaps.listed(bitmaps.reached(closure.Rounds(spark, "test"), df, True, 3), spark.createDataFrame([(i, str(i)) for i in {x for row in rows for x in row}], "id long, name string"))
        assert {(int(x.name), int(x.root)): x.depth for x in short.collect()} == {k: d for k, d in want.items() if d <= 3}
    else:
        total = {x.root: x.n for x in bitmaps.bit_counts(bitmaps.reached(closure.Rounds(spark, "test"), df)).collect()}
        assert total == {a: sum(k[0] == a for k in want) for a in down}


def test_each_set_is_written_once(spark, monkeypatch):
    met, plain = [], closure.Rounds.write
    monkeypatch.setattr(closure.Rounds, "write", lambda self, df, *by: met.append(plain(self, df, *by)) or met[-1])
    edges = [(f"n{i}", f"n{i + k}") for i in range(6) for k in (1, 2)] + [(f"t{i}", "n0") for i in range(9)]
    got = {r.root: (r.n_direct, r.n_total) for r in impact.needs(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {f"n{i}": (2, 7 - i) for i in range(6)} | {f"t{i}": (1, 8) for i in range(9)}
    sets = [r.root for x in met if "block" in x.columns and "level" not in x.columns for r in x.collect()]
    assert len(sets) == len(set(sets)) == 8
