"""Components with cycles and their witnesses against a plain search."""

import random

from trellis.operators import cycles


def plain(edges, blackbox=()):
    """{component: (size, tolerated, path)} by closures over dictionaries."""
    key = lambda p: p.replace("/", "\x01")

    def groups(pairs):
        out = {}
        for a, b in pairs:
            out.setdefault(a, set()).add(b)
        reach = {}
        for v in out:
            seen, todo = set(), [v]
            while todo:
                for w in out.get(todo.pop(), ()):
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
            reach[v] = seen
        on = [v for v in reach if v in reach[v]]
        found = {frozenset(w for w in on if w in reach[v] and v in reach[w]) for v in on}
        return {min(f, key=key): (f, shortest(f, out)) for f in found}

    def shortest(members, out):
        walks = [(v, w) for v in members for w in out[v] if w in members and key(w) >= key(v)]
        while True:
            closed = [w for w in walks if w[0] == w[-1]]
            if closed:
                return min(closed, key=lambda w: [key(x) for x in w])
            best = {}
            for w in walks:
                for x in out[w[-1]]:
                    if x in members and key(x) >= key(w[0]):
                        step = (*w, x)
                        at = w[0], x
                        if at not in best or [key(y) for y in step] < [key(y) for y in best[at]]:
                            best[at] = step
            walks = list(best.values())

    bad = groups([(a, b) for a, b in edges if a not in blackbox and b not in blackbox])
    members = {v for f, _ in bad.values() for v in f}
    out = [(c, len(f), False, " -> ".join(w)) for c, (f, w) in bad.items()]
    for c, (f, w) in groups(edges).items() if blackbox else ():
        if not f & members:
            out.append((c, len(f), True, " -> ".join(w)))
    return sorted(out)


def test_known_cycles(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]  # two cycles sharing a node
    edges += [("s/x", "s/x"), ("s/x", "a"), ("p", "q"), ("q", "box"), ("box", "p"), ("p", "p2"), ("t1", "t2"), ("t2", "t3")]
    edges += [("m", "n"), ("n", "mid"), ("mid", "m"), ("mid", "o"), ("o", "mid")]  # one tolerated part, one not
    got = cycles.components(spark.createDataFrame(edges + edges[:3] + [("z", None), (None, "z")], "src string, dst string"), spark.createDataFrame([("box",), ("n",), (None,)], "node string"))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == plain(edges, {"box", "n"})
    assert ("a", 3, False, "a -> b -> a") in rows and ("box", 3, True, "box -> p -> q -> box") in rows and ("mid", 2, False, "mid -> o -> mid") in rows and ("s/x", 1, False, "s/x -> s/x") in rows


def test_random_graphs(spark):
    rng = random.Random(4)
    edges, boxes = [], set()
    for g in range(12):
        nodes = [f"g{g}/{rng.choice('ab')}/{k}" for k in range(rng.randrange(2, 14))]
        edges += [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(1, 26))]
        boxes |= set(rng.sample(nodes, 1))
    df = spark.createDataFrame(edges, "src string, dst string")
    assert sorted(tuple(r) for r in cycles.components(df).collect()) == plain(edges)
    boxed = cycles.components(df, spark.createDataFrame([(b,) for b in boxes], "node string"))
    assert sorted(tuple(r) for r in boxed.collect()) == plain(edges, boxes)


def test_no_cycles(spark):
    assert cycles.components(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0
    assert cycles.components(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "node string")).count() == 0


def test_hubs_stand_for_edges(spark):
    rng = random.Random(9)
    edges, short, hubs, boxes = [], [], [], set()
    for g in range(12):
        nodes = [f"g{g}/{rng.choice('ab')}/{k}" for k in range(rng.randrange(2, 12))]
        direct = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(0, 9))]
        edges, short = edges + direct, short + direct
        for h in range(2):
            into, onward = rng.sample(nodes, min(len(nodes), 3)), rng.sample(nodes, 2)
            if g % 2:
                onward = [n for n in onward if n not in into]
            edges += [(a, b) for a in into for b in onward]
            short += [(a, f"g{g}/{h}") for a in into] + [(f"g{g}/{h}", b) for b in onward]
            hubs.append((f"g{g}/{h}",))
        boxes |= set(rng.sample(nodes, 1))
    got = cycles.components(spark.createDataFrame(short, "src string, dst string"), spark.createDataFrame([(b,) for b in boxes], "node string"), hubs=spark.createDataFrame(hubs, "node string"))
    assert sorted(tuple(r) for r in got.collect()) == plain(edges, boxes)


def test_every_item_of_a_line_leads_on(spark, tmp_path):
    from trellis.plans import deep

    sold = [(1, 1, 10), (1, 1, 11), (1, 1, 12), (1, 1, 20), (1, 2, 11), (1, 2, 13), (1, 2, 14), (1, 2, 21), (2, 1, 13), (2, 2, 12), (2, 2, 22), (3, 1, 14), (3, 2, 10), (None, 1, 10), (None, 2, 10), (4, 1, 10), (4, 1, 10), (4, 2, 99)]
    items = [(i, f"B{i // 10}", 9.0) for i in (*range(10, 16), 20, 21, 22)]
    spark.createDataFrame(sold, "sale_id long, line_no int, item_id long").write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.createDataFrame(items, "item_id long, brand string, price double").write.parquet(f"{tmp_path}/items.parquet")
    brand = {i: b for i, b, _ in items}
    want = [(a, b) for s, n, a in sold for t, m, b in sold if s is not None and s == t and m == n + 1 and brand.get(a, 1) == brand.get(b, 2)]
    edges, _, hubs = deep.item_graph(spark, str(tmp_path))
    assert hubs.count() == 1 and edges.count() < len(want)
    name = "shop/B{0[0]}/i{0}".format
    got = sorted(tuple(r) for r in deep.cycle_components(spark, str(tmp_path)).collect())
    assert got == plain([(name(str(a)), name(str(b))) for a, b in want])
    assert ("shop/B1/i10", 5, False, "shop/B1/i11 -> shop/B1/i11") in got
