"""Reachable sets as blocks of bits, for counts and unions that need no row for each pair.

Nodes are numbered; a set is rows (root, block) of WORDS longs, bit i of a block standing for the node with number
block * BITS + i. Sets are united by ``bit_or`` and counted by ``bit_count``, so a row stands for up to BITS pairs and
sums are partial in every task. Numbers follow (group, name), which puts what a root reaches close together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds, dealt

#: Longs in a row; more make fewer rows of dense sets, and larger rows of sparse ones.
WORDS = 8
BITS = 64 * WORDS
#: Nodes whose sets are united in one task.
NEAR = 8 * BITS
#: Steps that one round of ``reach_bits`` goes, as a power of two.
STRIDE_ROUNDS = 2
#: Parts that the rows of a block are dealt to where they become pairs.
SPREAD = 16
#: Edges or nodes that may be broadcast; rounds of ``_levels`` after which nodes that are done leave; blocks whose sums a task holds.
FEW, AT_ONCE, MOST_SUMS = 50_000, 4, 4096
_W = [f"w{j}" for j in range(WORDS)]


def numbered(rounds: Rounds, names: DataFrame) -> DataFrame:
    """(id, name) of distinct ``names`` (name, group), written; ids rise with (largest group, name).

    Names go by their last part first, shorter ones before longer ones, so that numbers in names count as numbers.
    """
    one = names.groupBy("name").agg(F.max("group").alias("group"))
    last = F.element_at(F.split("name", "/"), -1)
    return rounds.write(one.orderBy("group", F.length(last), last, "name").select(F.monotonically_increasing_id().alias("id"), "name"))


def by_number(rows: DataFrame, numbers: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with names in ``columns`` replaced by their numbers; rows with a name that has none go."""
    for c in columns:
        rest = [x for x in rows.columns if x != c]
        rows = rows.join(numbers.select(F.col("id").alias("_id"), F.col("name").alias(c)), c).select(*rest, F.col("_id").alias(c))
    return rows


def bits(pairs: DataFrame) -> DataFrame:
    """(root, block, w...) of each of the pairs (root, node) of numbers."""
    at = F.pmod("node", F.lit(BITS)).cast("int")
    word = lambda j: F.when(F.floor(at / 64) == j, F.expr("shiftleft(1L, cast(pmod(node, 64) AS int))")).otherwise(F.lit(0).cast("long")).alias(_W[j])
    return pairs.select("root", F.floor(F.col("node") / BITS).alias("block"), *(word(j) for j in range(WORDS)))


def bits_of(pairs: DataFrame) -> DataFrame:
    """(root, block, w...) of pairs (root, node) of numbers, united."""
    return united(bits(pairs))


def united(rows: DataFrame) -> DataFrame:
    """One row for each root and block."""
    return rows.groupBy("root", "block").agg(*(F.bit_or(w).alias(w) for w in _W))


def size() -> Column:
    """How many bits a row has."""
    return reduce(lambda a, b: a + b, (F.bit_count(w) for w in _W)).cast("long")


def counts(rows: DataFrame) -> DataFrame:
    """(root, n): the sizes of united sets."""
    return rows.groupBy("root").agg(F.sum(size()).alias("n"))


def weights(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(root, n): for each root the summed ``sizes`` (node, n) of the nodes in its united sets; a block has one list of sizes."""
    at = F.pmod("node", F.lit(BITS)).cast("int")
    listed = sizes.groupBy(F.floor(F.col("node") / BITS).alias("block")).agg(F.collect_list(F.struct(F.floor(at / 64).cast("int").alias("word"), F.pmod(at, F.lit(64)).alias("bit"), "n")).alias("sizes"))
    one = lambda sum_, x: sum_ + F.getbit(F.element_at(F.array(*_W), x["word"] + 1), x["bit"]).cast("long") * x["n"]
    return rows.join(listed, "block").groupBy("root").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), one)).alias("n"))


def without_root(rows: DataFrame) -> DataFrame:
    """The sets without the root itself."""
    mine = (F.floor(F.col("root") / BITS) == F.col("block")) & F.lit(True)
    own = F.expr("shiftleft(1L, cast(pmod(root, 64) AS int))")
    clear = lambda j: F.when(mine & (F.floor(F.pmod("root", F.lit(BITS)) / 64) == j), F.col(_W[j]).bitwiseAND(F.bitwise_not(own))).otherwise(F.col(_W[j])).alias(_W[j])
    return rows.select("root", "block", *(clear(j) for j in range(WORDS)))


def along(steps: DataFrame, sets: DataFrame) -> DataFrame:
    """(root, block, w...): for each root the union of the sets of the nodes that ``steps`` (root, node) lead to."""
    return united(steps.join(sets.withColumnRenamed("root", "node"), "node").select("root", "block", *_W))


def along_near(rounds: Rounds, steps: DataFrame, sets: DataFrame) -> DataFrame:
    """``along`` with the nodes of ``steps`` themselves, written. A stretch of NEAR numbers is dealt to one task: what a root
    leads to lies close together and so do its sets, so most of a root's rows are united before they are shuffled, at
    any number of partitions."""
    near = F.floor(F.col("node") / NEAR)
    dealt, there = (df.withColumn("near", near).repartition("near") for df in (steps.select("root", "node"), sets.withColumnRenamed("root", "node")))
    together = "spark.sql.requireAllClusterKeysForCoPartition"
    conf, before = rounds.spark.conf, rounds.spark.conf.get(together)
    conf.set(together, "false")  # rows dealt by the stretch alone may be joined by stretch and node
    try:
        return rounds.write(united(dealt.join(there, ["near", "node"]).select("root", "block", *_W).unionAll(bits(dealt))))
    finally:
        conf.set(together, before)


def reach_bits(rounds: Rounds, edges: DataFrame) -> DataFrame:
    """(root, block, w...): what each node reaches over ``edges`` (root, node) of numbers; safe on cycles.

    A leaf has no set, and the set of a node that nothing leads to serves no other. So rounds run over the edges between
    the others alone. There, paths of up to 2^STRIDE_ROUNDS steps are found by doubling, and every round sends the
    bits that were new in the last one along all of these at once: each bit passes each of them once. What is new
    is told by the bits known so far; a round is one written, counted table. The nodes that nothing leads to then
    unite the sets they lead to, each edge once; until then they have no rows.
    """
    edges = rounds.write(edges.select("root", "node").distinct())
    parents, children = edges.select(F.col("root").alias("node")).distinct(), edges.select(F.col("node").alias("root")).distinct()
    edges = edges.join(parents.withColumn("leads", F.lit(True)), "node", "left").join(children.withColumn("led", F.lit(True)), "root", "left")
    edges = rounds.write(edges.select("root", "node", F.col("leads").isNotNull().alias("leads"), F.col("led").isNotNull().alias("led")))
    core = edges.where("leads and led").select("root", "node", F.lit(1).alias("d"))
    for k in range(STRIDE_ROUNDS):
        core = rounds.write(core) if k == 0 else core
        outer = core.where(F.col("d") == 2**k).select("root", F.col("node").alias("mid"))
        core = core.unionAll(outer.join(core.select(F.col("root").alias("mid"), "node", F.col("d").alias("e")), "mid").select("root", "node", F.col("e") + 2**k))
        core = core.groupBy("root", "node").agg(F.min("d").alias("d"))
    steps = rounds.write(core.select("root", "node").where("root <> node"))
    known = new = rounds.write(bits_of(edges.where("led")))
    parts = [known]
    while True:
        sent = along(steps, new).join(known.select("root", "block", *(F.col(w).alias(f"k{w}") for w in _W)), ["root", "block"], "left")
        fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"k{w}", F.lit(0).cast("long")))).alias(w) for w in _W]
        new, n = rounds.counted(sent.select("root", "block", *fresh).where(" or ".join(f"{w} <> 0" for w in _W)))
        if not n:
            break
        parts.append(new)
        known = united(reduce(DataFrame.unionAll, parts))
    return known.unionAll(along_near(rounds, edges.where("not led"), known))


def _levels(rounds: Rounds, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of distinct ``edges`` (root, node) of numbers: those (root, node) whose ``root`` others lead to, written; (node, level) of the nodes
    that others lead to, written; and the highest level. A level is the longest path that leads to a node; nodes on a
    cycle or behind one have level 0. Loops lead nowhere.
    """
    plain = edges.where("root <> node")
    inner = rounds.write(plain.select("node").distinct())
    core = rounds.write(plain.join(dealt(inner.select(F.col("node").alias("root"))), "root", "left_semi").select("root", "node"))
    left = inner.join(core.groupBy("node").agg(F.count("*").alias("open")), "node", "left").select("node", F.coalesce("open", F.lit(0)).cast("long").alias("open"))
    left, ready = rounds.counted(left, F.col("open") == 0)
    at, level, live = left.where("open = 0").select("node", F.lit(1).alias("level")), 1, core
    while ready:
        gone = left.where("open = 0").select(F.col("node").alias("root"))
        if level % AT_ONCE == 0:
            live = rounds.write(live.join(dealt(left.select(F.col("node").alias("root"))), "root", "left_semi").select("root", "node"))
        closed = live.join(gone if ready <= FEW else dealt(gone), "root", "left_semi").groupBy("node").agg(F.count("*").alias("closed"))
        level += 1
        left, ready = rounds.counted(left.where("open > 0").join(closed, "node", "left").select("node", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")), F.col("open") == 0)
        at = at.unionAll(left.where("open = 0").select("node", F.lit(level).alias("level")))
    return core, rounds.write(at.unionAll(left.select("node", F.lit(0).alias("level")))), level - 1


def _first_depths(rows: DataFrame) -> DataFrame:
    """Rows (root, block, w..., depth) united, each bit in the row of its least depth alone."""
    one = rows.repartition("root", "block").groupBy("root", "block", "depth").agg(*(F.bit_or(w).alias(w) for w in _W))
    less = Window.partitionBy("root", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumns({f"k{w}": F.bit_or(w).over(less) for w in _W})
    return _fresh(one, "depth")


def _fresh(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (root, block, w..., kw..., more) without the bits that are known (kw...); empty ones go."""
    fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"k{w}", F.lit(0).cast("long")))).alias(w) for w in _W]
    return rows.select("root", "block", *fresh, *more).where(" or ".join(f"{w} <> 0" for w in _W))


def reached(rounds: Rounds, edges: DataFrame, depths: bool = False, max_depth: int | None = None) -> DataFrame:
    """(root, block, w...): for each node the roots that reach it over ``edges`` (root, node) of numbers; safe on cycles. With ``depths``
    there is a column ``depth``: a row has the roots of one block that are so many steps away, by the fewest.

    Sets lie the other way round than those of ``reach_bits``: roots with near numbers reach much the same nodes, while what one
    root reaches may lie anywhere, so these rows are fuller. Nodes are taken by ``_levels``: a node's set is whole once those of all
    nodes before it are, is written once and sent along each edge once, and no round looks at what is known. Only nodes on cycles or behind
    them, whose sets come last, have rounds that send the bits that were new in the last one.
    """
    edges = rounds.write(edges.select("root", "node").distinct())
    core, at, top = _levels(rounds, edges)
    more = ["depth"] if depths else []
    direct = united(bits(edges.select(F.col("node").alias("root"), F.col("root").alias("node"))))
    direct = direct.join(dealt(at.withColumnRenamed("node", "root")), "root", "left").withColumn("level", F.coalesce("level", F.lit(1)))
    direct = rounds.write(direct.withColumn("depth", F.lit(1).cast("long")) if depths else direct, "level")
    side = lambda c, level: dealt(at.select(F.col("node").alias(c), F.col("level").alias(level)))
    steps = rounds.write(core.join(side("root", "a"), "root").join(side("node", "b"), "node").select("root", "node", "a", "b"), "a", "b")
    n_steps = {(r.a, r.b): r.n for r in steps.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    merged = _first_depths if depths else united

    def sent(sets: DataFrame, a: int, b: int) -> DataFrame:
        way = steps.where(f"a = {a} and b = {b}").select(F.col("root").alias("_from"), F.col("node").alias("_to"))
        out = sets.join(F.broadcast(way) if n_steps[a, b] <= FEW else dealt(way), F.col("root") == F.col("_from"))
        out = out.select(F.col("_to").alias("root"), "block", *_W, *((F.col(c) + 1).alias(c) for c in more))
        return out.where(F.col("depth") <= max_depth) if max_depth is not None else out

    def came(level: int) -> DataFrame:
        rows = direct.where(F.col("level") == level).select("root", "block", *_W, *more)
        return reduce(DataFrame.unionAll, [sent(sets[a], a, level) for a, b in sorted(n_steps) if b == level and a], rows)

    sets: dict[int, DataFrame] = {}
    for level in range(1, max(top, 1) + 1):
        sets[level] = rounds.write(merged(came(level)))
    out = reduce(DataFrame.unionAll, sets.values())
    due, n_due = rounds.counted(merged(came(0)))
    if not n_due:
        return out
    last = due.agg(F.max("depth")).first()[0] if depths else 1
    begin = lambda d: due.where(F.col("depth") == d) if depths else due.where(F.lit(d == 1))
    new, n = rounds.counted(begin(1))
    parts, depth = [new], 1
    while n or depth < last:
        depth += 1
        known = united(reduce(DataFrame.unionAll, [p.select("root", "block", *_W) for p in parts])).select("root", "block", *(F.col(w).alias(f"k{w}") for w in _W))
        step = begin(depth).select("root", "block", *_W)
        if (0, 0) in n_steps and n:
            step = step.unionAll(sent(new, 0, 0).select("root", "block", *_W))
        fresh = _fresh(united(step).join(known, ["root", "block"], "left"))
        new, n = rounds.counted(fresh.withColumn("depth", F.lit(depth).cast("long")) if depths else fresh)
        parts.append(new)
    return reduce(DataFrame.unionAll, parts, out)


def bit_counts(rows: DataFrame) -> DataFrame:
    """(root, n): in how many of ``rows`` (block, w...) the bit of each number is. A task adds up whole blocks."""
    words = [f"w{j}" for j in range(WORDS)]

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def out():
            for block, n in sums.items():
                bit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(block * BITS + bit), pa.array(n[bit])], ["root", "n"])
            sums.clear()

        for b in batches:
            block = b["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            flags = np.unpackbits(np.stack([b[w].to_numpy() for w in words], 1)[order].view(np.uint8), axis=1, bitorder="little")
            blocks, begin = np.unique(block[order], return_index=True)
            for k, n in zip(blocks.tolist(), np.add.reduceat(flags, begin, axis=0, dtype=np.int64) if len(begin) else ()):
                sums[k] = sums[k] + n if k in sums else n
            if len(sums) > MOST_SUMS:
                yield from out()
        yield from out()

    return rows.select("block", *_W).repartition("block").mapInArrow(run, "root long, n long").groupBy("root").agg(F.sum("n").alias("n"))


def listed(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(name, root, ...): a row for each bit of ``rows`` (root, block, w..., more), ``root`` by its name and the bit's name as
    ``name``. A block has one list of names, so bits become pairs where they are read and pairs are not shuffled."""
    more = [c for c in rows.columns if c not in ("root", "block", *_W)]
    at = F.pmod("id", F.lit(BITS)).cast("int")
    word = numbers.groupBy(F.floor(F.col("id") / BITS).alias("block"), F.floor(at / 64).alias("word")).agg(F.collect_list(F.struct(F.pmod(at, F.lit(64)).alias("bit"), "name")).alias("names"))
    names = word.groupBy("block").agg(*(F.first(F.when(F.col("word") == j, F.col("names")), ignorenulls=True).alias(f"n{j}") for j in range(WORDS)))
    names = names.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = dealt(rows).join(numbers.select(F.col("id").alias("root"), F.col("name").alias("to")), "root")
    rows = rows.select(F.col("to").alias("root"), "block", F.pmod("root", F.lit(SPREAD)).cast("int").alias("part"), *_W, *more)
    # Few bytes make many pairs, so partitions are not put together by their bytes.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "part")
    named = lambda j: F.transform(F.filter(f"n{j}", lambda x: F.getbit(_W[j], x["bit"]) == 1), lambda x: x["name"])
    found = F.flatten(F.array(*(F.when(F.col(_W[j]) != 0, named(j)).otherwise(F.array().cast("array<string>")) for j in range(WORDS))))
    return dealt(rows).join(names, ["block", "part"]).select(F.explode(found).alias("name"), "root", *more)
