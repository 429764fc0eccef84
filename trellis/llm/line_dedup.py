"""Removal of repeated line runs by a distributed suffix array over line ids, DataFrame functions only.

A document is a sequence of line ids (lines with at least one word, compared exactly). Prefix
doubling ranks all suffixes by their first 1, 2, 4, ... lines: the rank of a 2k-prefix is the
order of its pair (rank of the k-prefix, rank of the k-prefix k lines on). Suffixes whose rank is
unique are dropped from later rounds, as nothing repeats them. Suffixes with equal rank form the
intervals of the array whose longest common prefix reaches that length. No prefix is extended beyond the
shortest qualifying run (below), so the intervals found are those of that length, not the maximal ones.

A run qualifies with MIN_WORDS words or more. A line goes exactly if it lies in a qualifying run an
identical copy of which begins earlier, by (doc_id, position). For that no longer prefix is needed
than the shortest qualifying run at each line: every line of a maximal repeated run lies in such a
run from some line of it, or in the shortest one that ends at some line of it, and both stay inside
the maximal run. A run of m lines is named by the two ranks of length 2^k that cover it, 2^k <= m,
so MIN_WORDS lines and log2(MIN_WORDS) rounds are enough at any size of input.

Defined results: a null text has no lines and stays null; lines without words are no part of the
sequences and stay; a document that loses all its words keeps its row in ``dedup`` with what is left
and goes in ``drop_repeats``; rows equal in doc_id and text count as one document and share its
fate; a null doc_id comes before all others; further columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, maybe_among, signs_of, words

MIN_WORDS = 50
_KEY = ["k1", "k2"]
#: A character of a word.
_WORD = r"[^\x20\x09-\x0D]"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), "k2": F.xxhash64("text")})


def _ranked(groups: DataFrame, order: list[str]) -> DataFrame:
    """Order-preserving ranks of distinct rows: a range-partitioned sort, numbered within partitions."""
    return groups.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())


# What grows with the documents is joined by shuffles (hint "merge") at any size, so the plan of a small input is that of a large one.
def repeated_lines(ws: Workspace, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, pos) of every line to delete, without repeats. ``docs``: k1, k2, text."""
    worded = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(_WORD))
    lines = docs.select(*_KEY, F.posexplode(worded).alias("pos", "x"))
    line = ws.save(lines.select(*_KEY, "x.at", "pos", F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2"), F.size(words(F.col("x.line"))).alias("n")), "lines")
    ids = _ranked(line.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c"), ["h1", "h2"])
    ids = ws.save(ids, "rank0")
    # Rows equal in doc_id and text give the same lines again; one of each is enough. Dealt by document, as the windows need it.
    # Lines that surely stand alone are told by hash bits and are not dealt out.
    seq = maybe_among(ws, line, ids, ["h1", "h2"], "signs0").join(ids.hint("merge"), ["h1", "h2"]).select(*_KEY, "at", "pos", "n", F.col("rank").alias("r0")).repartition(*_KEY).dropDuplicates([*_KEY, "at"])

    # Only stretches of neighbours that all repeat can hold a run. A line has a word at least, so the
    # shortest qualifying run from a line, or up to it, is among min_words lines.
    piece = Window.partitionBy(*_KEY, "s").orderBy("pos")
    ends = seq.withColumn("s", F.col("pos") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("pos"))).withColumns({
        "_a": F.collect_list("n").over(piece.rowsBetween(0, min_words - 1)),
        "_b": F.reverse(F.collect_list("n").over(piece.rowsBetween(1 - min_words, 0))),
    })

    def least(col: str):
        """Lines until the sum reaches min_words; null if it never does."""
        total = F.aggregate(
            col, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("lines")),
            lambda acc, x: F.when(acc["sum"] >= min_words, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["lines"] + 1).alias("lines"))),
        )
        return F.when(total["sum"] >= min_words, total["lines"])

    runs = ws.save(ends.select(*_KEY, "at", "pos", "r0", least("_a").alias("fore"), least("_b").alias("back")), "runs")
    ws.drop("line", "rank0", "signs0")
    most = runs.agg(F.max(F.greatest("fore", "back"))).first()[0]
    if most is None:
        return runs.select(*_KEY, "at").limit(0)

    # Prefix doubling; table k has the rank of the 2^k-prefix for every suffix that shares it.
    levels = [runs.select(*_KEY, "pos", F.col("r0").alias("rank"))]
    for k in range(1, int(math.log2(most)) + 1):
        half, on = levels[-1], 2 ** (k - 1)
        second = F.first("rank").over(Window.partitionBy(*_KEY).orderBy("pos").rangeBetween(on, on))
        pair = half.select(*_KEY, "pos", F.col("rank").alias("ra"), second.alias("rb")).where("rb is not null")
        same = _ranked(pair.groupBy("ra", "rb").agg(F.count("*").alias("c")).where("c > 1").drop("c"), ["ra", "rb"])
        same = ws.save(same, f"rank{k}")
        levels.append(ws.save(pair.join(same.hint("merge"), ["ra", "rb"]).select(*_KEY, "pos", "rank"), f"seq{k}"))
        ws.drop(f"rank{k}")

    # Name the candidate runs: start, length m, and the ranks of the two 2^k-prefixes that cover them.
    spans = (
        runs.select(*_KEY, F.explode(F.array_distinct(F.array(F.struct("pos", F.col("fore").alias("m")), F.struct((F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("m"))))).alias("r"))
        .where("r.m is not null").select(*_KEY, "r.pos", "r.m").distinct()
    )
    spans = ws.save(spans, "spans")
    named = []
    for k, level in enumerate(levels):
        at_k = spans.where((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1)))
        lo = level.select(*_KEY, "pos", F.col("rank").alias("ra"))
        hi = level.select(*_KEY, F.col("pos").alias("pos2"), F.col("rank").alias("rb"))
        if k:
            at_k = at_k.withColumn("pos2", F.col("pos") + F.col("m") - 2**k).join(lo.hint("merge"), [*_KEY, "pos"]).join(hi.hint("merge"), [*_KEY, "pos2"])
        else:
            at_k = at_k.join(lo.hint("merge"), [*_KEY, "pos"]).withColumn("rb", F.col("ra"))
        named.append(at_k.select(*_KEY, "pos", "m", F.lit(k).alias("k"), "ra", "rb"))
    name = ["k", "m", "ra", "rb"]
    spans = named[0]
    for x in named[1:]:
        spans = spans.unionAll(x)
    spans = ws.save(spans, "named")
    ws.drop("spans", *(f"seq{k}" for k in range(1, len(levels))))
    # An interval's first copy stays; the start packed in a struct keeps partial sums per task.
    first = ws.save(spans.groupBy(*name).agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("c")).where("c > 1"), "first")
    later = spans.join(first.hint("merge"), name).where(F.struct(*_KEY, "pos") > F.col("first"))
    gone = later.select(*_KEY, F.explode(F.sequence("pos", F.col("pos") + F.col("m") - 1)).alias("pos")).distinct()
    return gone.join(runs.select(*_KEY, "pos", "at").hint("merge"), [*_KEY, "pos"]).select(*_KEY, "at")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_removed_lines): ``row`` the input row, ``text`` what is left of its text."""
    spark = docs.sparkSession
    ws = Workspace(spark, "line-dedup")
    gone = repeated_lines(ws, _keyed(docs.select("doc_id", "text")).select(*_KEY, "text"), min_words)
    gone = ws.save(gone.groupBy(*_KEY).agg(F.collect_set("at").alias("gone")), "gone")
    rows = _keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text")).select("row", *_KEY)
    # Only documents that may lose lines are dealt out to meet their deletions. The others are told by a table
    # of hash bits sized by the count of deletions; a false sign costs a document's place in the join, no more.
    signs, n_words = signs_of(ws, gone, _KEY, "signs")
    h = F.xxhash64(*_KEY)
    signed = rows.withColumns({"_word": F.pmod(h, F.lit(n_words)), "_bit": F.shiftrightunsigned(h, 58).cast("int")}).join(F.broadcast(signs), "_word", "left")
    may = F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))
    lost = signed.where(may).select("row", *_KEY).join(gone.hint("merge"), _KEY, "left").select("row", "gone")
    joined = signed.where(~may).select("row", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")).unionAll(lost).withColumn("lines", F.split("row.text", "\n"))
    # Numbers of the lines kept, then the lines by number: linear in the document's lines.
    joined = joined.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    return joined.select("row", text.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("row.doc_id", "text", "n_lines", "n_removed_lines")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies of repeated runs; documents that lose their last word go."""
    out = dedup(docs)
    left = out.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(_WORD))
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return left.select(*columns)
