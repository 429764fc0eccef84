"""Helpers shared by the training-data operators: word splitting, written tables, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, gone_at_exit, shared_dir

#: The six blank characters U+0020 and U+0009 to U+000D, which separate words.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression, for runs of them.
BLANK_RUN = r"[\x20\x09-\x0D]+"


class Workspace:
    """Intermediate tables of one run, written as Parquet under the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of one step, not the plan. What is
    left of them goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        gone_at_exit(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))


def words(text: Column) -> Column:
    """The words of a text, as an array; null or blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


#: Hash bits for each key in the broadcast table of ``maybe_among``, and its fewest and most rows (of 64 bits).
#: The most bounds the broadcast to some 32 MB; keys beyond it fill the table, which costs joins and no rows.
BITS_A_KEY, LEAST_WORDS, MOST_WORDS = 8, 2**12, 2**20


def sign_words(n_keys: int) -> int:
    """Rows of a table of hash bits for so many keys: a power of two, so the input's size sets it."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << (n_keys * BITS_A_KEY // 64).bit_length()))


def signs_of(ws: Workspace, keys: DataFrame, columns: list[str], tag: str, n_words: int | None = None) -> tuple[DataFrame, int]:
    """The hash bits of ``keys`` as rows (_word, _bits), written as ``tag``, and how many words they may have."""
    n_words = n_words or sign_words(keys.count())
    h = F.xxhash64(*columns)
    bits = keys.select(F.pmod(h, F.lit(n_words)).alias("_word"), F.shiftrightunsigned(h, 58).cast("int").alias("_bit"))
    bits = bits.select("_word", F.expr("shiftleft(1L, _bit)").alias("b"))
    return ws.save(bits.groupBy("_word").agg(F.bit_or("b").alias("_bits")), tag), n_words


def maybe_among(ws: Workspace, df: DataFrame, keys: DataFrame, columns: list[str], tag: str, n_words: int | None = None) -> DataFrame:
    """``df`` without rows whose ``columns`` are surely not in ``keys``; a null key is in no set.

    Rows that pass by chance are left to the join that follows, so only its cost depends on how full the
    table of bits is.
    """
    signs, n_words = signs_of(ws, keys, columns, tag, n_words)
    h = F.xxhash64(*columns)
    known = df
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    found = known.select(*df.columns, F.pmod(h, F.lit(n_words)).alias("_word"), F.shiftrightunsigned(h, 58).cast("int").alias("_bit")).join(F.broadcast(signs), "_word")
    return found.where(F.getbit("_bits", F.col("_bit")) == 1).select(*df.columns)


def flagged(df: DataFrame, signs: DataFrame, n_words: int, columns: list[str]) -> DataFrame:
    """``df`` with a column ``_may``: false where ``columns`` are surely not among the keys of ``signs_of``."""
    h = F.xxhash64(*columns)
    out = df.withColumns({"_word": F.pmod(h, F.lit(n_words)), "_bit": F.shiftrightunsigned(h, 58).cast("int")}).join(F.broadcast(signs), "_word", "left")
    return out.withColumn("_may", F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))).drop("_word", "_bit", "_bits")


def components(ws: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star.

    ``edges``: columns a, b (long, a != b). Returns (id, component) for every id in an edge, with
    component the smallest id reachable. Each step is an aggregate with partial sums per task, written, and
    an equi-join of two written tables, in which the links of a hub can be split over tasks.
    """
    now = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}0")
    step = 0
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}{step}m")
        # Only links to larger neighbours turn, so the smaller end u is the key.
        turned = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u")
        large = ws.save(turned.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), f"{tag}{step}l")
        least = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}{step}n")
        small = (
            large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct()
        )
        new = ws.save(small, f"{tag}{step + 1}")
        # Stable when every node points at one root that points nowhere: then no root is also a child.
        several = new.groupBy("u").count().where("count > 1")
        chained = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        done = several.isEmpty() and chained.isEmpty()
        ws.drop(*(f"{tag}{step}{x}" for x in ("", "m", "l", "n")))
        now, step = new, step + 1
        if done:
            break
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
