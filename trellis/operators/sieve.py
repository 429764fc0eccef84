"""A table of hash bits that tells, before a shuffle, which rows can meet a set of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds

#: Hash bits for each key, and the most words of 64 bits: the broadcast has at most some 32 MB. Keys beyond that fill the
#: table, so more rows pass, and none is lost.
BITS_A_KEY, MOST_WORDS = 8, 2**20


def sieve(rounds: Rounds, keys: DataFrame, columns: list[str]):
    """A function of rows that drops those whose ``columns`` are surely not among ``keys``; a null is in no set."""
    n = keys.count()
    words = min(MOST_WORDS, max(64, 1 << (n * BITS_A_KEY // 64).bit_length()))
    h = F.xxhash64(*columns)
    at = lambda df: df.withColumns({"_word": F.pmod(h, F.lit(words)), "_bit": F.shiftrightunsigned(h, 58).cast("int")})
    table = rounds.write(at(keys.select(*columns)).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))

    def passed(rows: DataFrame) -> DataFrame:
        kept = rows.columns
        for c in columns:
            rows = rows.where(F.col(c).isNotNull())
        return at(rows).join(F.broadcast(table), "_word").where(F.getbit("_bits", F.col("_bit")) == 1).select(*kept)

    return passed
