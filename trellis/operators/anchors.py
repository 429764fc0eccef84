"""Which of many literal strings occur in texts, by an index of short blocks.

Texts are cut into blocks of some characters, one after the other, so there is one block to as many characters. An
anchor of twice that length covers a whole block wherever it begins: for each way it can lie over the blocks, it
is filed under the block that the texts hold most rarely. Blocks of texts that no anchor is filed under are dropped
where they are read, the others meet the anchors by equality, and what meets is compared literally, a text crossing
one join with all its candidates. Shorter anchors have shorter blocks. Anchors of a key that has few are compared with the
key's texts at once, without blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds
from .sieve import sieve

#: Lengths of blocks, longest first: an anchor takes the first of which it has 2 q - 1 characters.
BLOCKS = (8, 4, 2, 1)
#: Anchors of one key that each of its texts is compared with.
FEW = 64


def _kind(size: Column) -> Column:
    kind = F.lit(None).cast("int")
    for q in reversed(BLOCKS):
        kind = F.when(size >= 2 * q - 1, q).otherwise(kind)
    return kind


def _blocks(text: str, sizes: list[int]) -> Column:
    """The distinct whole blocks of a text, of every size."""
    one = lambda q: F.regexp_extract_all(text, F.lit(f"(?s).{{{q}}}"), F.lit(0))
    return F.array_distinct(F.concat(*map(one, sizes)))


def found(texts: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by..., anchor): anchors that a text with the same ``by`` contains. ``texts``: by..., content; ``anchors``: by..., anchor.

    Null texts hold nothing; an empty anchor is in every text. A null in ``by`` meets nothing.
    """
    rounds = Rounds(texts.sparkSession, "anchors")
    texts = texts.select(*by, "content").where("content is not null")
    q = _kind(F.char_length("anchor"))
    anchors = rounds.write(anchors.select(*by, "anchor").where("anchor is not null").distinct().withColumn("q", q))
    sizes = sorted({r[0] for r in anchors.select("q").distinct().collect()} - {None})
    here = anchors.where("anchor = ''").select(*by, "anchor")
    out = here.join(texts.select(*by).distinct(), by, "left_semi") if by else here.where(F.lit(not texts.isEmpty()))
    if not sizes:
        return out
    at = F.sequence(F.lit(0), F.char_length("anchor") - F.col("q"))
    parts = F.transform(at, lambda i: F.struct((i % F.col("q")).alias("shift"), F.substr(F.col("anchor"), i + 1, F.col("q")).alias("block")))
    parts = rounds.write(anchors.where("q is not null").select(*by, "anchor", F.explode(parts).alias("x")).select(*by, "anchor", "x.shift", "x.block"))
    cut = texts.select(*by, F.xxhash64("content").alias("text"), F.explode(_blocks("content", sizes)).alias("block"))
    often = sieve(rounds, parts.select("block").distinct(), ["block"])(cut).groupBy("block").agg(F.count("*").alias("n"))
    place = parts.join(often, "block", "left").groupBy(*by, "anchor", "shift").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "block")).alias("at"))
    # A shift with a block that no text holds is nowhere.
    filed = rounds.write(place.where("at.n > 0").select(*by, "anchor", F.col("at.block").alias("block")).distinct())
    held = sieve(rounds, filed.select(*by, "block").distinct(), [*by, "block"])(cut)
    wanted = rounds.write(held.join(filed, [*by, "block"]).groupBy(*by, "text").agg(F.collect_set("anchor").alias("anchors")))
    near = sieve(rounds, wanted, [*by, "text"])(texts.withColumn("text", F.xxhash64("content"))).join(wanted, [*by, "text"])
    hits = F.filter("anchors", lambda a: F.contains(F.col("content"), a))
    return out.unionAll(near.select(*by, F.explode(hits).alias("anchor")).distinct())


def found_near(texts: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """``found`` where a key in ``by`` has few anchors of its own: each text is shuffled once and meets all of its key's. Keys
    with more than FEW go by blocks, so that many texts with many anchors are no pairs."""
    rounds = Rounds(texts.sparkSession, "near")
    anchors = rounds.write(anchors.select(*by, "anchor").where("anchor is not null").distinct())
    sizes, many = rounds.counted(anchors.groupBy(*by).agg(F.count("*").alias("n")), F.col("n") > FEW)
    large = sizes.where(F.col("n") > FEW).select(*by)
    few = (anchors.join(large, by, "left_anti") if many else anchors).groupBy(*by).agg(F.collect_list("anchor").alias("anchors"))
    hits = F.filter("anchors", lambda a: F.contains(F.col("content"), a))
    out = texts.select(*by, "content").join(few, by).select(*by, F.explode(hits).alias("anchor")).distinct()
    return out.unionAll(found(texts.join(large, by, "left_semi"), anchors.join(large, by, "left_semi"), by)) if many else out
