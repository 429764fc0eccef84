"""Removal of repeated passages of words, by Rabin-Karp hashes of every window of fixed length.

A window is WINDOW consecutive words of one document. A word goes if it lies in a window whose word sequence
also starts in a document with a smaller doc_id; windows are judged on the input alone.

1. Texts that are equal as a whole are told by their hashes, one row each: of a group of copies only the
   smallest doc_id's text goes on, as every window of the others begins in it too.
2. Every window is hashed by a rolling polynomial, a difference of two prefix sums. Its mark is the smallest
   hash of the INNER-word windows inside it, so equal windows have equal marks and neighbours mostly share
   theirs: there is about one mark to four words. Spark counts how often each is found. A window whose mark is
   found once is unique, so only the others' hashes are counted, with the smallest and largest doc_id that have
   them.
3. The windows whose hash is in several documents meet its smallest doc_id; positions of later ones merge into
   maximal intervals, which are joined to the texts that lose any.

Counts and minima have partial sums in each task; the joins are equi-joins on hashes, so rows of a hash that a
third of the documents share are split by the skew join. A broadcast table of hash bits (``Bits``, ``signs_of``),
8 MB at most, spares a step the rows that cannot match. Results do not hang on it: with many more repeated marks
than it has bits, every window is counted and joined. Two windows count as equal if two independent 64-bit
hashes agree.

Defined results: a null text has no words; what is left of a text are its words joined by one space; a null
doc_id is smaller or larger than none, so its row loses nothing and takes nothing from others; rows with one
doc_id take nothing from each other; repeated rows repeat in the result; an empty table gives an empty
result; further columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, flagged, sign_words, signs_of

WINDOW, INNER = 13, 7
#: Odd bases of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_KEY = ["k", "t"]


def words(text: str | None) -> list[bytes]:
    """bytes.split() parts at the six blanks of ASCII alone."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


class Rolling:
    """Hashes of all windows of a sequence of words, for any length, under one of the two polynomials."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        with np.errstate(over="ignore"):
            self.power = _powers(base, n)
            # The sum runs backwards: word i weighs base^(n - 1 - i), and an odd base has an inverse modulo 2^64.
            self.sums = np.r_[np.uint64(0), np.cumsum(values * _powers(pow(base, -1, 1 << 64), n)[:n], dtype=np.uint64)]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mixed((self.sums[size:] - self.sums[:n]) * self.power[size - 1 : size - 1 + n])


def _values(ws: list[bytes]) -> np.ndarray:
    """(2, words) values, one row for each polynomial."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, ws)), np.uint64).reshape(-1, 2).T


def window_marks(rolling: Rolling, window: int, inner: int) -> np.ndarray:
    """For each window of ``window`` words, its smallest ``inner``-word hash."""
    low, have, span = rolling.windows(inner), 1, window - inner + 1  # minima over 1, 2, 4, ... neighbours
    n = len(low) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while 2 * have <= span:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return np.minimum(low[:n], low[span - have : span - have + n])


class Slice:
    """The words of some texts as one sequence, so that arrays are long; ``at`` are the windows within one text."""

    def __init__(self, texts: list[str | None], window: int):
        split = [words(t) for t in texts]
        lengths = np.array([len(x) for x in split])
        self.values = _values([w for x in split for w in x])
        self.first = np.cumsum(lengths) - lengths
        self.counts = np.maximum(lengths - window + 1, 0)
        self.row = np.repeat(np.arange(len(texts)), self.counts)
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.at = self.first[self.row] + self.pos


def _slices(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _marks(docs: DataFrame, window: int, inner: int) -> DataFrame:
    """(mark): the marks of each text, once for each stretch of windows that share one."""

    def run(batches):
        for b in _slices(batches):
            s = Slice(b["text"].to_pylist(), window)
            mark = window_marks(Rolling(s.values[0], BASES[0]), window, inner)[s.at]
            new = np.r_[True, (mark[1:] != mark[:-1]) | (s.row[1:] != s.row[:-1])][: len(mark)]
            yield pa.RecordBatch.from_arrays([_long(mark[new])], ["mark"])

    return docs.select("text").mapInArrow(run, "mark long")


class Bits:
    """A bounded table of hash bits: a hash is surely not among ``keys`` if its bit is not set."""

    def __init__(self, ws: Workspace, keys: DataFrame, column: str):
        self.size = sign_words(keys.count())
        bit = F.shiftrightunsigned(column, 58).cast("int").alias("bit")
        word = keys.select(F.col(column).bitwiseAND(F.lit(self.size - 1)).alias("word"), bit)
        rows = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        table = np.zeros(self.size, np.int64)
        table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.shared = ws.spark.sparkContext.broadcast(table.view(np.uint64))

    def may(self, h: np.ndarray) -> np.ndarray:
        return (self.shared.value[(h & np.uint64(self.size - 1)).astype(np.int64)] >> (h >> np.uint64(58))) & np.uint64(1) == 1


def _windows(docs: DataFrame, window: int, inner: int, marks: Bits | None, hashes: Bits | None = None) -> DataFrame:
    """(k, t, pos, h1, h2) of the windows whose mark, and those whose hash, may be among these."""

    def run(batches):
        for b in _slices(batches):
            s = Slice(b["text"].to_pylist(), window)
            one = Rolling(s.values[0], BASES[0])
            at, row, pos = s.at, s.row, s.pos
            h1 = one.windows(window)
            keep = (hashes.may(h1[at]) if hashes else marks.may(window_marks(one, window, inner)[at])) if len(at) else np.zeros(0, bool)
            at, row, pos = at[keep], row[keep], pos[keep]
            h2 = Rolling(s.values[1], BASES[1]).windows(window)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([b["k"].take(rows), b["t"].take(rows), pa.array(pos.astype(np.int32)), _long(h1[at]), _long(h2[at])], ["k", "t", "pos", "h1", "h2"])

    return docs.select("k", "t", "text").mapInArrow(run, "k long, t long, pos int, h1 long, h2 long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with k (doc_id), and t and u: two hashes of the text."""
    return docs.withColumns({"k": F.col("doc_id").cast("long"), "t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})


def _leading(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, t, text) that are no later copy of a whole other text, and (k, t) of the later copies, without repeats."""
    texts = docs.where("k is not null and text is not null")
    groups = texts.groupBy("t", "u").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("t", "u", "first")
    groups = ws.save(groups, "copies")
    signs, n_words = signs_of(ws, groups, ["t", "u"], "copy_signs")
    told = flagged(texts, signs, n_words, ["t", "u"])
    first = told.where("_may").join(groups, ["t", "u"], "left").where("first is null or k = first").select("k", "t", "text")
    later = told.where("_may").select("k", "t", "u").distinct().join(groups, ["t", "u"]).where("k > first").select("k", "t")
    return told.where("not _may").select("k", "t", "text").unionAll(first), later


def _spans(positions: DataFrame, window: int) -> DataFrame:
    """(k, t, spans): windows that start at (k, t, pos), merged into maximal intervals [start, end) of words."""
    by_pos = Window.partitionBy("k", "t").orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(by_pos) > window).cast("int"), F.lit(1))
    run = positions.withColumn("new", new).withColumn("run", F.sum("new").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    one = run.groupBy("k", "t", "run").agg(F.min("pos").alias("start"), (F.max("pos") + window).alias("end"))
    return one.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(ws: Workspace, docs: DataFrame, window: int = WINDOW, inner: int = INNER) -> DataFrame:
    """(k, t, spans, whole) of the texts that lose words; ``whole`` for later copies of whole texts, which have no spans.

    ``docs``: k, t, u, text.
    """
    texts, later = _leading(ws, docs)
    marks = _marks(texts, window, inner).groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    shared = _windows(texts, window, inner, Bits(ws, ws.save(marks, "marks"), "mark"))
    firsts = shared.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").select("h1", "h2", "first")
    firsts = ws.save(firsts, "windows")
    likely = _windows(texts, window, inner, None, Bits(ws, firsts, "h1"))
    gone = likely.join(firsts, ["h1", "h2"]).where("k > first").select("k", "t", "pos")
    some = _spans(gone.dropDuplicates(["k", "t", "pos"]), window).withColumn("whole", F.lit(False))
    return some.unionByName(later.select("k", "t", F.lit(None).cast(some.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole")))


def _cut(batches, window: int):
    """(n_words, n_removed, left) beside the rows: the words outside the spans, joined by one space."""
    for b in _slices(batches):
        n, removed, left = [], [], []
        for text, spans, whole in zip(b["text"].to_pylist(), b["spans"].to_pylist(), b["whole"].to_pylist()):
            ws = words(text)
            keep = np.ones(len(ws), bool)
            for s in spans or ():
                keep[s["start"] : s["end"]] = False
            if whole and len(ws) >= window:
                keep[:] = False
            n.append(len(ws))
            removed.append(len(ws) - int(keep.sum()))
            left.append(b" ".join(w for w, k in zip(ws, keep) if k).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b["row"], b["spans"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())], ["row", "spans", "n_words", "n_removed", "left"])


def dedup(docs: DataFrame, carry: list[str] | None = None, window: int = WINDOW, inner: int = INNER) -> DataFrame:
    """(row, spans, n_words, n_removed, left): ``row`` the input's columns ``carry`` (all without it), ``spans`` the
    removed intervals of words (null where none, or where all go as a copy), ``left`` the words that stay."""
    if not 0 < inner <= window:
        raise ValueError("marks must be no longer than a window")
    ws = Workspace(docs.sparkSession, "substring")
    lost = ws.save(repeated_spans(ws, _keyed(docs.select("doc_id", "text")), window, inner), "lost")
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), "doc_id", "text")
    rows = _keyed(rows).select("row", "k", "t", "text")
    signs, n_words = signs_of(ws, lost, _KEY, "lost_signs")
    told = flagged(rows, signs, n_words, _KEY)
    cut = told.where("_may").join(lost, _KEY, "left").select("row", "text", "spans", "whole")
    none = F.lit(None).cast(lost.schema["spans"].dataType).alias("spans")
    every = told.where("not _may").select("row", "text", none, F.lit(False).alias("whole")).unionAll(cut)
    fields = f"row {rows.schema['row'].dataType.simpleString()}, spans {lost.schema['spans'].dataType.simpleString()}, n_words long, n_removed long, left string"
    return every.mapInArrow(lambda batches: _cut(batches, window), fields)


def op13_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, ["doc_id"]).select("row.doc_id", "n_words", "n_removed", F.sha2("left", 256).alias("kept_sha256"))
