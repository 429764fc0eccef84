"""Compression of vectors to short codes: product quantization in whole numbers.

Each component x becomes the integer floor(1024 * x); a vector is cut into PARTS equal parts, and each part
is replaced by the index of its nearest codebook entry. The codebooks start as the parts of the smallest
vec_ids; a round assigns every part and moves each entry to the floor of its parts' mean.

Assignment is exact. ``nearest`` screens a block of parts against a codebook by one float32 matrix product.
Its result for an entry lies within a rounding-error bound of the true distance, so only entries whose
interval overlaps the best one can be nearest; these are evaluated again in int64, and ties go to the lower
index. A round is one pass over a written table: every task returns, for each entry, the count and sum of
its parts, Spark adds them, and the driver gets PARTS x ENTRIES rows, whatever the input.

Defined results: rows with a null vector, or a null or non-finite component, go; a null vec_id is coded but
starts no codebook; repeated vec_ids start one entry (of their smallest vector) and are all coded; with fewer
vec_ids than ENTRIES the codebooks are that short. All vectors have the length of the first one by (vec_id,
vector); a vector of another length, or with a component too large for 64-bit distances, keeps its row with
null code and error, and so do all if that length is no multiple of PARTS or no row has a vec_id. Labels may
be null, which counts as one label. An empty table gives an empty result; further columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts screened at once, and pairs evaluated at once in int64.
BLOCK, PAIRS = 1024, 1 << 16
#: Labels up to this number are broadcast with their sums; more are met by a shuffled join.
MOST_LABELS = 100_000
_UNIT = 2.0**-24


def distinct_entries(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries in order of their lowest index, and these indexes."""
    at = np.sort(np.unique(book, axis=0, return_index=True)[1])
    return book[at], at


def screened(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) booleans: whether the entry's interval overlaps the best one of the row.

    |entry|^2 - 2 x.entry orders entries as their distances do. In float32, with conversions, a product of p
    terms in any order and one subtraction, it is off by at most g(p + 4) * (|entry|^2 + 2 |x| |entry|), where
    g(n) = n u / (1 - n u) and u = 2^-24 (Higham, Accuracy and Stability of Numerical Algorithms, section 3.1).
    """
    n = x.shape[1] + 4
    gamma = n * _UNIT / (1 - n * _UNIT)
    square = (entries * entries).sum(axis=1)
    score = (square.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ entries.T.astype(np.float32))).astype(np.float64)
    top = float(square.max())
    # Norms in float64 are good to some 2^-50; the last factor is beyond that.
    off = gamma * (top + 2 * np.sqrt((x * x).sum(axis=1).astype(np.float64) * top)) * (1 + 2.0**-40)
    return score <= (score.min(axis=1) + 2 * off)[:, None]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, for every row of ``x``; both int64, exact."""
    entries, index = distinct_entries(book)
    best, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), BLOCK):
        some = x[lo : lo + BLOCK]
        row, entry = np.nonzero(screened(some, entries))  # by row, then by index
        d = np.empty(len(row), np.int64)
        for a in range(0, len(row), PAIRS):
            gap = some[row[a : a + PAIRS]] - entries[entry[a : a + PAIRS]]
            d[a : a + PAIRS] = (gap * gap).sum(axis=1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        low = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == low[row])
        first = hit[np.flatnonzero(np.r_[True, row[hit][1:] != row[hit][:-1]])]
        best[lo : lo + BLOCK], least[lo : lo + BLOCK] = index[entry[first]], low
    return best, least


def integers(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is whole and finite, with ``v``: the components as integers; null if one is too large."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    # Distances of such vectors, summed over parts, stay below 2^62.
    fits = F.forall(x, lambda c: F.pow(F.abs(c.cast("double")) * SCALE + 1, 2) * F.size(x) <= 2.0**60)
    return vectors.where(x.isNotNull() & finite).withColumn("v", F.when(fits, scaled))


def _matrices(batches, dims: int):
    """Each batch with a mask of its codable rows and their integers as a matrix."""
    for b in batches:
        v = b["v"]
        ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(v), dims), False))
        x = v.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(int(ok.sum()), dims)
        yield b, ok, x


def _moved(vectors: DataFrame, books, dims: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each (part, entry) that has parts: how many, and their sum."""
    p, spark = dims // PARTS, vectors.sparkSession
    shared = spark.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, _, x in _matrices(batches, dims):
            for part in range(PARTS if len(x) else 0):
                mine = np.ascontiguousarray(x[:, part * p : (part + 1) * p])
                best, _ = nearest(mine, books[part])
                order = np.argsort(best, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
                at = best[order][starts]
                n[part, at] += np.diff(np.r_[starts, len(best)])
                total[part, at] += np.add.reduceat(mine[order], starts, axis=0)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = vectors.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>").groupBy("part", "entry")
    rows = sums.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(p))).alias("total")).collect()
    shared.destroy()
    return {(r["part"], r["entry"]): (r["n"], r["total"]) for r in rows}


def train(vectors: DataFrame, dims: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (PARTS, entries, dims / PARTS) of a table with vec_id and ``v``; None where nothing can start them."""
    if not dims or dims % PARTS:
        return None
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("v") == dims))
    ids = [r[0] for r in usable.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    start = usable.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), PARTS, dims // PARTS).swapaxes(0, 1).copy()
    for _ in range(rounds):
        for (part, entry), (n, total) in _moved(vectors, books, dims).items():
            books[part, entry] = [t // n for t in total]
    return books


def encoded(vectors: DataFrame, books: np.ndarray, dims: int, *carry: str) -> DataFrame:
    """(``carry``, code, error): two hex digits for each part, and the squared distances summed over parts."""
    p = dims // PARTS
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b, ok, x in _matrices(batches, dims):
            digits, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for part in range(PARTS if len(x) else 0):
                best, least = nearest(np.ascontiguousarray(x[:, part * p : (part + 1) * p]), shared.value[part])
                digits[:, part] = best
                error += least
            code, errors = np.full(len(ok), None, object), np.full(len(ok), None, object)
            code[ok], errors[ok] = [d.tobytes().hex() for d in digits], error
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carry), pa.array(code, pa.string()), pa.array(errors, pa.int64())], [*carry, "code", "error"])

    fields = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in carry)
    return vectors.select(*carry, "v").mapInArrow(run, f"{fields}, code string, error long")


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
    flat = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def compress(vectors: DataFrame, column: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) as a written table, and the codebooks. ``vectors``: vec_id, label, ``column``."""
    ws = Workspace(vectors.sparkSession, "vector-codes")
    whole = integers(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(column).alias("x")), "x")
    whole = ws.save(whole.select("vec_id", "label", "v"), "integers")
    first = whole.where("vec_id is not null and v is not null").agg(F.min(F.struct("vec_id", "v")).alias("f")).first()["f"]
    dims = len(first["v"]) if first else 0
    books = train(whole, dims, entries, rounds) if first else None
    if books is None:
        return whole.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    return ws.save(encoded(whole, books, dims, "vec_id", "label"), "codes"), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    ws = Workspace(spark, "vector-labels")
    sums = ws.save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= MOST_LABELS else sums
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
