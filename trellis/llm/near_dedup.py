"""Near duplicates by HyperMinHash: banded registers find candidates, full sets confirm them.

A document's set holds its distinct two-word shingles, hashed to 64 bits. One pass sketches it: the
hash picks one of REGISTERS buckets, and the bucket keeps its smallest remainder as leading zeros
and MANTISSA bits after the first one, 16 bits in all. Documents with equal sets are collapsed
first, so a group of thousands of copies is one node. Registers are cut into BANDS bands; empty
registers borrow from a full one by fixed random choices, so that two sketches agree in a register
with about the Jaccard similarity. At 0.8 a link is missed by all bands with probability 5e-6.

A node of the graph is a distinct set, numbered as it is written; its text is that of the smallest
(doc_id, text hash) that has it. Sets that share a doc_id are linked besides, since rows with one doc_id
are one document. Other links are found in two rounds, never as all pairs of a large bucket:
1. every member of a band's bucket against the bucket's smallest number, which joins tight groups;
2. in buckets whose members are still in several components, all members on their full sets, as one
   matrix product per bucket that returns at most one link for each component. A bucket of more than
   SMALL members would make that product large: there only the members outside the smallest number's
   component are queries, and run against all members of the buckets that overlap, once for all of
   them, in blocks of about BLOCK sets and at most BLOCK_SHINGLES shingles on either side.
In the first round pairs are dropped before texts are fetched if set sizes or the collision-corrected
register estimate rule the link out; the rest are compared on their full sets. Members of one family of
edited copies resemble each other too much for sketches to tell 0.75 from 0.8, hence round two has no
estimate. Components come from ``components``.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a
null doc_id is linked with nothing, has component null and is kept; rows with one doc_id are one
document, with one component, whatever their texts, and all stay or all go; repeated rows repeat in the
result; an empty table gives an empty result; further columns may have any name.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, maybe_among

REGISTERS, BANDS, MANTISSA = 240, 40, 10
ROWS = REGISTERS // BANDS
EMPTY = 0xFFFF
#: A link needs 100 * intersection >= PER_CENT * union.
PER_CENT = 80
#: Buckets up to SMALL members are compared whole; beyond, in blocks of so many sets and shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 64, 256, 2_000_000
#: Shingles at once in a matrix product.
STRIP = 4096
#: Estimates this many standard deviations below the threshold rule a pair out.
SIGMAS = 6.0
_CACHE = 200_000


class _WordHashes(dict):
    """64-bit hashes by word, forgotten when there are too many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_HASHES = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the two-word shingles; bytes.lower() and split() know ASCII only."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    with np.errstate(over="ignore"):
        if len(w) > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        else:
            h = h + np.uint64(0x632BE59BD9B4E019)
    return np.unique(_mixed(h))


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of one set: leading zeros of the smallest 40-bit remainder, then its mantissa."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(s):
        bucket = (s >> np.uint64(40)) % np.uint64(REGISTERS)
        both = np.sort((bucket << np.uint64(40)) | (s & np.uint64((1 << 40) - 1)))
        b = both >> np.uint64(40)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        v = (both[first] & np.uint64((1 << 40) - 1)).astype(np.float64)
        bits = np.where(v > 0, np.frexp(v)[1], 0)
        top = np.where(v > 0, v / np.exp2(bits - 1.0), 1.0) - 1.0  # the bits after the first one, as a fraction
        out[b[first].astype(np.int64)] = (40 - bits) * (1 << MANTISSA) + (top * (1 << MANTISSA)).astype(np.int64)
    return out


_LOANS = np.random.default_rng(7).integers(0, REGISTERS, (64, REGISTERS))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of (documents, REGISTERS) registers, empty ones filled by loans."""
    full = regs.copy()
    for lender in _LOANS:
        rows = np.flatnonzero((full == EMPTY).any(axis=1))
        if not len(rows):
            break
        part = full[rows]
        full[rows] = np.where(part == EMPTY, regs[rows][:, lender], part)
    for r in np.flatnonzero((full == EMPTY).any(axis=1)):
        at = np.flatnonzero(full[r] != EMPTY)
        full[r] = full[r][at[np.searchsorted(at, np.arange(REGISTERS)) % len(at)]]
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS)).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + full[:, k::ROWS].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


@lru_cache(4096)
def _chance(log_n: float, log_m: float) -> float:
    """Probability that registers of disjoint sets agree by accident, from the sets' sizes (as log2 per bucket)."""
    zeros = np.arange(30)[:, None]
    low = (2.0**-(zeros + 1)) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 2.0**-(zeros + 1 + MANTISSA)
    def cell(x):
        return np.power(1 - low, 2.0**x) - np.power(1 - np.minimum(high, 1), 2.0**x)
    return float((cell(log_n) * cell(log_m)).sum())


def may_link(n: int, m: int, a: np.ndarray, b: np.ndarray) -> bool:
    """False if sizes or the collision-corrected estimate rule out the link; lenient where registers are few."""
    if 100 * min(n, m) < PER_CENT * max(n, m):
        return False
    used = int(((a != EMPTY) | (b != EMPTY)).sum())
    equal = int(((a == b) & (a != EMPTY)).sum())
    chance = _chance(round(np.log2(n / REGISTERS), 1), round(np.log2(m / REGISTERS), 1))
    estimate = (equal / used - chance) / (1 - chance)
    s = PER_CENT / 100
    return estimate >= s - SIGMAS * np.sqrt(s * (1 - s) / used)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= PER_CENT * (len(a) + len(b) - shared)


def _pieces(batches, rows: int = 512):
    """Arrow batches cut small, so that memory follows a few documents and not the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketch_batches(batches):
    for b in _pieces(batches):
        n, digest, regs = [], [], []
        for text in b["text"].to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            regs.append(sketch(s).tobytes())
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["t"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "t", "n_shingles", "digest", "regs"])


def _band_batches(batches):
    for b in _pieces(batches, 4096):
        if not b.num_rows:
            continue
        regs = np.stack([np.frombuffer(x, np.uint16) for x in b["regs"].to_pylist()])
        keys = band_keys(regs)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b["id"].to_numpy(zero_copy_only=False), BANDS))], ["key", "id"])


def _estimate_batches(batches):
    for b in _pieces(batches, 4096):
        cols = [b[c].to_pylist() for c in ("n_a", "n_b", "regs_a", "regs_b")]
        keep = [may_link(n, m, np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)) for n, m, x, y in zip(*cols)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm_batches(batches):
    last_a = last_b = (None, None)
    for b in _pieces(batches, 128):
        keep = []
        for x, y in zip(b["text_a"].to_pylist(), b["text_b"].to_pylist()):
            if last_a[0] != x:
                last_a = (x, shingle_set(x))
            if last_b[0] != y:
                last_b = (y, shingle_set(y))
            keep.append(_linked(last_a[1], last_b[1]))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shared(sets: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Shingles that each query shares with each set. Only shingles of two sets or more are columns of the
    matrix, and only STRIP of them at once."""
    sizes = np.array([len(x) for x in sets])
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
    count = np.diff(np.r_[first, len(every)])
    column = np.repeat(np.cumsum(count > 1) - 1, count)[np.repeat(count > 1, count)]
    row = row[order][np.repeat(count > 1, count)]
    out = np.zeros((len(queries), len(sets)))
    for lo in range(0, int((count > 1).sum()), STRIP):
        at = slice(*np.searchsorted(column, [lo, lo + STRIP]))
        matrix = np.zeros((len(sets), STRIP), np.float32)
        matrix[row[at], column[at] - lo] = 1
        out += matrix[queries] @ matrix.T
    return np.rint(out).astype(np.int64)


def _block_links(table: pa.Table) -> pa.Table:
    """Links across components between the queries of a group (query true) and all of its members.

    ``table``: id, comp, query, text. A set that is both query and member is one row of the matrix; of the
    links found, those that join components are returned.
    """
    ids, comps, asked = (table[c].to_pylist() for c in ("id", "comp", "query"))
    first: dict[int, int] = {}
    for k, i in enumerate(ids):
        first[i] = k if i not in first or asked[k] else first[i]
    at = sorted(first.values())
    sets = [shingle_set(table["text"][k].as_py()) for k in at]
    # Texts without shingles link with nothing.
    at, sets = [k for k, x in zip(at, sets) if len(x)], [x for x in sets if len(x)]
    queries = np.flatnonzero([asked[k] for k in at])
    if not len(queries):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sizes = np.array([len(x) for x in sets])
    shared = _shared(sets, queries)
    linked = 100 * shared >= PER_CENT * (sizes[queries][:, None] + sizes[None, :] - shared)
    comp = np.array([comps[k] for k in at])
    linked &= comp[queries][:, None] != comp[None, :]
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    out = []
    for q, k in zip(*np.nonzero(linked)):
        x, y = find(int(comp[queries[q]])), find(int(comp[k]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[at[queries[q]]], ids[at[k]]))
    return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})


def _texts(ws: Workspace, docs: DataFrame, reps: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """(id, text) of the numbered sets ``ids``. ``docs``: doc_id, t, text; copies of a row meet per task first."""
    wanted = ws.save(reps.select("id", "doc_id", "t").join(ids, "id", "left_semi"), f"{tag}_wanted")
    likely = maybe_among(ws, docs, wanted, ["doc_id", "t"], f"{tag}_signs")
    return ws.save(likely.groupBy("doc_id", "t").agg(F.first("text").alias("text")).join(wanted, ["doc_id", "t"]).select("id", "text"), f"{tag}_texts")


class _Confirmer:
    """Candidate pairs (a, b) of numbers to confirmed links."""

    def __init__(self, ws: Workspace, docs: DataFrame, reps: DataFrame):
        self.ws, self.docs, self.reps, self.k = ws, docs, reps, 0

    def __call__(self, pairs: DataFrame) -> DataFrame:
        self.k += 1
        side = lambda x: self.reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
        likely = self.ws.save(likely.mapInArrow(_estimate_batches, "a long, b long"), f"likely{self.k}")
        ids = likely.select(F.col("a").alias("id")).unionAll(likely.select(F.col("b").alias("id"))).distinct()
        texts = _texts(self.ws, self.docs, self.reps, ids, f"pairs{self.k}")
        text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
        links = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
        links = self.ws.save(links.mapInArrow(_confirm_batches, "a long, b long").distinct(), f"links{self.k}")
        self.ws.drop(f"pairs{self.k}_texts", f"pairs{self.k}_wanted", f"pairs{self.k}_signs", f"likely{self.k}")
        return links


def _blocks(ws: Workspace, large: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (part, id, comp, query) of the block comparisons for members of large buckets.

    ``large``: key, id, hub, comp. Buckets that overlap form a family, in which every set occurs
    once; sets outside the component of one of their buckets' hubs are the family's queries.
    """
    family = components(ws, large.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "families")
    hubs = large.where("id = hub").select("key", F.col("comp").alias("hub_comp"))
    member = large.join(hubs, "key").groupBy("id", "comp").agg(F.max(F.col("comp") != F.col("hub_comp")).alias("outside"))
    member = ws.save(member.join(reps.select("id", F.col("n").alias("w")), "id").join(family.withColumnRenamed("component", "family"), "id"), "family_members")
    parts = lambda some: F.ceil(F.greatest(F.sum(some) / BLOCK, F.sum(F.col("w") * some) / BLOCK_SHINGLES)).cast("int")
    size = member.groupBy("family").agg(parts(F.lit(1)).alias("n"), parts(F.col("outside").cast("int")).alias("q")).where("q > 0")
    member = member.join(ws.save(size, "family_sizes"), "family")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = member.select("family", "id", "comp", every("q").alias("i"), of("n").alias("j"), F.lit(False).alias("query"))
    asked = member.where("outside").select("family", "id", "comp", of("q").alias("i"), every("n").alias("j"), F.lit(True).alias("query"))
    return rows.unionAll(asked).select(F.concat_ws("/", F.lit("f"), "family", "i", "j").alias("part"), "id", "comp", "query")


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text)."""
    ws = Workspace(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    sig = ws.save(docs.mapInArrow(_sketch_batches, "doc_id long, t long, n_shingles long, digest binary, regs binary"), "sketches")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    reps = known.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("r"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    reps = ws.save(reps.select(F.monotonically_increasing_id().alias("id"), "digest", "r.doc_id", "r.t", "n", "regs"), "sets_by_digest")

    # Rows with one doc_id but several sets: the sets are linked, whatever they hold.
    several = ws.save(sig.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id"), "several")
    theirs = known.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(reps.select("digest", "id"), "digest").select("doc_id", "id")
    theirs = ws.save(theirs, "sets_of_several")
    least = ws.save(theirs.groupBy("doc_id").agg(F.min("id").alias("a")), "least_of_several")
    same = theirs.join(least, "doc_id").where("a != id").select("a", F.col("id").alias("b"))

    # A set of three or fewer is linked with equal sets only, which are collapsed.
    bands = ws.save(reps.where("n > 3").select("id", "regs").mapInArrow(_band_batches, "key long, id long"), "bands")
    buckets = ws.save(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1"), "buckets")
    members = ws.save(bands.join(buckets, "key"), "members")
    ws.drop("bands", "buckets")

    confirm = _Confirmer(ws, docs, reps)
    links = ws.save(confirm(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()).unionAll(same).distinct(), "links")
    comp = ws.save(components(ws, links, "first"), "comp1")

    # The second round: buckets that still hold several components.
    placed = members.where("c > 2").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    placed = ws.save(placed.select("key", "id", "hub", "c", "comp"), "placed")
    split = ws.save(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "split_keys")
    placed = ws.save(placed.join(split, "key"), "split")
    ws.drop("members", "placed")
    placed = placed.withColumn("large", F.col("c") > SMALL)
    parts = placed.where("not large").select(F.col("key").cast("string").alias("part"), "id", "comp", F.lit(True).alias("query"))
    large = placed.where("large")
    if not large.isEmpty():
        parts = parts.unionAll(_blocks(ws, large, reps))
    parts = ws.save(parts, "parts")
    texts = _texts(ws, docs, reps, parts.select("id").distinct(), "parts")
    more = parts.join(texts, "id").groupBy("part").applyInArrow(_block_links, "a long, b long")
    more = ws.save(more.distinct(), "links_across")
    if not more.isEmpty():
        comp = ws.save(components(ws, links.unionAll(more), "second"), "comp2")
    ws.drop("parts_texts", "parts", "split")

    # Each set's component by number, then the smallest doc_id of any set in it.
    labels = ws.save(reps.select("id", "doc_id", "digest").join(comp, "id", "left").withColumn("label", F.coalesce("component", "id")).select("digest", "label", "doc_id"), "labels")
    lowest = ws.save(labels.groupBy("label").agg(F.min("doc_id").alias("component_id")), "lowest")
    labels = ws.save(labels.join(lowest, "label").select("digest", "component_id"), "components")
    mine = sig.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(labels, "digest").groupBy("doc_id").agg(F.min("component_id").alias("mine"))
    out = sig.select("doc_id", "n_shingles", "digest").join(labels, "digest", "left").join(ws.save(mine, "mine"), "doc_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("mine", own))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and those without a doc_id."""
    gone = cluster(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
