"""Benchmark decontamination: BM25 inverted index over test items, block-max WAND, then overlap.

The index holds, for each term, the items with it in order, their BM25 weights and, for each block of BLOCK
items that has the term, the largest of them; terms are numbered by rising largest weight. Queries are
passages: windows of SPAN times the longest item, starting every longest item, so that a copy lies whole in
one of them if it takes up, with text inserted into it, at most SPAN - 1 times the longest item; every word of
every text is queried. A text of several passages is one more passage as a whole, for copies that are spread wider: its items with
score >= 1 that no window confirmed are confirmed on the shingles of the whole text, wherever they lie. So an item is
found if the text holds its shares of shingles, whatever lies between them.

A weight is divided by the least score a true match of its item can have (a match has OVERLAP of the
item's five-word shingles, so it lacks at most the remaining share of words, at worst the heaviest),
hence "score >= 1" retrieves every match, whatever the item. Passages are first tested, many at once: the
terms whose largest weights add up to less than HALF_WAY cannot decide alone, so only blocks of the other
terms' short lists are summed, and a passage lives if a block's sum and that rest reach 1; for the living ones
all lists are. Those still living go through the pivots of WAND, which skip items whose block maxima cannot
reach 1.

Nearly all blocks live in a long whole text, so there scores are added up for all items at once instead of by pivots; of its
shingles only those that some item has are kept, told by hashes first, and a text without any needs no scores.

A retrieved item is confirmed on the passage: OVERLAP of all its five-word shingles, and half of those
of its question and of its answer (split after the last question mark, or in the middle of the text).
Words are lower-case, without punctuation at their ends; an item of fewer than five words is one
shingle.

Document frequencies, their number and the mean length are those of all items, counted by Spark. The postings of
one index are bounded by ITEMS items and ITEM_BYTES of text; a larger benchmark is taken in that many parts by
hash, each with its own pass and the same weights. Defined results: null or wordless texts and items match
nothing; a null doc_id or item_id is kept as null; a document or item that occurs twice gives one row per pair
of ids; items equal in id and text count once; further columns play no part in ``contaminated`` and stay in
``drop_contaminated``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, OVERLAP, HALF = 5, 0.8, 0.5
K1, B = 1.2, 0.75
BLOCK, SPAN, HALF_WAY = 4, 3, 0.5
#: Most items, and bytes of their texts, in one index.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
_CACHE = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ENDS = b".,;:!?\"'()[]{}|*#$%&<>"
#: Sums of block maxima held at once.
_SUMS = 1 << 21


def _terms(text: str | None) -> list[bytes]:
    return [t for w in (text or "").encode("utf-8", "surrogatepass").lower().split() if (t := w.strip(_ENDS))]


def _shingles(t: list[bytes]) -> set:
    return {tuple(t[i : i + SHINGLE]) for i in range(max(1, len(t) - SHINGLE + 1))} if t else set()


def _hashed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE term numbers; unknown terms are -1."""
    n = max(0, len(ids) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _FACTOR + (ids[k : n + k].astype(np.uint64) + np.uint64(1))
    return h


def _pieces(batches, rows: int = 256):
    """Arrow batches cut small, so that memory follows a few documents and not the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Statistics:
    """Of all items with words: their number, mean and largest length, and in how many each term occurs."""

    def __init__(self, n: int, mean: float, longest: int, df: dict[bytes, int]):
        self.n, self.mean, self.longest, self.df = n, mean, longest, df

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]]) -> Statistics:
        terms = [t for _, text in items if (t := _terms(text))]
        df: dict[bytes, int] = defaultdict(int)
        for t in terms:
            for w in set(t):
                df[w] += 1
        lengths = [len(t) for t in terms]
        return cls(len(terms), sum(lengths) / len(lengths) if terms else 1.0, max(lengths, default=1), df)


class Index:
    """Postings with block maxima for ``items``: (item_id, text); weights by ``statistics``, those of all items."""

    def __init__(self, items: list[tuple[int | None, str | None]], statistics: Statistics | None = None):
        self.items = [(i, t, text) for i, text in items if (t := _terms(text))]
        st = statistics or Statistics.of(items)
        n, df = st.n, st.df
        self.longest = st.longest
        self.n_blocks = max(1, -(-len(self.items) // BLOCK))
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.parts = []
        for at, (_, t, text) in enumerate(self.items):
            tf: dict[bytes, int] = defaultdict(int)
            for w in t:
                tf[w] += 1
            weight = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(t) / st.mean)) for w, c in tf.items()}
            lacking = int((1 - OVERLAP) * len(_shingles(t)) + 1e-9)
            least = sum(weight.values()) - sum(sorted(weight.values(), reverse=True)[:lacking])
            for w, x in weight.items():
                postings[w].append((at, x / least * (1 + 1e-6)))
            mark = (text or "").rfind("?") + 1
            cut = len(_terms(text[:mark])) if mark else len(t) // 2
            self.parts.append((_shingles(t), _shingles(t[:cut]), _shingles(t[cut:])))
        order = sorted(postings, key=lambda w: (max(x for _, x in postings[w]), w))
        self.vocabulary = {w: k for k, w in enumerate(order)}
        self.postings = [([a for a, _ in postings[w]], [x for _, x in postings[w]]) for w in order]
        self.top = np.array([max(x) for _, x in self.postings])
        # Per term, the blocks that have it and the largest weight in each: one list after the other.
        self.maxima = []
        for at, x in self.postings:
            best: dict[int, float] = {}
            for a, y in zip(at, x):
                best[a // BLOCK] = max(best.get(a // BLOCK, 0.0), y)
            self.maxima.append(best)
        self.start = np.cumsum([0, *(len(m) for m in self.maxima)])
        self.block = np.fromiter((k for m in self.maxima for k in m), np.int64, int(self.start[-1]))
        self.most = np.fromiter((x for m in self.maxima for x in m.values()), np.float64, int(self.start[-1]))
        # The postings one after the other, and the hashes of all items' shingles.
        self.begin = np.cumsum([0, *(len(a) for a, _ in self.postings)])
        self.holder = np.fromiter((a for at, _ in self.postings for a in at), np.int64, int(self.begin[-1]))
        self.weight = np.fromiter((x for _, w in self.postings for x in w), np.float64, int(self.begin[-1]))
        hashes = [_hashed(np.array([self.vocabulary[w] for w in t], np.int64)) for _, t, _ in self.items]
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self._ids: dict[bytes, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        """Term of each word of the text: -1 for others, -2 for words that are punctuation only."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self._ids
        if len(known) > _CACHE:
            known.clear()
        for w in set(words).difference(known):
            t = w.strip(_ENDS)
            known[w] = self.vocabulary.get(t, -1) if t else -2
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items with score >= 1 for a set of terms, by block-max WAND."""
        lists = [[*self.postings[k], 0, float(self.top[k]), self.maxima[k]] for k in terms]
        found = []
        while True:
            lists = [x for x in lists if x[2] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[2]])
            bound, pivot = 0.0, -1
            for j, x in enumerate(lists):
                bound += x[3]
                if bound >= 1:
                    pivot = j
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(x[4].get(block, 0.0) for x in lists[: pivot + 1]) < 1:
                # No item of this block can reach the threshold with these lists: go past it, or to the next list's item.
                to = min([(block + 1) * BLOCK, *(x[0][x[2]] for x in lists[pivot + 1 : pivot + 2])])
                for x in lists[: pivot + 1]:
                    x[2] = bisect_left(x[0], to, x[2])
                continue
            if lists[0][0][lists[0][2]] == item:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += x[1][x[2]]
                    x[2] += 1
                if score >= 1:
                    found.append((item, score))
            else:
                for x in lists[:pivot]:
                    if x[0][x[2]] < item:
                        x[2] = bisect_left(x[0], item, x[2])

    def _sums(self, passage: np.ndarray, term: np.ndarray, count: int) -> np.ndarray:
        """(count, blocks): the terms' block maxima added up by passage."""
        begin, n = self.start[term], self.start[term + 1] - self.start[term]
        end = np.cumsum(n)
        entry = np.repeat(begin - end + n, n)
        entry += np.arange(len(entry))
        key = np.repeat(passage * self.n_blocks, n)
        key += self.block[entry]
        return np.bincount(key, self.most[entry], count * self.n_blocks).reshape(count, self.n_blocks)

    def _alive(self, window: np.ndarray, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether some block can reach 1, by passage; ``window`` and ``term`` are sorted, ``first`` where each passage begins."""
        top = self.top[term]
        size = np.diff(np.r_[first, len(term)])
        before = np.cumsum(top) - top
        before -= np.repeat(before[first], size)
        # Terms come by rising weight: the leading ones that stay below HALF_WAY together are the rest.
        decides = before + top >= HALF_WAY
        rest = np.add.reduceat(np.where(decides, 0.0, top), first)
        out = np.add.reduceat(top, first) >= 1
        passage = np.repeat(np.arange(len(first)), size)
        step = max(1, _SUMS // self.n_blocks)
        # First the deciding terms' short lists and the rest's bound, then all lists of the passages left.
        for which, more in ((decides, rest), (True, np.zeros(len(first)))):
            at = np.flatnonzero(out[passage] & which)
            for lo in range(0, len(first), step):
                some = at[slice(*np.searchsorted(passage[at], [lo, lo + step]))]
                count = min(step, len(first) - lo)
                sums = self._sums(passage[some] - lo, term[some], count)
                out[lo : lo + count] &= sums.max(axis=1) + more[lo : lo + count] >= 1 - 1e-9
        return out

    def matches(self, text: str | None) -> dict[int, tuple[float, float]]:
        """Confirmed items of a text: best score and share of shingles, by place in ``items``."""
        ids = self.ids(text)
        ids = ids[ids != -2]
        if not len(ids) or not self.items:
            return {}
        step = self.longest
        n = max(1, -(-len(ids) // step) - SPAN + 1)
        at = np.flatnonzero(ids >= 0)
        # Distinct terms of each step, then of the SPAN steps of each window.
        size = len(self.vocabulary)
        steps = np.unique(at // step * size + ids[at])
        every = np.concatenate([steps - k * size for k in range(SPAN)])
        both = np.unique(every[(every >= 0) & (every < n * size)])
        if not len(both):
            return {}
        window, term = both // size, both % size
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        out: dict[int, tuple[float, float]] = {}
        words = None
        for f in np.flatnonzero(self._alive(window, term, first)):
            end = first[f + 1] if f + 1 < len(first) else len(term)
            for item, score in self.search(term[first[f] : end].tolist()):
                if words is None:
                    words = _terms(text)
                w = int(window[first[f]])
                passage = words[w * step : (w + SPAN) * step]
                here = _shingles(passage) if len(self.items[item][1]) >= SHINGLE else None
                share = self._share(here, passage, item)
                if share is not None and share > out.get(item, (0, 0))[1]:
                    out[item] = (score, share)
        if n > 1:
            self._spread(ids, text, out)
        return out

    def _spread(self, ids: np.ndarray, text: str, out: dict[int, tuple[float, float]]) -> None:
        """Adds to ``out`` the items that the text holds as a whole; shorter ones than a shingle lie in one window anyway."""
        hashes = _hashed(ids)
        place = np.searchsorted(self.hashes, hashes)
        at = np.flatnonzero(self.hashes.take(place, mode="clip") == hashes) if len(self.hashes) else place[:0]
        if not len(at):
            return  # no item shares a shingle with the text
        present = np.unique(ids[ids >= 0])
        words = _terms(text)
        here = {tuple(words[i : i + SHINGLE]) for i in at.tolist()}
        n = self.begin[present + 1] - self.begin[present]
        entry = np.repeat(self.begin[present] - np.cumsum(n) + n, n)
        entry += np.arange(len(entry))
        scores = np.bincount(self.holder[entry], self.weight[entry], len(self.items))
        for item in np.flatnonzero(scores >= 1).tolist():
            if item not in out and len(self.items[item][1]) >= SHINGLE:
                share = self._share(here, words, item)
                if share is not None:
                    out[item] = (float(scores[item]), share)

    def _share(self, here: set | None, words: list[bytes], item: int) -> float | None:
        whole, question, answer = self.parts[item]
        if here is None:
            t = self.items[item][1]
            return 1.0 if any(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1)) else None
        part = lambda s: sum(x in here for x in s) / len(s) if s and len(next(iter(s))) == SHINGLE else 1.0
        share = part(whole)
        return share if share >= OVERLAP and part(question) >= HALF and part(answer) >= HALF else None


def _item_words(batches):
    """(term, length of the item) per distinct term of an item; the first row of an item also has its length as ``size``."""
    for b in _pieces(batches):
        rows = []
        for text in b["text"].to_pylist():
            t = _terms(text)
            rows += [(w, len(t) if k == 0 else None) for k, w in enumerate(set(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["term", "size"])


def _indexes(spark, items: DataFrame, most_items: int | None = None):
    """Broadcast indexes, each over at most about ``most_items`` items, with the weights of all items."""
    most_items = most_items or ITEMS
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    words = items.select("text").mapInArrow(_item_words, "term binary, size long")
    sums = words.agg(F.count("size"), F.sum("size"), F.max("size")).first()
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-size[0] // most_items), -(-(size[1] or 0) // ITEM_BYTES))
    frequency = words.groupBy("term").agg(F.count("*").alias("df"))
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        theirs = frequency if parts == 1 else frequency.join(part.select("text").mapInArrow(_item_words, "term binary, size long").select("term").distinct(), "term", "left_semi")
        df = {bytes(r[0]): r[1] for r in theirs.collect()}  # terms of one part, bounded as its text is
        statistics = Statistics(sums[0], sums[1] / sums[0] if sums[0] else 1.0, sums[2] or 1, df)
        yield spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in part.collect()), key=str), statistics))


def contaminated(docs: DataFrame, items: DataFrame, most_items: int | None = None) -> DataFrame:
    """(doc_id, item_id, score, overlap): one row per confirmed pair."""
    found = None
    for index in _indexes(docs.sparkSession, items, most_items):
        def run(batches, index=index):
            ix = index.value
            for b in _pieces(batches):
                rows = [(d, ix.items[k][0], s, o) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for k, (s, o) in ix.matches(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "score", "overlap"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, overlap double")
        found = part if found is None else found.unionAll(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(docs: DataFrame, items: DataFrame, most_items: int | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows are tested one by one, whatever their ids."""
    for index in _indexes(docs.sparkSession, items, most_items):
        def run(batches, index=index):
            for b in _pieces(batches):
                yield b.filter(pa.array([not index.value.matches(t) for t in b["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
