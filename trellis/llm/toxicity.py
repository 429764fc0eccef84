"""Toxicity by a classifier chain: linear models in a row, each fed the probabilities of those before it.

The categories are predicted in the order of ``CATEGORIES``. The labels table has one column of toxicity, so the
earlier categories are graded ones that the texts alone decide: whether a toxic word occurs at all, then
whether several different ones do; the last is the label. Toxic words are found, not listed: terms that occur in
LEAST_DOCS toxic documents of LEAST_FOLDS folds and nearly only there, by their smoothed log-odds. Each later
model is trained with the out-of-fold probabilities of the earlier ones, so it sees them as noisy as they will be
on new text; the words that tell a fold are chosen without its rows, too. Copies share a fold, however many they are
(``copy_groups``), so words of one much-copied document are neither toxic words nor learnt by heart.

Training uses at most MAX_TRAIN labelled doc_ids, those with the smallest hash, one row each. Everything else
covers all documents. Features: distinct words (letters only, lower case, 32-bit hashes) that LEAST_DOCS labelled
documents of LEAST_FOLDS folds hold and whose log-odds are LEAST_TELLING or more either way, and the earlier
probabilities.

Defined results: a null text has no words; without labelled rows of both kinds all probabilities are the
share of the labels (0 without labels); null doc_ids are scored but never train; of rows that share a doc_id the
one with the smallest text hash trains; repeated rows each get their score; further columns play no part.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["any_insult", "several_insults", "toxic"]
MAX_TRAIN = 4000
FOLDS, STEPS, RATE, DECAY = 5, 200, 0.1, 1e-4
LEAST_DOCS, LEAST_FOLDS, LEAST_ODDS, LEAST_TELLING = 5, 3, 3.0, 1.5
#: Copies share this part of their words; they are looked for by BANDS keys of BAND hashes each.
ALIKE, BANDS, BAND = 0.8, 16, 6
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, BANDS * BAND, np.uint64) | np.uint64(1)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
_HASH: dict[str, int] = {}


def features(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the words of the whole text."""
    words = set(_WORD.findall((text or "").lower()))
    if len(_HASH) > _CACHE:
        _HASH.clear()
    for w in words.difference(_HASH):
        _HASH[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    return np.unique(np.fromiter(map(_HASH.__getitem__, words), np.int64, len(words)))


class _Rows:
    """Sparse rows over the columns ``known`` (sorted hashes), with dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], known: np.ndarray, extra: np.ndarray):
        every = np.concatenate(rows) if rows else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(known, every)
        has = at < len(known)
        has[has] = known[at[has]] == every[has]
        self.row, self.col, self.n, self.extra = row[has], at[has], len(rows), extra

    def scores(self, w, v, b):
        return np.bincount(self.row, w[self.col], self.n) + self.extra @ v + b


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], known: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple:
    """Logistic regression by Adagrad on full batches, classes weighted equally; a constant without both classes."""
    if y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return np.zeros(len(known)), np.zeros(extra.shape[1]), float(np.log(p / (1 - p)))
    x = _Rows(rows, known, extra)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, v, b = np.zeros(len(known)), np.zeros(extra.shape[1]), 0.0
    sw, sv, sb = np.full(len(known), 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    for _ in range(STEPS):
        g = (_sigmoid(x.scores(w, v, b)) - y) * weight
        gw = np.bincount(x.col, g[x.row], len(known)) + DECAY * w
        gv, gb = extra.T @ g + DECAY * v, g.sum()
        sw, sv, sb = sw + gw**2, sv + gv**2, sb + gb**2
        w, v, b = w - RATE * gw / np.sqrt(sw), v - RATE * gv / np.sqrt(sv), b - RATE * gb / np.sqrt(sb)
    return w, v, float(b)


def probability(model: tuple, rows: list[np.ndarray], known: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return _sigmoid(_Rows(rows, known, extra).scores(*model))


def _bands(row: np.ndarray) -> list[int]:
    """Keys of a row's word set that similar sets share: BANDS x BAND smallest values under different hashes."""
    if not len(row):
        return []
    with np.errstate(over="ignore"):
        h = (row.astype(np.uint64)[:, None] + np.uint64(1)) * _MULTIPLIERS
        low = (h ^ (h >> np.uint64(29))).min(axis=0).reshape(BANDS, BAND)
    return [zlib.crc32(b.tobytes(), k) for k, b in enumerate(low)]


def copy_groups(rows: list[np.ndarray]) -> np.ndarray:
    """The same number for rows whose word sets share ALIKE of their union, directly or through others.

    Rows that agree in a band are compared with the band's first row; however many copies there are, they agree in
    nearly every band.
    """
    root = np.arange(len(rows))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, r in enumerate(rows):
        for k, key in enumerate(_bands(r)):
            j = first.setdefault((k, key), i)
            a, b = find(i), find(j)
            if a != b:
                shared = len(np.intersect1d(r, rows[j], assume_unique=True))
                if shared >= ALIKE * (len(r) + len(rows[j]) - shared):
                    root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(rows))], np.int64)


def folds(rows: list[np.ndarray]) -> np.ndarray:
    """Fold of each row; copies share theirs. It hangs on the rows of a group, not on their order."""
    own = np.array([zlib.crc32(r.tobytes()) for r in rows], np.int64)
    least: dict[int, int] = {}
    groups = copy_groups(rows).tolist()
    for g, c in zip(groups, own.tolist()):
        least[g] = min(least.get(g, c), c)
    return np.array([zlib.crc32(str(least[g]).encode()) % FOLDS for g in groups], np.int64)


def vocabulary(rows: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, lexicon): the telling words of these labelled rows, and those found nearly only in toxic ones."""
    n, pos = len(rows), int(toxic.sum())
    words, at = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    hits = np.array([np.bincount(at[toxic[row] == t], minlength=len(words)) for t in (0, 1)])
    in_folds = lambda some: sum(np.bincount(at[some & (fold[row] == k)], minlength=len(words)) > 0 for k in range(FOLDS))
    odds = np.log((hits[1] + 0.5) / (pos + 1)) - np.log((hits[0] + 0.5) / (n - pos + 1))
    known = words[(hits.sum(axis=0) >= LEAST_DOCS) & (abs(odds) >= LEAST_TELLING) & (in_folds(np.ones(len(row), bool)) >= LEAST_FOLDS)]
    lexicon = words[(hits[1] >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (in_folds(toxic[row] == 1) >= LEAST_FOLDS)]
    return known, lexicon


def _targets(rows: list[np.ndarray], toxic: np.ndarray, lexicon: np.ndarray) -> list[np.ndarray]:
    """What each category's model learns."""
    level = np.array([np.isin(r, lexicon, assume_unique=True).sum() for r in rows])
    return [(level >= 1).astype(float), (level >= 2).astype(float), (toxic == 1).astype(float)]


class Chain:
    """Models by category, in order, over the columns ``known``.

    What a fold is told by out of fold, its words and models alike, is chosen from the other folds' rows alone.
    """

    def __init__(self, rows: list[np.ndarray], toxic: np.ndarray):
        fold = folds(rows)
        self.known, self.lexicon = vocabulary(rows, toxic, fold)
        self.by_fold = {}
        for k in range(FOLDS):
            here, there = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(here) and len(there):
                others = [rows[i] for i in there]
                known, lexicon = vocabulary(others, toxic[there], fold[there])
                self.by_fold[k] = here, there, others, known, lexicon, _targets(others, toxic[there], lexicon)
        self.models, extra = [], np.zeros((len(rows), 0))
        for c, y in enumerate(_targets(rows, toxic, self.lexicon)):
            out = np.full(len(rows), y.mean())
            for here, there, others, known, _, targets in self.by_fold.values():
                m = fit(others, known, extra[there], targets[c])
                out[here] = probability(m, [rows[i] for i in here], known, extra[here])
            self.models.append(fit(rows, self.known, extra, y))
            extra = np.column_stack([extra, out])
        self.fold, self.out_of_fold = fold, extra
        self.threshold = _cut(extra[:, -1], toxic)

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        """(documents, categories) probabilities."""
        extra = np.zeros((len(rows), 0))
        for m in self.models:
            extra = np.column_stack([extra, probability(m, rows, self.known, extra)])
        return extra


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold threshold with the best F1, in the middle of the gap it falls into."""
    if y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    nxt = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + nxt) / 2)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain | None:
    """The chain, from a bounded sample of labelled doc_ids; features are made on the executors."""
    some = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    some = docs.sparkSession.createDataFrame(some.collect(), "doc_id long, toxic int")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [features(t) for t in b["text"].to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else [], pa.int64()))], ["doc_id", "toxic", "f"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = docs.join(F.broadcast(some), "doc_id")
    # One row for each doc_id, so the driver gets max_train at most, however often one is repeated.
    chosen = labelled.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("x")).select("doc_id", "x.text", "x.toxic")
    got = chosen.mapInArrow(run, "doc_id long, toxic int, f array<long>").toArrow().sort_by("doc_id")
    if got.num_rows == 0:
        return None
    rows = [np.array(x.as_py(), np.int64) for x in got["f"]]
    return Chain(rows, got["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, p_<category>..., toxic) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(None if chain is None else (chain.models, chain.known, chain.threshold))
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                p = np.zeros((b.num_rows, len(names)))
                cut = 0.5
                if shared.value is not None:
                    one = Chain.__new__(Chain)
                    one.models, one.known, cut = shared.value
                    p = one.predict([features(t) for t in b["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x) for x in p.T), pa.array(p[:, -1] >= cut)], ["doc_id", *names, "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
