"""SentencePiece encoding and decoding with byte-pair pieces; giant documents by a max-plus scan over chunks.

A text is a path through the lattice of its pieces. For byte-pair pieces a path is the encoding if and
only if each two neighbours are what their joint text is encoded as, so the lattice has weight 0 on
such neighbours and minus infinity elsewhere; the best path of weight 0 is unique. A state at a chunk's
border is the piece that reaches or crosses it. A chunk gives the transfer matrix between the states at
its two borders (weights 0 or minus infinity, so the set of its finite entries).

The max-plus product of matrices is associative, so border states come from a tree: SPAN neighbouring
matrices are multiplied in one task, their products again SPAN at a time, up to one matrix per document,
whose start and end state are known. Then, level by level down, each group of SPAN matrices finds the states
of its inner borders from those of its two outer ones. No task holds more than SPAN matrices, however
long the document. Each chunk is then traced back alone between its two states, and the assembled pieces of
the whole document are decoded once and compared with its text by length and SHA-256.

No piece spans from a non-blank to a blank, so such a place is a border in every path; between the first
and the last one of a chunk its inside is encoded word by word, each distinct word once, by the
sentencepiece library, as are documents of up to CHUNK characters, which are one chunk. The matrices decide
the stretches around chunk borders, and whole chunks without such a place.

Results are the library's own, with one exception: a literal U+2581, which the library would turn into a
blank, is written as its three byte pieces, so that decoding is always exact.

Defined results: a null or empty text has no pieces; rows equal in doc_id and text are encoded alike; further
columns play no part; a model for which a border state is not unique is no byte-pair model, and an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import Workspace

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
#: Matrices that one task multiplies, or resolves.
SPAN = 64
#: Distinct stretches without blanks that are remembered, and the longest of them.
_CACHE, _LONGEST_KEPT = 200_000, 64
_MARK = "▁"
_UNIT = re.compile(r" +[^ ]*|[^ ]+")


def pack(ids: list[int]) -> bytes:
    """Ids as 32-bit integers in a row."""
    return array("i", ids).tobytes()


class Codec:
    """Encoder and decoder for the bytes of a byte-pair SentencePiece model."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        proto.normalizer_spec.add_dummy_prefix = False  # the blank before a text is put there by encode()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.scores, self.ids, self.bytes, self.byte_ids = {}, {}, [], {}
        for i, p in enumerate(proto.pieces):
            if p.type == p.NORMAL:
                text = p.piece.replace(_MARK, " ")
                self.scores[text], self.ids[text] = p.score, i
                self.bytes.append(text.encode())
            elif p.type == p.BYTE:
                b = int(p.piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes.append(bytes([b]))
            else:
                self.bytes.append(b"")
        self.longest = max(map(len, self.scores))
        self.units: dict[str, bytes] = {}  # packed ids
        self.table = pa.array(self.bytes, pa.large_binary())
        self.fits = lru_cache(200_000)(self._fits)
        self.mark = [self.byte_ids[b] for b in _MARK.encode()]

    def piece_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Packed ids by unit. Short units are remembered; long ones, as of scripts without blanks, are not."""
        if len(self.units) > _CACHE:
            self.units.clear()
        new = list(units.difference(self.units))
        plain = [u for u in new if _MARK not in u]
        found = dict(zip(plain, map(pack, self.library.encode(plain, num_threads=1))))
        for u in new:
            if _MARK in u:
                parts = [self.library.encode(x) if x else [] for x in u.split(_MARK)]
                found[u] = pack(parts[0] + [i for p in parts[1:] for i in self.mark + p])
        self.units.update((u, x) for u, x in found.items() if len(u) <= _LONGEST_KEPT)
        return {u: x for u, x in found.items() if len(u) > _LONGEST_KEPT}

    def encode_inside(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that start and end at a border; the blank before each is part of it."""
        units = [_UNIT.findall(s) for s in texts]
        long, short = self._learn(set(chain.from_iterable(units))), self.units
        if not long:
            return [b"".join(map(short.__getitem__, u)) for u in units]
        return [b"".join(long[x] if x in long else short[x] for x in u) for u in units]

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_inside([" " + text])[0]).tolist() if text else []

    def decode_inside(self, packed: list[bytes]) -> list[bytes]:
        """What the pieces of each sequence give, as one concatenation of the table's rows."""
        joined = b"".join(packed)
        if not joined:
            return [b""] * len(packed)
        rows = self.table.take(pa.array(np.frombuffer(joined, np.int32)))
        _, offsets, data = rows.buffers()
        at = np.frombuffer(offsets, np.int64)[np.cumsum([0, *map(len, packed)]) // 4].tolist()
        return [data.slice(x, y - x).to_pybytes() for x, y in zip(at, at[1:])]

    def gives(self, ids: list[int], s: str) -> bool:
        """Whether pieces of a stretch inside a text decode to it."""
        return b"".join(map(self.bytes.__getitem__, ids)) == s.encode()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")

    def merged(self, s: str) -> list[str]:
        """Byte-pair encoding of a short text by its definition: the best-scored neighbours first, then the leftmost."""
        parts = list(s)
        while True:
            best = max(((self.scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, a: str, b: str) -> bool:
        return self.merged(a + b) == ([a, b] if a else [b])

    def reach(self, s: str, at: int, last: str, stop: int) -> dict[int, dict[str, tuple[int, str]]]:
        """Pieces that end at each place, by paths from ``at`` after the piece ``last``; none starts at or beyond ``stop``.

        Values are the place and piece before.
        """
        ends: dict[int, dict[str, tuple[int, str]]] = {at: {last: (-1, "")}}
        for start in range(at, min(stop, len(s))):
            for before in ends.get(start, {}):
                for n in range(1, min(self.longest, len(s) - start) + 1):
                    piece = s[start : start + n]
                    if (n == 1 or piece in self.scores) and self.fits(before, piece):
                        ends.setdefault(start + n, {}).setdefault(piece, (start, before))
        return ends

    def trace(self, ends, place: int, piece: str, at: int) -> list[int]:
        out: list[str] = []
        while place > at:
            out.append(piece)
            place, piece = ends[place][piece]
        return [i for p in reversed(out) for i in self.piece_ids(p)]

    def border(self, s: str, at: int) -> list[str]:
        """States at a chunk's border: 'n|piece' with n the characters of the piece beyond it."""
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(start + self.longest, len(s)) + 1):
                if end - start == 1 or s[start:end] in self.scores:
                    out.append(f"{end - at}|{s[start:end]}")
        return out


def _inner(s: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place in lo..hi where every path has a border: a blank after a non-blank."""
    first = next((k for k in range(max(lo, 1), hi + 1) if k < len(s) and s[k] == " " and s[k - 1] != " "), None)
    if first is None:
        return None
    return first, next(k for k in range(hi, first - 1, -1) if k < len(s) and s[k] == " " and s[k - 1] != " ")


def transfer(codec: Codec, s: str, lo: int, hi: int, begin: bool, final: bool) -> dict[str, list[str]]:
    """Finite entries of a chunk's matrix: for each state at ``lo`` the states at ``hi`` that paths lead to.

    ``s`` is the chunk lo..hi with the characters around it that a piece can reach.
    """
    def out(ends):
        states = [f"{e - hi}|{p}" for e, ps in ends.items() if e >= hi for p in ps if e - len(p) < hi]
        return [x for x in states if not final or x.startswith("0|")]

    inner = _inner(s, lo, hi)
    tail = None if inner is None else out(codec.reach(s, inner[1], "", hi)) if inner[1] < hi else ["0|"]
    rows = {}
    for state in ["0|"] if begin else ["0|", *codec.border(s, lo)]:
        n, last = state.split("|", 1)
        if inner is None:
            to = out(codec.reach(s, lo + int(n), last, hi))
        else:
            if not last and not begin and inner[0] != lo:
                continue  # "0|" stands for a border that every path has
            at = lo + int(n)
            to = tail if at == inner[0] or at < inner[0] and inner[0] in codec.reach(s, at, last, inner[0]) else []
        if to:
            rows[state] = to
    return rows


def product(a: dict[str, list[str]], b: dict[str, list[str]]) -> dict[str, list[str]]:
    """Max-plus product of two matrices with weights 0 and minus infinity."""
    return {k: to for k, v in a.items() if (to := sorted({x for m in v for x in b.get(m, ())}))}


def inner_states(matrices: list[dict[str, list[str]]], start: str, stop: str) -> list[str]:
    """The state at every border of neighbouring matrices, from ``start`` before the first to ``stop`` after the last."""
    forward = [{start}]
    for m in matrices:
        forward.append({x for k in forward[-1] for x in m.get(k, ())})
    back, out = {stop}, [{stop}]
    for m, f in zip(reversed(matrices), reversed(forward[:-1])):
        back = {k for k in f if back.intersection(m.get(k, ()))}
        out.append(back)
    if any(len(x) != 1 for x in out):
        raise ValueError("a chunk border has no unique state; the model is not a byte-pair one")
    return [next(iter(x)) for x in reversed(out)]


def cut_edges(s: str, lo: int, hi: int) -> tuple[str, str, str | None]:
    """A chunk cut at its first and last border that every path has: (head, inside, tail).

    Without such a border the head is the whole of ``s`` and the tail is None.
    """
    inner = _inner(s, lo, hi)
    return (s, "", None) if inner is None else (s[: inner[0]], s[inner[0] : inner[1]], s[inner[1] :])


def trace_edges(codec: Codec, head: str, tail: str | None, lo: int, hi: int, start: str, stop: str) -> tuple[list[int], list[int], bool]:
    """Ids of the pieces before and after a chunk's inside, between its two states, and whether they decode exactly.

    ``tail`` is None for a chunk without an inside; ``hi`` counts from the start of the tail, or else of the head.
    """
    n, last = start.split("|", 1)
    at, (m, piece) = lo + int(n), stop.split("|", 1)
    if tail is None:
        out = codec.trace(codec.reach(head, at, last, hi), hi + int(m), piece, at)
        return out, [], codec.gives(out, head[at : hi + int(m)])
    before: list[int] = []
    if at < len(head):
        ends = codec.reach(head, at, last, len(head))
        before = codec.trace(ends, len(head), next(iter(ends[len(head)])), at)
    after = codec.trace(codec.reach(tail, 0, "", hi), hi + int(m), piece, 0) if hi else []
    return before, after, codec.gives(before, head[at:]) and codec.gives(after, tail[: hi + int(m)] if hi else "")


_CODECS: dict[int, Codec] = {}


def _codec(model) -> Codec:
    """The codec of a broadcast model, one for each Python worker."""
    key = hash(model.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model.value)
    return _CODECS[key]


def _id_arrays(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _pieces(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) per row of ``docs`` (doc_id, text); ``exact``: decoding gives the text back."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def small(batches):
        codec = _codec(model)
        for b in _pieces(batches):
            texts = [" " + t if t else "" for t in b["text"].to_pylist()]
            ids = codec.encode_inside(texts)
            exact = [x == t.encode() for x, t in zip(codec.decode_inside(ids), texts)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), _id_arrays(ids), pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids", "exact"])

    schema = "doc_id long, n_tokens long, ids array<int>, exact boolean"
    giant = F.coalesce(F.length("text"), F.lit(0)) > chunk
    return docs.where(~giant).mapInArrow(small, schema).unionAll(_encode_giants(docs.where(giant), model, chunk))


def _encode_giants(docs: DataFrame, model, chunk: int) -> DataFrame:
    ws = Workspace(docs.sparkSession, "pieces")
    key = ["k1", "k2"]
    keyed = docs.withColumns({"k1": F.coalesce("doc_id", F.lit(-(2**63)).cast("long")), "k2": F.xxhash64("text")})
    around = _codec(model).longest + 2  # what a piece across a border can reach, and the characters beside it

    def cut(batches):
        for b in _pieces(batches, 16):
            for k1, k2, text in zip(*(b[c].to_pylist() for c in (*key, "text"))):
                s = " " + text
                n = -(-len(s) // chunk)
                for i in range(n):
                    lo = max(0, i * chunk - around)
                    yield pa.RecordBatch.from_pylist([{"k1": k1, "k2": k2, "i": i, "n": n, "lo": i * chunk - lo, "hi": min(len(s), (i + 1) * chunk) - lo, "s": s[lo : (i + 1) * chunk + around]}], schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("s", pa.string())]))

    chunks = keyed.select(*key, "text").mapInArrow(cut, "k1 long, k2 long, i long, n long, lo long, hi long, s string")
    # One chunk is one unit of work, wherever its document was; rows that repeat give the same chunks.
    chunks = ws.save(chunks.dropDuplicates([*key, "i"]), "chunks")

    def through(batches):
        codec = _codec(model)
        for b in _pieces(batches):
            rows = b.to_pylist()
            m = [json.dumps(transfer(codec, r["s"], r["lo"], r["hi"], r["i"] == 0, r["i"] == r["n"] - 1)) for r in rows]
            heads, insides, tails = zip(*(cut_edges(r["s"], r["lo"], r["hi"]) for r in rows))
            ids = codec.encode_inside(insides)
            exact = [x == t.encode() for x, t in zip(codec.decode_inside(ids), insides)]
            hi = [r["hi"] if t is None else r["hi"] - len(r["s"]) + len(t) for r, t in zip(rows, tails)]
            yield pa.RecordBatch.from_arrays(
                [b["k1"], b["k2"], b["i"], b["n"], b["lo"], pa.array(hi, pa.int64()), pa.array(m, pa.string()), pa.array(heads, pa.string()), pa.array(tails, pa.string()), _id_arrays(ids), pa.array(exact, pa.bool_())],
                [*key, "i", "n", "lo", "hi", "m", "head", "tail", "ids", "exact"],
            )

    # The inside of a chunk does not hang on its states, so it is encoded as the matrix is made; only the
    # short texts on both sides of it wait for the states.
    passed = ws.save(chunks.mapInArrow(through, "k1 long, k2 long, i long, n long, lo long, hi long, m string, head string, tail string, ids array<int>, exact boolean"), "passed")

    borders = _border_states(ws, passed.select(*key, "i", "n", "m"), key)

    def back(batches):
        codec = _codec(model)
        for b in _pieces(batches):
            found = [trace_edges(codec, r["head"], r["tail"], r["lo"], r["hi"], r["start"], r["stop"]) for r in b.to_pylist()]
            for part, side in ((0, 0), (2, 1)):
                yield pa.RecordBatch.from_arrays([b["k1"], b["k2"], b["i"], pa.array([part] * len(found), pa.int32()), _id_arrays([pack(x[side]) for x in found]), pa.array([x[2] for x in found], pa.bool_())], [*key, "i", "part", "ids", "exact"])

    edges = passed.select(*key, "i", "lo", "hi", "head", "tail").join(borders, [*key, "i"])
    edges = edges.select(*key, "i", "lo", "hi", "head", "tail", "start", "stop").mapInArrow(back, "k1 long, k2 long, i long, part int, ids array<int>, exact boolean")
    parts = passed.select(*key, "i", F.lit(1).alias("part"), "ids", "exact").unionAll(edges)
    # The whole document once more: a stretch may be exact and still leave a gap, or overlap its neighbour.
    stretches = F.array_sort(F.collect_list(F.struct("i", "part", "ids")))
    whole = parts.groupBy(*key).agg(F.flatten(F.transform(stretches, lambda x: x["ids"])).alias("ids"), F.bool_and("exact").alias("parts_exact"))
    text = keyed.select("doc_id", *key, F.octet_length("text").cast("long").alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))

    def check(batches):
        codec = _codec(model)
        for b in _pieces(batches, 4):
            ids = b["ids"]
            found = [codec.decode_inside([ids[k].values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()])[0][1:] for k in range(b.num_rows)]
            same = [len(x) == n and hashlib.sha256(x).hexdigest() == h for x, n, h in zip(found, b["size"].to_pylist(), b["sha"].to_pylist())]
            exact = pa.array([p and q for p, q in zip(b["parts_exact"].to_pylist(), same)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(ids[k]) for k in range(b.num_rows)], pa.int64()), ids.cast(pa.list_(pa.int32())), exact], ["doc_id", "n_tokens", "ids", "exact"])

    joined = text.join(whole, key).select("doc_id", "size", "sha", "ids", "parts_exact")
    return joined.mapInArrow(check, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def _border_states(ws: Workspace, matrices: DataFrame, key: list[str], span: int | None = None) -> DataFrame:
    """(key, i, start, stop) of every matrix: products up a tree of ``span`` at a time, then states down it.

    ``matrices``: key, i (0 to n - 1), n, m (JSON). Each level is a written table, SPAN times smaller than the last.
    """
    span = span or SPAN
    levels, most = [matrices], matrices.agg(F.max("n")).first()[0] or 0
    names = ["k1", "k2"]

    def multiply(batches):
        for b in _pieces(batches, 16):
            out = []
            for ms in b["ms"].to_pylist():
                total = json.loads(ms[0]["m"])
                for x in ms[1:]:
                    total = product(total, json.loads(x["m"]))
                out.append(json.dumps(total))
            yield pa.RecordBatch.from_arrays([b[c] for c in (*names, "i")] + [pa.array(out, pa.string())], [*names, "i", "m"])

    def grouped(level):
        return level.groupBy(*key, F.floor(F.col("i") / span).alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("at"), "m"))).alias("ms"))

    while most > 1:
        up = grouped(levels[-1]).mapInArrow(multiply, "k1 long, k2 long, i long, m string")
        levels.append(ws.save(up, f"products{len(levels)}"))
        most = -(-most // span)

    def ends(batches):
        for b in _pieces(batches, 256):
            stops = []
            for m in b["m"].to_pylist():
                to = json.loads(m).get("0|", [])
                if len(to) != 1:
                    raise ValueError("a document's end has no unique state; the model is not a byte-pair one")
                stops.append(to[0])
            yield pa.RecordBatch.from_arrays([b[c] for c in (*names, "i")] + [pa.array(["0|"] * len(stops), pa.string()), pa.array(stops, pa.string())], [*names, "i", "start", "stop"])

    def resolve(batches):
        for b in _pieces(batches, 16):
            for k1, k2, ms, start, stop in zip(*(b[c].to_pylist() for c in (*names, "ms", "start", "stop"))):
                at = inner_states([json.loads(x["m"]) for x in ms], start, stop)
                n = len(ms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array([x["at"] for x in ms], pa.int64()), pa.array(at[:-1], pa.string()), pa.array(at[1:], pa.string())],
                    [*names, "i", "start", "stop"],
                )

    schema = "k1 long, k2 long, i long, start string, stop string"
    states = levels[-1].select(*key, "i", "m").mapInArrow(ends, schema)
    for level in reversed(levels[:-1]):
        states = grouped(level).join(states, [*key, "i"]).mapInArrow(resolve, schema)
    return states


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
