"""WARC archives: a writer, the normaliser of monolithic gzip files, and reading by offset index.

An archive that was compressed as one gzip stream cannot be read from the middle. The normaliser inflates
such a stream once, in pieces, and rewrites every record as a gzip member of its own beside a sidecar index
with one JSON line per record (offset, length, page, type); single records are then read by seeking.
Each archive is one task's work, whatever the size of the corpus. Files go to the shared folder under the
archive's name only when complete (written under an attempt's name, then renamed), with fixed dates and no
time stamps, so a repeated task writes the same bytes.

Equal payloads of at least ``least`` bytes are stored once: the record with the smallest page_id is the
response, the others are revisits that refer to it and carry length and digest in their headers. Which record
that is comes from a table without payloads (row number, page_id, url, digest), so rows of one payload may be any
share of the input: payloads themselves are dealt by row number. The number is that of the row in the
source, which must give its rows in the same order twice; a row whose digest has changed is an error.

Defined results: a null html is an empty payload; a null url leaves the header out; a null page_id is
never referred to, and is a revisit only if a page with an id has the payload; of rows that share page_id and
payload, that with the smallest url (null first), then row number, is the response; every record has a record id
of its own, made from page_id, digest and row number; further columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Raw bytes after which a task starts its next archive.
ROLL = 64 << 20
_PIECE = 1 << 20
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, payload_digest: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}:{number}')}>"


def record(page_id, url, payload: bytes, number: int = 0, refers_to: tuple[int, int] | None = None) -> bytes:
    """One WARC record with its closing blank lines; ``refers_to``: page_id and row number of the response it revisits."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": record_id(page_id, sha, number), "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head["WARC-Payload-Digest"] = "sha1:" + sha
    head["X-Payload-Length"] = len(payload)
    if page_id is not None:
        head["X-Page-Id"] = page_id
    if refers_to:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to[0], sha, refers_to[1]), "X-Refers-To-Page-Id": refers_to[0]}
    block = http if refers_to else http + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(_END)
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(_END)[2]


def inflated(stream):
    """The content of a gzip file, at most _PIECE bytes at a time; members may follow each other."""
    z = zlib.decompressobj(31)
    while piece := stream.read(_PIECE):
        while piece:
            yield z.decompress(piece, _PIECE)
            piece = z.unconsumed_tail
            if z.eof:
                piece, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def split_records(pieces):
    """Whole records out of inflated pieces; keeps one record and one piece in memory."""
    buffer, need = bytearray(), None
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                at = buffer.find(_END)
                if at < 0:
                    break
                head = bytes(buffer[:at]).lower()
                length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.startswith(b"content-length:"))
                need = at + len(_END) + length + len(_END)
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("the stream ends inside a record")


def normalise(source, target, index) -> int:
    """Rewrites a monolithic gzip stream record by record; returns the number of records."""
    offset = n = 0
    for raw in split_records(inflated(source)):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        headers, _ = parse(raw[: raw.find(_END) + len(_END)])
        target.write(member)
        entry = {"offset": offset, "length": len(member), "page_id": headers.get("X-Page-Id"), "type": headers["WARC-Type"], "uri": headers.get("WARC-Target-URI")}
        index.write((json.dumps(entry) + "\n").encode())
        offset, n = offset + len(member), n + 1
    return n


def _pieces(batches, rows: int = 64):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _files(root: str):
    where, path = fs.FileSystem.from_uri(root)
    where.create_dir(path, recursive=True)
    return where, path


class _Out:
    """A file that gets its name when it is complete."""

    def __init__(self, where, path: str):
        self.where, self.path, self.tmp = where, path, f"{path}.{TaskContext.get().taskAttemptId()}"
        self.stream = where.open_output_stream(self.tmp, compression=None)

    def __enter__(self):
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.where.move(self.tmp, self.path)


def decide(ws: Workspace, pages: DataFrame, least: int) -> DataFrame:
    """(number, sha1, first, first_number) of every row; ``first`` is null for responses. ``pages``: number, page_id, url, html, sha1."""
    slim = ws.save(pages.select("number", "page_id", "url", "sha1", (F.octet_length("html") >= least).alias("shared")), "pages")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "number"))
    first = slim.where("shared").groupBy("sha1").agg(F.min(named).alias("f"), F.count("*").alias("c")).where("c > 1 and f is not null")
    first = ws.save(first.select("sha1", F.col("f.page_id").alias("first"), F.col("f.number").alias("first_number"), F.lit(True).alias("shared")), "first")
    other = F.col("number") != F.col("first_number")
    return slim.join(first, ["sha1", "shared"], "left").select("number", F.col("sha1").alias("sha1_then"), F.when(other, F.col("first")).alias("first"), F.when(other, F.col("first_number")).alias("first_number"))


def write_monolithic(ws: Workspace, pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as gzip streams; returns (archive, records) lazily."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.monotonically_increasing_id().alias("number"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1"))
    joined = pages.join(ws.save(decide(ws, pages, least), "decisions"), "number", "left")
    moved = F.raise_error(F.lit("the source gave its rows in another order the second time")).cast("string")
    pages = joined.select("page_id", "url", F.when(F.col("sha1").eqNullSafe(F.col("sha1_then")), F.col("html")).otherwise(moved).alias("html"), "number", "first", "first_number")

    def run(batches):
        where, folder = _files(root)
        name = f"part-{TaskContext.get().partitionId():06d}"
        rows = (r for b in _pieces(batches) for r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "number", "first", "first_number"))))
        k, row = 0, next(rows, None)
        while row is not None:
            n = size = 0
            archive = f"{folder}/{name}-{k:04d}.warc.gz"
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            with _Out(where, archive) as out:
                while row is not None and size < ROLL:
                    raw = record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3], None if row[4] is None else row[4:])
                    out.write(z.compress(raw))
                    n, size, row = n + 1, size + len(raw), next(rows, None)
                out.write(z.flush())
            yield pa.RecordBatch.from_pydict({"archive": [archive.rpartition("/")[2]], "records": pa.array([n], pa.int64())})
            k += 1

    return pages.mapInArrow(run, "archive string, records long")


def normalise_all(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Normalises every archive of a manifest from one folder to another; returns (archive, records) lazily."""
    def run(batches):
        where, there = _files(source)
        to, folder = _files(target)
        for b in batches:
            for archive in b["archive"].to_pylist():
                with where.open_input_stream(f"{there}/{archive}", compression=None) as stream, _Out(to, f"{folder}/{archive}") as out, _Out(to, f"{folder}/{archive}.idx") as index:
                    n = normalise(stream, out, index)
                yield pa.RecordBatch.from_pydict({"archive": [archive], "records": pa.array([n], pa.int64())})

    return manifest.mapInArrow(run, "archive string, records long")


def read_normalised(manifest: DataFrame, root: str) -> DataFrame:
    """A row per record, read by its index entry: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        where, folder = _files(root)
        for b in batches:
            for archive in b["archive"].to_pylist():
                with where.open_input_stream(f"{folder}/{archive}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with where.open_input_file(f"{folder}/{archive}") as f:
                    for e in entries:
                        h, payload = parse(zlib.decompress(f.read_at(e["length"], e["offset"]), 31))
                        want = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and digest(payload) != want:
                            raise ValueError(f"{archive}: payload digest of page {h.get('X-Page-Id')} differs")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        rows.append((number("X-Page-Id"), h.get("WARC-Target-URI"), number("X-Payload-Length"), want, h["WARC-Type"], number("X-Refers-To-Page-Id")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return manifest.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives, normalises them and reads every record back."""
    ws = Workspace(pages.sparkSession, "warc")
    manifest = ws.save(write_monolithic(ws, pages, ws.path("monolithic"), least), "manifest")
    n = max(1, manifest.count())
    done = ws.save(normalise_all(manifest.repartition(n, "archive"), ws.path("monolithic"), ws.path("archives")), "normalised")
    ws.drop("monolithic", "pages", "first", "decisions")
    return read_normalised(done.repartition(n, "archive"), ws.path("archives"))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
