"""Record ids, ties, the least payload, and bounded inflation of archives."""

import base64
import hashlib
import io
import zlib

from pyspark.sql import functions as F

from trellis.llm import warc
from trellis.llm.common import Workspace

PAGES = [(2, "b", "same"), (2, "b", "same"), (2, "a", "same"), (5, "c", "same"), (None, "z", "same"), (None, "n", "alone"), (None, "n", "alone"), (7, None, "x" * 40), (6, None, "x" * 40), (8, "u", None), (9, "u", "")]


def frame(spark):
    return spark.createDataFrame([(*p, 0, "clash") for p in PAGES], "page_id long, url string, html string, number int, sha1 string")


def brute(least):
    out, payload = [], [(h or "").encode() for _, _, h in PAGES]
    for k, (page, url, _) in enumerate(PAGES):
        same = sorted((p, u is not None, u or "", j) for j, (p, u, _) in enumerate(PAGES) if payload[j] == payload[k] and p is not None and len(payload[j]) >= least)
        shared = len(payload[k]) >= least and bool(same)
        other = shared and same[0][3] != k
        out.append((page, url, len(payload[k]), base64.b32encode(hashlib.sha1(payload[k]).digest()).decode(), "revisit" if other else "response", same[0][0] if other else None))
    return sorted(out, key=str)


def test_one_response_for_each_payload(spark):
    for least in (0, 5):
        got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark), least).collect()]
        assert sorted(got, key=str) == brute(least)


def test_record_ids_are_unique_and_resolve(spark):
    ws = Workspace(spark, "test-warc")
    manifest = warc.write_monolithic(ws, frame(spark), ws.path("m")).collect()
    heads = []
    for m in manifest:
        path = ws.path("m").removeprefix("file://") + "/" + m.archive
        heads += [warc.parse(raw)[0] for raw in warc.split_records(warc.inflated(open(path, "rb")))]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(PAGES)
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert responses[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]


def test_inflation_is_bounded():
    data = b"a" * (40 << 20)
    packed = zlib.compress(data, 9, 31)
    pieces = list(warc.inflated(io.BytesIO(packed + zlib.compress(b"more", 9, 31))))
    assert max(map(len, pieces)) <= warc._PIECE and b"".join(pieces) == data + b"more"
