"""Token-bucket throttling of clicks as a stateful streaming query.

A client's credit is in microseconds: MOST at first and at most, and it grows by the time since the client's last
settled click. A click takes COST if the credit allows (admitted), else it is throttled. A penalty lasts from the
first throttled click after an admission until the instant the credit reaches COST. Clicks settle by (ts,
click_id) once the watermark W, the largest ts of all earlier batches less GRACE, has passed them; a click that
arrives behind W is late and takes nothing.

Clients are dealt into buckets by hash, one group of ``applyInPandasWithState`` each, so there are about
CLICKS_A_BUCKET clicks to a group however many clients there are. A batch holds one tick row for every bucket: it
carries W, and makes each bucket settle what waits even where it has no click. A bucket's state is one
zstd-packed set of columns: the waiting clicks by ts, and the credit of clients that have not filled up by W (a
full one is as good as new). Settling sorts with numpy and walks the clicks of each client in whole numbers.

``feed`` publishes one written batch after another into the folder that the stream reads and starts the query
anew for each, on one checkpoint: a batch is one micro-batch, and the sink takes each exactly once. Only W of each
batch, the count of clicks and the span of hours pass the driver. One client's clicks are a chain by
definition: of each batch they are settled by one task, and their waiting clicks are one state value.

Defined results: clicks without ts or client_id go, equal rows count once; a null arrived_at comes in the last
batch; a null click_id settles before others of its ts and keeps its batch; clicks that share ts and click_id but
differ elsewhere are settled each. An empty table gives an empty result; further columns take part in the
comparison of rows alone, and may have any name.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..storage import _where
from .common import Workspace

BATCHES, COST, FULL, GRACE = 10, 300 * 1_000_000, 12, 6 * 3600 * 1_000_000
MOST = FULL * COST
#: One in so many click_ids, by checksum, comes a batch later.
DELAYED = 7
CLICKS_A_BUCKET = 20_000
#: Rows of a result handed on at once.
CHUNK = 50_000
_NEVER = -(2**63)
_WAITING = [("ts", np.int64), ("click", np.int64), ("client", np.int64), ("named", np.bool_)]
_CREDITS = [("client", np.int64), ("credit", np.int64), ("last", np.int64), ("since", np.int64)]
_OUT = "click_id long, outcome string, batch int, credit_after long, penalty_start_us long, penalty_end_us long"
_IN = "click_id long, client_id long, ts long, bucket int, batch int"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone; one without is taken as UTC."""
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    span = f"(`{name}` - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    minutes = f"((extract(DAY FROM {span}) * 24L + extract(HOUR FROM {span})) * 60 + extract(MINUTE FROM {span}))"
    return F.expr(f"{minutes} * 60000000 + cast(extract(SECOND FROM {span}) * 1000000 AS long)")


def _columns(fields) -> dict[str, np.ndarray]:
    return {name: np.empty(0, kind) for name, kind in fields}


def pack(waiting: dict[str, np.ndarray], credits: dict[str, np.ndarray]) -> bytes:
    """Both tables column by column; ``waiting`` is sorted by ts, which is stored by differences."""
    flat = [np.diff(waiting["ts"], prepend=np.int64(0)).tobytes(), *(waiting[n].tobytes() for n, _ in _WAITING[1:]), *(credits[n].tobytes() for n, _ in _CREDITS)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<qq", len(waiting["ts"]), len(credits["client"])) + b"".join(flat))


def unpack(packed: bytes | None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    if packed is None:
        return _columns(_WAITING), _columns(_CREDITS)
    raw = zstandard.ZstdDecompressor().decompress(packed)
    at, sizes, out = 16, struct.unpack_from("<qq", raw), []
    for fields, n in zip((_WAITING, _CREDITS), sizes):
        table = {}
        for name, kind in fields:
            table[name] = np.frombuffer(raw, kind, n, at)
            at += table[name].nbytes
        out.append(table)
    out[0]["ts"] = np.cumsum(out[0]["ts"])
    return out[0], out[1]


def _joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([a[n], b[n]]) for n in a}


def _where_true(table: dict[str, np.ndarray], mask: np.ndarray) -> dict[str, np.ndarray]:
    return {n: c[mask] for n, c in table.items()}


def settle(clicks: dict[str, np.ndarray], accounts: dict[int, tuple[int, int, int]]) -> tuple[np.ndarray, list, list, list, list]:
    """Walk ``clicks`` client by client; ``accounts`` (client: credit, last ts, start of penalty or _NEVER) is updated.

    Returns the order of settling and, in that order: admitted, credit after, penalty start and end.
    """
    order = np.lexsort((clicks["click"], clicks["named"], clicks["ts"], clicks["client"]))
    admitted, after, starts, ends = [], [], [], []
    client, credit, last, since = None, 0, 0, _NEVER
    for who, ts in zip(clicks["client"][order].tolist(), clicks["ts"][order].tolist()):
        if who != client:
            if client is not None:
                accounts[client] = credit, last, since
            client = who
            credit, last, since = accounts.get(who, (MOST, ts, _NEVER))
        credit = min(MOST, credit + ts - last)
        last = ts
        if credit >= COST:
            credit -= COST
            since = _NEVER
            admitted.append(True)
            starts.append(None)
            ends.append(None)
        else:
            if since == _NEVER:
                since = ts
            admitted.append(False)
            starts.append(since)
            ends.append(ts + COST - credit)
        after.append(credit)
    if client is not None:
        accounts[client] = credit, last, since
    return order, admitted, after, starts, ends


def _frame(clicks: dict[str, np.ndarray], outcome, batch: int, after, starts, ends) -> pd.DataFrame:
    long = lambda x: pd.array(x, dtype="Int64")
    ids = pd.arrays.IntegerArray(clicks["click"].copy(), ~clicks["named"])
    return pd.DataFrame({"click_id": ids, "outcome": outcome, "batch": np.full(len(ids), batch, np.int32), "credit_after": long(after), "penalty_start_us": long(starts), "penalty_end_us": long(ends)})


def bucket_step(key, frames, state, last_batch: int = BATCHES - 1):
    """One bucket and batch: late clicks out, those that W has passed settled, the rest packed into the state."""
    waiting, credits = unpack(state.get[0] if state.exists else None)
    own, horizon, batch = _columns(_WAITING), None, None
    for f in frames:
        tick = f["tick"].to_numpy(bool)
        if tick.any():
            horizon, batch = int(f["ts"].to_numpy()[tick][0]), int(f["batch"].to_numpy()[tick][0])
        f = f[~tick]
        own = _joined(own, {"ts": f["ts"].to_numpy(np.int64), "click": f["click"].to_numpy(np.int64), "client": f["client"].to_numpy(np.int64), "named": f["named"].to_numpy(bool)})
    if horizon is None:
        raise ValueError(f"bucket {key[0]} has clicks and no tick")
    late = own["ts"] < horizon
    behind = _where_true(own, late)
    for at in range(0, len(behind["ts"]), CHUNK):
        some = {n: c[at : at + CHUNK] for n, c in behind.items()}
        none = [None] * len(some["ts"])
        yield _frame(some, "late", batch, none, none, none)

    passed = waiting["ts"] < horizon
    ready = _where_true(waiting, passed)
    left = _joined(_where_true(waiting, ~passed), _where_true(own, ~late))
    if batch == last_batch:
        ready, left = _joined(ready, left), _columns(_WAITING)
    accounts = dict(zip(credits["client"].tolist(), zip(*(credits[n].tolist() for n in ("credit", "last", "since")))))
    order, admitted, after, starts, ends = settle(ready, accounts)
    # A client whose credit is full by W stands like a new one.
    kept = [(c, *a) for c, a in accounts.items() if a[0] + horizon - a[1] < MOST]
    table = np.array(kept, np.int64).reshape(-1, len(_CREDITS)).T
    state.update((pack({n: c[np.argsort(left["ts"], kind="stable")] for n, c in left.items()}, {n: table[i] for i, (n, _) in enumerate(_CREDITS)}),))
    for at in range(0, len(order), CHUNK):
        cut = slice(at, at + CHUNK)
        some = {n: c[order[cut]] for n, c in ready.items()}
        yield _frame(some, np.where(admitted[cut], "admitted", "throttled"), batch, after[cut], starts[cut], ends[cut])


def deal(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(click_id, client_id, ts, batch): distinct usable clicks by the hour of their arrival, ts in microseconds."""
    used = clicks.where("ts is not null and client_id is not null")
    hour = lambda us: (us - F.pmod(us, F.lit(3_600_000_000))) / 3_600_000_000
    lo, hi = used.select(hour(micros(used, "arrived_at")).cast("long").alias("h")).agg(F.min("h"), F.max("h")).first()
    used = used.distinct()
    rows = used.select(F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), micros(used, "ts").alias("ts"), hour(micros(used, "arrived_at")).cast("long").alias("h"))
    first = F.floor((F.col("h") - F.lit(lo)) * batches / F.lit(hi - lo + 1)) if lo is not None else F.lit(None)
    delayed = F.coalesce(F.crc32(F.col("click_id").cast("string")) % DELAYED == 0, F.lit(False)).cast("int")
    return rows.select("click_id", "client_id", "ts", F.least(F.coalesce(first, F.lit(batches - 1)) + delayed, F.lit(batches - 1)).cast("int").alias("batch"))


def start(spark: SparkSession, root: str, buckets: int, batches: int = BATCHES):
    """Start the query over what ``root``/source holds; it ends when all of it is settled and written."""
    rows = spark.readStream.schema(_IN).option("basePath", f"{root}/source").parquet(f"{root}/source")
    tick = F.col("bucket").isNotNull()
    own = F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int")
    rows = rows.select(F.coalesce("bucket", own).alias("bucket"), tick.alias("tick"), "ts", F.coalesce("click_id", F.lit(0)).alias("click"), F.col("click_id").isNotNull().alias("named"), F.coalesce("client_id", F.lit(0)).alias("client"), "batch")
    step = lambda key, frames, state: bucket_step(key, frames, state, batches - 1)
    out = rows.groupBy("bucket").applyInPandasWithState(step, _OUT, "packed binary", "append", "NoTimeout")
    return out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def feed(spark: SparkSession, root: str, buckets: int, batch: int, batches: int = BATCHES) -> None:
    """Publish a written batch, if it is not there yet, and settle what the stream has not seen."""
    source, fs = _where(spark, f"{root}/written/batch={batch}")
    target, _ = _where(spark, f"{root}/source/batch={batch}")
    if fs.exists(source):
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot publish batch {batch}")
    start(spark, root, buckets, batches).awaitTermination()


def throttle(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(click_id, outcome, batch, credit_after, penalty_start_us, penalty_end_us) of every distinct usable click."""
    spark = clicks.sparkSession
    root = Workspace(spark, "throttle").root
    deal(clicks, batches).write.partitionBy("batch").option("compression", "zstd").parquet(f"{root}/written")
    dealt = spark.read.schema("click_id long, client_id long, ts long, batch int").parquet(f"{root}/written")
    seen = {r["batch"]: r for r in dealt.groupBy("batch").agg(F.max("ts").alias("top"), F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(r["n"] for r in seen.values()) // CLICKS_A_BUCKET))
    top = None
    for batch in range(batches):
        horizon = _NEVER if top is None else top - GRACE
        ticks = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(horizon).cast("long").alias("ts"))
        ticks.write.mode("append").option("compression", "zstd").parquet(f"{root}/written/batch={batch}")
        feed(spark, root, buckets, batch, batches)
        if batch in seen:
            top = seen[batch]["top"] if top is None else max(top, seen[batch]["top"])
    return spark.read.schema(_OUT).parquet(f"{root}/out")


def op11_throttle(spark, sf_dir: str) -> DataFrame:
    return throttle(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
