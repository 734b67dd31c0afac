"""Session event streams: expiry, idempotent replay, version chains, deletion, progress.

Expiry and replay take a key's events in the order of (event time, event id), however
they fall into micro-batches: events wait in state until the watermark has passed them,
and a timer lets them go (`in_order`), for a bucket of keys at a time. Nothing that comes later than the watermark is
taken, so any deal of the same events gives the same outcomes. State is bounded in time:
events wait for the lateness allowed, an idempotency key is kept for the time to live
(24 hours), a session leaves a tombstone of one number for `retain` hours after its end,
so that what comes later is still told as expired, and a version chain is forgotten when
nothing has been written to it for the time to live. Versions are judged in order of
arrival, as writes to a store are. A live stream tells outcomes once the watermark is
past; `run_to_end` closes a finite one, for backfills and tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

TTL_HOURS = 24
RETAIN_HOURS = 24 * 90
HOUR = 3_600_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The end of time for a finite stream, past all its events.
CLOSING = "2261-01-01 00:00:00"


def read_stream(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """A parquet path, file or folder, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{path}*")


def run_available(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Everything the stream has now, written to a folder all executors share, and read back."""
    schema, provider = stream.schema, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, STORE)  # timers and list state need it
    try:
        q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def run_to_end(stream: DataFrame, build: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str, ts: str = "ts") -> DataFrame:
    """build(stream) over a finite stream, told to its end.

    A second source is empty while the stream's events are read; then it brings one row
    without a key at the end of time, and the same query, from its checkpoint, lets go
    of all that waits.
    """
    closing, schema = f"{folder}/closing", stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{closing}/0")
    joined = build(stream.unionByName(read_stream(spark, f"{closing}/", schema)))
    run_available(joined, spark, folder)
    end = [F.to_timestamp(F.lit(CLOSING)).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*end).write.parquet(f"{closing}/1")
    return run_available(joined, spark, folder)


#: Keys share as many groups of state: what is paid for each group a batch does not grow with the number of keys.
BUCKETS = 1024


def _whole(v: pd.Series) -> list:
    """Values of a column as Python's own, null as None."""
    return v.astype(object).where(v.notna(), None).tolist()


def _ordered(rows: list[tuple]) -> list[tuple]:
    """Rows sorted, null last."""
    try:
        return sorted(rows)
    except TypeError:
        return sorted(rows, key=lambda r: [(v is None, v) for v in r])


class _InOrder(StatefulProcessor):
    """Holds the events of a bucket of keys until the watermark has passed them, then steps through each key's in order.

    Waiting events and states of a bucket are read and written as one list each.
    """

    def __init__(self, waiting: str, state: str, columns: list[str], step: Callable, frame: Callable):
        self.schemas, self.columns, self.step, self.frame = (waiting, state), columns, step, frame

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.own = handle.getListState("own", self.schemas[1])
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake(self, at: int) -> None:
        """Sees to it that a timer goes off when the watermark is past `at`, in microseconds."""
        at = at // 1000 + 1
        set_for = self.alarm.get()[0] if self.alarm.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            if key[0] < 0:  # rows without a key
                continue
            us, k, ids, *carried = (_whole(b[c]) for c in self.columns)
            self.waiting.appendList(list(zip(us, k, [None if i is None else int(i) for i in ids], *carried, strict=True)))
            first = min([*us, *([] if first is None else [first])])
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest, out = {}, [], []
        for r in self.waiting.get():
            due.setdefault(r[1], []).append((r[0], *r[2:])) if r[0] <= now else rest.append(tuple(r))
        own = {r[0]: (r[1], tuple(r[2:])) for r in self.own.get()}
        called = [k for k, (again, _) in own.items() if again is not None and again <= now and k not in due]
        for k in [*due, *called]:
            rows, state, again = self.step(k, own[k][1] if k in own else None, _ordered(due.get(k, [])), now)
            out += rows
            own.pop(k, None)
            if state is not None:
                own[k] = (again, state)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if due or called:
            self.own.put([(k, again, *state) for k, (again, state) in own.items()]) if own else self.own.clear()
        times = [r[0] for r in rest] + [again for again, _ in own.values() if again is not None]
        if times:
            self._wake(min(times))
        if out:
            yield self.frame(out)


def in_order(events: DataFrame, key: str, ts: str, event_id: str, carried: dict[str, str], state: str, step: Callable, frame: Callable, schema: str, late: int, buckets: int = BUCKETS) -> DataFrame:
    """Steps through each key's events in order of (ts, event_id).

    step(key, state or None, due, now) -> (rows, state or None, when to be called again or
    None); due are tuples (microseconds, event id, carried...), now is the watermark;
    frame makes a data frame of rows. Rows without a key are not stepped through. State is
    kept where rows are `late` hours behind; keys share it in `buckets` groups by hash.
    """
    k, stamp = F.col(key), F.col(ts).cast("timestamp").alias("stamp")
    bucket = F.when(k.isNull(), -1).otherwise(F.pmod(F.xxhash64(k), F.lit(buckets))).cast("int").alias("bucket")
    # ids travel as text: a column of numbers with nulls would become one of floats
    rows = events.select(bucket, k.alias("k"), stamp, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).cast("long").cast("string").alias("id"), *[F.col(c).alias(f"own_{c}") for c in carried])
    columns = ["us", "k", "id", *[f"own_{c}" for c in carried]]
    kind = dict(events.dtypes)[key]
    waiting = f"us long, k {kind}, id long" + "".join(f", {c} {t}" for c, t in carried.items())
    processor = _InOrder(waiting, f"k {kind}, again long, {state}", columns, step, frame)
    return rows.withWatermark("stamp", f"{late} hours").groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _hours(stamp: pd.Timestamp, hours: int) -> pd.Timestamp:
    return stamp + pd.Timedelta(hours=hours)


def _millis(stamp: pd.Timestamp, state: GroupState) -> int:
    """A timeout at this time, or as soon as can be."""
    return max(int(stamp.value // 1_000_000), state.getCurrentWatermarkMs() + 1)


def expire(events: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id", hours: int = TTL_HOURS, retain: int = RETAIN_HOURS, late: int = TTL_HOURS) -> DataFrame:
    """(key, event_id, ts, outcome): live until `hours` after a session's first event, expired from then on; a session that ends leaves a row without an event id. `retain` hours after its end a key starts anew."""
    def step(k, own, due, now):
        end, over = own if own else (None, False)
        out = []
        over_row = lambda: out.append((k, None, end, "session_expired"))
        for us, e in due:
            if end is not None and us >= end and not over:
                over = True
                over_row()
            if end is None or us >= end + retain * HOUR:
                end, over = us + hours * HOUR, False
            out.append((k, e, us, "live" if us < end else "expired"))
        if end is not None and now >= end and not over:
            over = True
            over_row()
        if end is not None and now >= end + retain * HOUR:
            end = None
        return out, None if end is None else (end, over), None if end is None else end + (retain * HOUR if over else 0)

    def frame(out):
        k, ids, us, outcome = zip(*out, strict=True)
        return pd.DataFrame({"k": k, event_id: pd.array(ids, dtype="Int64"), ts: pd.to_datetime(pd.Series(us), unit="us", utc=True), "outcome": outcome})

    kind = dict(events.dtypes)[key]
    found = in_order(events, key, ts, event_id, {}, "ends long, over boolean", step, frame, f"k {kind}, {event_id} long, {ts} timestamp, outcome string", late)
    return found.withColumnRenamed("k", key)


def replay(events: DataFrame, key: str, fingerprint: str, ts: str = "ts", event_id: str = "event_id", hours: int = TTL_HOURS, late: int = TTL_HOURS) -> DataFrame:
    """(key, event_id, outcome): first, replay of the same request, or conflict with another one under the same key; a key lives for `hours` from its first use, then it may be used anew."""
    def step(k, own, due, now):
        first, end = own if own else (None, None)
        out = []
        for us, e, f in due:
            if end is None or us >= end:
                first, end = f, us + hours * HOUR
                out.append((k, e, "first"))
            else:
                out.append((k, e, "replay" if f == first else "conflict"))
        if end is not None and now >= end:
            end = None
        return out, None if end is None else (first, end), end

    def frame(out):
        k, ids, outcome = zip(*out, strict=True)
        return pd.DataFrame({"k": k, event_id: pd.array(ids, dtype="Int64"), "outcome": outcome})

    rows = events.withColumn(fingerprint, F.coalesce(F.col(fingerprint).cast("string"), F.lit("")))
    found = in_order(rows, key, ts, event_id, {fingerprint: "string"}, "f string, ends long", step, frame, f"k {dict(events.dtypes)[key]}, {event_id} long, outcome string", late)
    return found.withColumnRenamed("k", key)


def distinct_requests(events: DataFrame, keys: list[str], ts: str = "ts", hours: int = TTL_HOURS) -> DataFrame:
    """The first event of each key, repeats within the time to live left out."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(keys)


def versions(events: DataFrame, key: str, version: str, parent: str, ts: str | None = None, hours: int = TTL_HOURS, tag: str | None = None, match: str | None = None) -> DataFrame:
    """(key, version, outcome): accepted if the parent is the latest accepted version, conflict otherwise.

    With `tag` (the tag of the content written) and `match` (the tag the writer has seen
    last, null where it names none), a write whose parent is right is accepted only if it
    has seen the latest accepted content too; tag_conflict otherwise. An empty chain has
    no tag, which '' or '"0"' match. A chain without a write for `hours` (of arrival, unless
    `ts` is given) is forgotten.
    """
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("v")
        last, seen = state.get if state.exists else (-1, "")
        out = []
        for v, p, own, m in zip(rows["v"], rows["p"], rows["tag"], rows["match"], strict=True):
            outcome = "conflict" if p != last else "accepted" if m is None or m != m or m == seen or (last == -1 and m == '"0"') else "tag_conflict"
            out.append((k[0], v, outcome))
            if outcome == "accepted":
                last, seen = v, own or ""
        state.update((int(last), seen))
        state.setTimeoutTimestamp(_millis(_hours(rows["at"].max(), hours), state))
        yield pd.DataFrame(out, columns=["k", "v", "outcome"])

    text = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
    rows = events.select(F.col(key).alias("k"), F.col(version).cast("long").alias("v"), F.col(parent).cast("long").alias("p"), text(tag).alias("tag"), text(match).alias("match"), (F.current_timestamp() if ts is None else F.col(ts).cast("timestamp")).alias("at"))
    rows = rows.withWatermark("at", f"{hours} hours")
    found = rows.groupBy("k").applyInPandasWithState(run, f"k {dict(events.dtypes)[key]}, v long, outcome string", "last long, seen string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnsRenamed({"k": key, "v": version})


def tombstone(key: str):
    """The hash that stays of a deleted session."""
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit("deleted")).cast("binary"), 256)


def deletions_live(events: DataFrame, deletions: DataFrame, key: str, ts: str = "ts", event_id: str = "event_id", retain: int = RETAIN_HOURS, late: int = TTL_HOURS) -> DataFrame:
    """(key, event_id, outcome) of two streams: kept, rejected after the deletion of its session, and one tombstone row a deletion; events from before it that come after it are left out."""
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        gone = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values([ts, "ends", event_id])
        for t, ends, e in zip(rows[ts], rows["ends"], rows[event_id], strict=True):
            if ends and gone is None:
                gone = t
                out.append((k[0], pd.NA, "tombstone"))
            elif not ends and gone is None:
                out.append((k[0], e, "kept"))
            elif not ends and t > gone:
                out.append((k[0], e, "rejected"))
        if gone is not None:
            state.update((int(gone.value // 1000),))
            state.setTimeoutTimestamp(_millis(_hours(gone, retain), state))
        yield pd.DataFrame(out, columns=[key, event_id, "outcome"]).astype({event_id: "Int64"})

    stamp = F.col(ts).cast("timestamp").alias(ts)
    own = events.select(key, event_id, stamp, F.lit(False).alias("ends"))
    ends = deletions.select(key, F.lit(None).cast("long").alias(event_id), stamp, F.lit(True).alias("ends"))
    rows = own.unionByName(ends).withWatermark(ts, f"{late} hours")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {dict(events.dtypes)[key]}, {event_id} long, outcome string", "gone long", "append", GroupStateTimeout.EventTimeTimeout)


def purge(outcomes: DataFrame, key: str) -> DataFrame:
    """What is stored after deletion: kept rows of deleted sessions go, their tombstones get a hash."""
    gone = outcomes.filter("outcome = 'tombstone'").select(key)
    kept = outcomes.filter("outcome = 'kept'").join(gone, key, "left_anti")
    return kept.unionByName(outcomes.filter("outcome <> 'kept'")).withColumn("hash", F.when(F.col("outcome") == "tombstone", tombstone(key)))


def progress(events: DataFrame, status: str) -> DataFrame:
    """Counts so far by status, for update or complete mode."""
    return events.groupBy(status).agg(F.count("*").alias("n"))
