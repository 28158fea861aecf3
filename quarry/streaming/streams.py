"""Streams: event-time windows, ingestion of files, and stripping of reasoning from token streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


def _watched(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with a watermark on its time; a table as it is."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def tumbling(events: DataFrame, every: str, late: str = "10 minutes", at: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Counts and sums by window, on a table or a stream; late rows beyond the watermark are left out of a stream."""
    rows = _watched(events, at, late)
    grouped = rows.groupBy(F.window(at, every).alias("w"), *(by or []))
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), *(by or []), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    rows = _watched(events, at, late)
    return rows.groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, by: str, late: str = "10 minutes", at: str = "ts") -> DataFrame:
    rows = _watched(events, at, late)
    grouped = rows.groupBy(by, F.session_window(at, gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes", at: str = "ts") -> DataFrame:
    return _watched(events, at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def feed(held: str, inside: bool, delta: str) -> tuple[str, str, bool]:
    """What may be shown after a delta, what is held back, and whether a block is open.

    As much is held back as could be the beginning of a tag.
    """
    text, shown = held + delta, []
    while True:
        tag = CLOSE if inside else OPEN
        at = text.lower().find(tag)
        if at < 0:
            break
        if not inside:
            shown.append(text[:at])
        text, inside = text[at + len(tag) :], not inside
    keep = len(CLOSE if inside else OPEN) - 1
    if not inside and len(text) > keep:
        shown.append(text[:-keep])
    return "".join(shown), text[-keep:], inside


def flush(held: str, inside: bool) -> str:
    return "" if inside else held


#: Milliseconds without a delta until a ping, and pings until a stream counts as lost (a day).
IDLE_MS, MOST_PINGS = 10_000, 8640


def event_stream(deltas: DataFrame, idle_ms: int = IDLE_MS, most_pings: int = MOST_PINGS) -> DataFrame:
    """Token deltas (stream_id, seq, delta, last) -> events (stream_id, number, event, seq, text), with state by stream.

    A stream's events are numbered from 0: ``start``, then ``token`` with what may be shown
    of the deltas of a batch, ``ping`` after each idle time, ``done`` after the last delta.
    Whatever a stream was in the middle of, a half tag or a reasoning block, stays in its
    state over any number of pings; only after ``most_pings`` in a row what is held is shown
    and the stream is ``lost``. ``seq`` is that of the last delta so far. Null deltas are
    empty; a delta after the last one begins the stream anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = not state.exists
        held, inside, number, pings, seq = ("", False, 0, 0, -1) if fresh else state.get
        events: list[tuple[str, str]] = [("start", "")] if fresh else []
        if state.hasTimedOut:
            pings += 1
            over = pings >= most_pings
            events += [("token", flush(held, inside)), ("lost", "")] if over else [("ping", "")]
        else:
            rows, shown, over, pings = pd.concat(list(batches)).sort_values("seq"), [], False, 0
            for at, delta, last in zip(rows["seq"], rows["delta"], rows["last"]):
                text, held, inside = feed(held, inside, delta or "")
                shown.append(text)
                seq, over = int(at), over or bool(last)
            if over:
                shown.append(flush(held, inside))
            events += [("token", "".join(shown))] + ([("done", "")] if over else [])
        events = [e for e in events if e[0] != "token" or e[1]]
        if over:
            state.remove()
        else:
            state.update((held, inside, number + len(events), pings, seq))
            state.setTimeoutDuration(idle_ms)
        if events:
            n = len(events)
            yield pd.DataFrame({"stream_id": [key[0]] * n, "number": range(number, number + n), "event": [e for e, _ in events], "seq": [seq] * n, "text": [t for _, t in events]})

    return deltas.groupBy("stream_id").applyInPandasWithState(
        step, "stream_id string, number long, event string, seq int, text string", "held string, inside boolean, number long, pings int, seq int",
        "append", GroupStateTimeout.ProcessingTimeTimeout,
    )


def stripped_stream(deltas: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Token deltas (stream_id, seq, delta, last) without reasoning blocks: (stream_id, seq, text)."""
    return event_stream(deltas, idle_ms).where("event = 'token'").select("stream_id", "seq", "text")


def stripped_batch(deltas: DataFrame) -> DataFrame:
    """The same for finished streams: (stream_id, text)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "")
    text = deltas.groupBy("stream_id").agg(joined.alias("t"))
    closed = F.regexp_replace("t", r"(?is)<think>.*?</think>", "")
    return text.select("stream_id", F.regexp_replace(closed, r"(?is)<think>.*$", "").alias("text"))


def ingest(spark: SparkSession, folder: str, checkpoint: str, index: Callable[[DataFrame, int], None], every: str = "2 seconds", files_at_once: int = 100, once: bool = False) -> StreamingQuery:
    """Indexes new files of a folder; the checkpoint remembers which were taken."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    writer = found.withColumn("suffix", suffix).writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
