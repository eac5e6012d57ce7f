"""Files arrive as a stream; findings go to a table once each; progress and late suppression are rows as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leakwise.operators.exclusions import match_exceptions
from leakwise.operators.history import insert_new
from leakwise.plans.scan import ScanOptions, scan_files

#: Folders of a findings table, outermost first: what wrote it, its scan, its micro-batch.
LAYOUT = ("writer", "scan_id", "batch")


def write_findings(findings: DataFrame, path: str, checkpoint: str, interval: str | None = "250 milliseconds", exceptions=None, key: tuple[str, ...] = ("finding_id", "scan_id"), seen: str | None = None, horizon: str = "1 day") -> StreamingQuery:
    """Append each micro-batch's new findings to Parquet, keyed like insert-or-ignore, so replays add nothing.

    Keys that came within ``horizon`` are held in the state store (by the time of arrival, or the column ``seen``), so a
    micro-batch costs what it brings, however large the table is, and the state ends with the horizon: it has to cover the
    longest scan. A micro-batch has its own folder, which a replay after a failure overwrites. What other queries have
    written for the same scans (such as a run before its checkpoint was lost) is read and compared with; a query never reads
    what it wrote itself.

    ``exceptions`` is a function that reads the current exceptions; it is called for every micro-batch. With no
    ``interval`` the query takes what there is and stops.
    """
    at = seen or "_seen"
    timed = findings if seen else findings.withColumn(at, F.current_timestamp())
    fresh = timed.withWatermark(at, horizon).dropDuplicatesWithinWatermark(list(key))

    def step(batch: DataFrame, number: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = (batch if seen else batch.drop(at)).persist()  # the stateful plan runs once
        try:
            store_batch(rows, path, writer, number, key, exceptions)
        finally:
            rows.unpersist()

    writer = fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def store_batch(rows: DataFrame, path: str, writer: str, number: int, key: tuple[str, ...], exceptions=None) -> None:
    """Write one micro-batch to its folders; writing it again gives the same table."""
    scans = [r[0] for r in rows.select("scan_id").distinct().collect()]  # the scans that are running
    if not scans:
        return
    new = insert_new(stored_by_others(rows, path, writer, scans, key), rows, key)
    if exceptions is not None:
        new = match_exceptions(new, exceptions(), F.current_timestamp())
    named = new.withColumns({"writer": F.lit(writer), "batch": F.lit(number)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def stored_by_others(rows: DataFrame, path: str, writer: str, scans: list[str], key: tuple[str, ...]) -> DataFrame | None:
    """The keys that other writers have stored for these scans, in the types of ``rows``; None without any."""
    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    own = f"{LAYOUT[0]}={writer}"
    others = [x.getPath().getName() for x in fs.listStatus(top) if x.isDirectory() and x.getPath().getName().startswith("writer=") and x.getPath().getName() != own]
    held = [str(f) for o in others for s in scans if fs.exists(f := jvm.Path(top, f"{o}/scan_id={s}"))]
    if not held:
        return None
    return spark.read.option("basePath", path).schema(rows.select(*key).schema).parquet(*[f.rstrip("/") for f in held])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings that :func:`write_findings` has stored."""
    return spark.read.parquet(path).drop("writer", "batch")


def scan_stream(files: DataFrame, scan_id: str, options: ScanOptions | None = None) -> DataFrame:
    """The scan of streamed files: its plan is narrow, so it runs on a stream unchanged."""
    return scan_files(files, options).withColumn("scan_id", F.lit(scan_id))


def progress(events: DataFrame, every: str = "250 milliseconds") -> DataFrame:
    """Latest progress (scan_id, at, position, total, current_file) per scan and window; position never passes total."""
    seen = events.withColumn("position", F.least("position", "total"))
    last = F.max_by(F.struct("position", "total", "current_file"), F.struct("at", "position")).alias("last")
    return seen.groupBy("scan_id", F.window("at", every)).agg(last).select("scan_id", F.col("window.start").alias("since"), "last.*")


PROGRESS = "scan_id string, position long, total long, current_file string, final boolean"
_STATE = "position long, total long, current_file string, due long, closed boolean"
#: How long the end of a scan is remembered, in milliseconds, so that late events of it are dropped.
CLOSED_FOR = 3_600_000


def fold_progress(position: int, total: int, current: str, events: pd.DataFrame) -> tuple[int, int, str, bool]:
    """(position, total, current file, ended) after some events: ``done`` counts a file, ``total`` sets the number known so
    far, ``note`` sets all three, ``end`` ends the scan, and nothing counts after it."""
    for r in events.sort_values("ord", kind="stable").itertuples():
        if r.kind == "done":
            position, current = position + 1, r.current_file
        elif r.kind == "total":
            total = int(r.total)
        elif r.kind == "note":
            position, total, current = int(r.position), int(r.total), r.current_file
        elif r.kind == "end":
            return position, total, current, True
    return position, total, current, False


def progress_step(scan: str, frames: Iterator[pd.DataFrame], state: tuple, now: int, every: int) -> tuple[tuple | None, tuple]:
    """(row to send or None, next state) of a scan whose events came or whose timer ran out. ``due`` is when the running
    timer ends, 0 without one."""
    position, total, current, due, closed = state
    if closed:
        return None, state
    events = [f for f in frames if len(f)]
    ended = False
    if events:
        position, total, current, ended = fold_progress(position, total, current, pd.concat(events))
        due = due or now + every
    if ended:  # exact, and sent at once
        return (scan, position, position, current, True), (position, position, current, 0, True)
    if due and now >= due:
        return (scan, position, max(total, position), current, False), (position, total, current, 0, False)
    return None, (position, total, current, due, False)


def live_progress(events: DataFrame, every: int = 250) -> DataFrame:
    """A stream of ``events`` (scan_id, ord, kind, position, total, current_file) as a stream of ``PROGRESS`` rows.

    Each scan has a state and a timer: the first event after a row starts it, later ones don't put it off, and when it ends,
    after ``every`` milliseconds, the state as it is then is sent; so any number of events gives one row a period, the
    latest. A position never passes its total. An ``end`` event is sent at once and exactly (total = position), it is the
    scan's last row: a running timer ends with it, and later events are dropped. The order within a scan is that of
    ``ord`` in a micro-batch. Run it in update mode, with a trigger no longer than ``every``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        state, now = group.get if group.exists else (0, 0, "", 0, False), group.getCurrentProcessingTimeMs()
        if state[4] and group.hasTimedOut:
            group.remove()
            return
        row, state = progress_step(key[0], frames, tuple(state), now, every)
        group.update(state)
        if state[3] or state[4]:
            group.setTimeoutDuration(CLOSED_FOR if state[4] else max(1, state[3] - now))
        if row is not None:
            yield pd.DataFrame([row], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    return events.groupBy("scan_id").applyInPandasWithState(step, PROGRESS, _STATE, "update", "ProcessingTimeTimeout")


def finding_rates(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """An extension: counts per event-time window and kind, with late rows dropped after ``lateness``."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("since"), kind, "n")


def publish(findings: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Findings as an in-memory table that subscribers read."""
    return findings.writeStream.format("memory").queryName(name).outputMode(mode).start()
