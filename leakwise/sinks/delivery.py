"""Signed delivery of rows to a webhook, as a writer of Spark's data source API."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from leakwise.sinks.reports import deliver


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.sub("^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def http_post(url: str, timeout: float):
    def post(body: bytes, headers: dict[str, str]) -> int:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as e:
            return e.code

    return post


@dataclass
class Delivered(WriterCommitMessage):
    """What a task sent, and where it put what it couldn't send."""

    sent: int
    failed: int
    part: str


class WebhookWriter(DataSourceWriter):
    """A task posts its rows, each tried several times, and writes those that weren't accepted, as they come, to a part of
    its own. After ``give_up`` failures in a row the endpoint counts as down and the rest of the task is written only. The
    parts get their names when all tasks have ended well; those of a job that fails are deleted."""

    def __init__(self, options: dict[str, str]) -> None:
        self.o = options
        self.job = uuid.uuid4().hex
        self.sent_at = datetime.now(UTC).isoformat(timespec="seconds")

    def _body(self, row: Row) -> bytes:
        data = json.loads(json.dumps(row.asDict(recursive=True), default=str, sort_keys=True))
        name = hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()
        return json.dumps({"event": self.o.get("event", "findings"), "id": name, "timestamp": self.sent_at, "data": data}).encode()

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = _store(self.o["undelivered"])
        task = TaskContext.get()
        part = f"{folder}/.{self.job}-{task.partitionId()}-{task.taskAttemptId()}.json"
        post = http_post(self.o["url"], float(self.o.get("timeout", 10)))
        attempts, wait, give_up = int(self.o.get("attempts", 5)), float(self.o.get("wait", 2)), int(self.o.get("give_up", 20))
        sent = failed = in_a_row = 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(part) as out:
            for row in iterator:
                body = self._body(row)
                if in_a_row < give_up and deliver(body, self.o.get("secret", ""), post, attempts, wait) > 0:
                    sent, in_a_row = sent + 1, 0
                else:
                    failed, in_a_row = failed + 1, in_a_row + 1
                    out.write(body + b"\n")
        return Delivered(sent, failed, part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.o["undelivered"])
        done = [m for m in messages if m is not None]
        for m in done:
            if m.failed:
                store.move(m.part, f"{folder}/part-{m.part.rsplit('/.', 1)[1]}")
            else:
                store.delete_file(m.part)
        with store.open_output_stream(f"{folder}/_delivery-{self.job}.json") as out:
            out.write(json.dumps({"time": self.sent_at, "sent": sum(m.sent for m in done), "failed": sum(m.failed for m in done)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.o["undelivered"])
        if store.get_file_info(folder).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.base_name.startswith(f".{self.job}-"):
                    store.delete_file(f.path)


class WebhookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webhook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WebhookWriter(dict(self.options))


def send(rows: DataFrame, url: str, secret: str, undelivered: str, event: str = "findings", **more: object) -> None:
    """Post each row as signed JSON (event, id, timestamp, data) from the tasks that hold it; what isn't accepted is in
    ``undelivered`` as lines of JSON. A task that is repeated sends its rows again, under the same ids. ``more``: attempts,
    wait (seconds, doubling), timeout, give_up."""
    rows.sparkSession.dataSource.register(WebhookSink)
    options = {"url": url, "secret": secret, "undelivered": undelivered, "event": event, **{k: str(v) for k, v in more.items()}}
    rows.write.format("webhook").options(**options).mode("append").save()


def undelivered_rows(spark, folder: str, schema: str) -> DataFrame:
    """The rows that are still to be sent, in the shape of ``schema``."""
    shape = f"event string, id string, timestamp string, data struct<{schema}>"
    return spark.read.schema(shape).option("pathGlobFilter", "part-*").json(folder).select("data.*")
