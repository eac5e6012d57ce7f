"""The commits of checked-out repositories as a stream: each run sees what is newer than the last one saw."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

COMMIT = "repository string, branch string, hash string, time timestamp, author string, message string, is_head boolean"
_FIELD, _END = "\x1f", "\x1e"


def _git(folder: str, *words: str) -> str:
    return subprocess.run(["git", "-C", folder, *words], check=True, capture_output=True, text=True, errors="replace").stdout


def heads(folder: str) -> dict[str, str]:
    """The head commit of each branch."""
    rows = _git(folder, "for-each-ref", "--format=%(refname:short) %(objectname)", "refs/heads").split("\n")
    return dict(r.rsplit(" ", 1) for r in rows if r)


@dataclass
class Span(InputPartition):
    """The commits of a branch that ``until`` reaches and ``after`` doesn't (None: all)."""

    repository: str
    folder: str
    branch: str
    after: str | None
    until: str


def log(span: Span) -> Iterator[tuple]:
    words = [span.until]
    if span.after:
        known = subprocess.run(["git", "-C", span.folder, "cat-file", "-e", f"{span.after}^{{commit}}"], capture_output=True)
        words += [f"^{span.after}"] if known.returncode == 0 else []  # a commit that is gone hides nothing
    text = _git(span.folder, "log", f"--format=%H{_FIELD}%ct{_FIELD}%an{_FIELD}%B{_END}", *words, "--")
    for record in text.split(_END):
        if record.strip():
            name, seconds, author, message = record.lstrip("\n").split(_FIELD, 3)
            yield span.repository, span.branch, name, datetime.fromtimestamp(int(seconds), UTC), author, message.strip(), name == span.until


class CommitStream(DataSourceStreamReader):
    """An offset is the head of each branch of each repository; a batch has a partition for each branch that has moved."""

    def __init__(self, folders: dict[str, str]) -> None:
        self.folders = folders

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: heads(folder) for name, folder in sorted(self.folders.items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [
            Span(name, self.folders[name], branch, start.get(name, {}).get(branch), head)
            for name, of in end.items()
            if name in self.folders
            for branch, head in of.items()
            if start.get(name, {}).get(branch) != head
        ]

    def read(self, partition: Span) -> Iterator[tuple]:
        return log(partition)


class CommitTable(DataSourceReader):
    def __init__(self, folders: dict[str, str]) -> None:
        self.stream = CommitStream(folders)

    def partitions(self) -> list[InputPartition]:
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, partition: Span) -> Iterator[tuple]:
        return log(partition)


class CommitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return COMMIT

    def _folders(self) -> dict[str, str]:
        return json.loads(self.options["repositories"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return CommitTable(self._folders())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CommitStream(self._folders())


def commits(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All commits (``COMMIT``) of the branches of ``folders``, repository name -> checkout that driver and tasks share."""
    spark.dataSource.register(CommitLog)
    return spark.read.format("commit_log").option("repositories", json.dumps(folders)).load()


def commit_stream(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """The same as a stream. Run it on a schedule with ``availableNow`` and a checkpoint: a run gives the commits that came
    since the last one; new branches and repositories come whole, and a branch that was rewritten gives what is new on it."""
    spark.dataSource.register(CommitLog)
    return spark.readStream.format("commit_log").option("repositories", json.dumps(folders)).load()
