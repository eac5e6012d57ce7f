"""Commits as a stream over real repositories."""

import shutil
import subprocess

import pytest

from leakwise.operators.history import commits_since
from leakwise.sources import commits as c

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="needs git")


def git(folder, *words):
    who = ["-c", "user.name=A B", "-c", "user.email=a@b", "-c", "commit.gpgsign=false"]
    subprocess.run(["git", "-C", str(folder), *who, *words], check=True, capture_output=True)


def commit(folder, message):
    git(folder, "commit", "--allow-empty", "-m", message)


@pytest.fixture
def repository(tmp_path):
    folder = tmp_path / "repo"
    folder.mkdir()
    git(folder, "init", "-b", "main")
    commit(folder, "one\n\nwith a body")
    commit(folder, "two é")
    return folder


def test_a_restart_sees_only_newer_commits(spark, repository, tmp_path):
    seen = []

    def run(folders):
        seen.clear()
        stream = c.commit_stream(spark, folders)
        q = stream.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.repository, r.branch, r.message, r.is_head) for r in seen)

    folders = {"r": str(repository)}
    assert run(folders) == [("r", "main", "one\n\nwith a body", False), ("r", "main", "two é", True)]
    assert run(folders) == []
    commit(repository, "three")
    git(repository, "checkout", "-b", "side")
    commit(repository, "four")
    assert run(folders) == [("r", "main", "three", True), ("r", "side", "four", True), ("r", "side", "one\n\nwith a body", False), ("r", "side", "three", False), ("r", "side", "two é", False)]
    git(repository, "reset", "--hard", "HEAD~2")  # rewritten: what is new on the branch comes
    commit(repository, "five")
    other = tmp_path / "other"
    other.mkdir()
    git(other, "init", "-b", "main")
    commit(other, "first")
    assert run(folders | {"o": str(other)}) == [("o", "main", "first", True), ("r", "side", "five", True)]


def test_the_table_and_a_commit_that_is_gone(spark, repository):
    table = c.commits(spark, {"r": str(repository)})
    assert table.schema.simpleString().startswith("struct<repository:string") and {r.author for r in table.collect()} == {"A B"}
    last = table.where("not is_head").select("repository", "branch", "time")
    assert commits_since(table, last).count() <= 1
    head = c.heads(str(repository))["main"]
    assert len(list(c.log(c.Span("r", str(repository), "main", "0" * 40, head)))) == 2
