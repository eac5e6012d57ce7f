"""The findings table under restarts and replays, and progress by timers."""

import json
import time
from pathlib import Path

import pandas as pd
import pytest

from leakwise.schema import EXCEPTION
from leakwise.streaming import scan as stream

SHAPE = "finding_id string, scan_id string, headline string, location string, start_line long, sha256 string, source string, seen timestamp"


def put(folder, name, rows):
    Path(folder).mkdir(exist_ok=True)
    lines = [json.dumps({"finding_id": f, "scan_id": s, "headline": "h", "location": "/l", "start_line": 1, "sha256": f, "source": "x", "seen": t}) for f, s, t in rows]
    hidden = Path(folder) / f".{name}"
    hidden.write_text("\n".join(lines))
    hidden.rename(Path(folder) / name)


def run(spark, folder, out, checkpoint, **more):
    rows = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).json(str(folder))
    q = stream.write_findings(rows, str(out), str(checkpoint), interval=None, **more)
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def stored(spark, out):
    return sorted((r.finding_id, r.scan_id) for r in stream.read_findings(spark, str(out)).collect())


def exception(spark, checksum):
    return lambda: spark.createDataFrame([("x", 1, "*", "active", None, "globalHash", None, None, None, checksum, None, None)], EXCEPTION)


T = "2024-01-01T00:00:00"


@pytest.mark.parametrize("checksum", ["none", "f1"])
def test_two_scans_in_one_batch_keep_all_rows(spark, tmp_path, checksum):
    put(tmp_path / "in", "a.json", [("f1", "s1", T), ("f1", "s2", T), ("f2", "s1", T), ("f1", "s1", T)])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", exceptions=exception(spark, checksum))
    assert stored(spark, tmp_path / "out") == [("f1", "s1"), ("f1", "s2"), ("f2", "s1")]
    hidden = stream.read_findings(spark, str(tmp_path / "out")).where("suppressed").count()
    assert hidden == (2 if checksum == "f1" else 0)


def test_restarts_know_the_keys_without_reading_the_table(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("f1", "s1", T), ("f2", "s1", T)])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    (tmp_path / "out").rename(tmp_path / "elsewhere")
    put(tmp_path / "in", "b.json", [("f1", "s1", T), ("f3", "s1", T)])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    assert stored(spark, tmp_path / "out") == [("f3", "s1")]


def test_a_new_checkpoint_adds_nothing_over_many_batches(spark, tmp_path):
    for i in range(4):
        put(tmp_path / "in", f"{i}.json", [(f"f{i}", "s1", T), (f"g{i}", "s2", T), ("f0", "s1", T)])
    for cp in ("a", "b"):
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / cp)
    assert stored(spark, tmp_path / "out") == sorted([(f"f{i}", "s1") for i in range(4)] + [(f"g{i}", "s2") for i in range(4)])


def test_a_replayed_batch_overwrites_its_own_rows(spark, tmp_path):
    shape = "finding_id string, scan_id string, v int"
    key = ("finding_id", "scan_id")
    one, two = (spark.createDataFrame([(f, "s1", v) for f in names], shape) for names, v in (("ab", 1), ("cd", 2)))
    for number, rows in ((0, one), (1, two), (1, two), (0, one)):
        stream.store_batch(rows, str(tmp_path / "out"), "w", number, key)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.finding_id, r.batch) for r in got.collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]


def test_the_state_ends_with_the_horizon(spark, tmp_path):
    for i in range(6):
        put(tmp_path / "in", f"{i}.json", [(f"f{i}.{j}", "s1", f"2024-01-01T{i:02d}:00:00") for j in range(50)])
    q = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", seen="seen", horizon="1 hour")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 150 and len(stored(spark, tmp_path / "out")) == 300


def test_batches_do_not_read_the_table(spark, tmp_path):
    out = tmp_path / "out"
    key = ("finding_id", "scan_id")
    rows = spark.createDataFrame([("f", "s1")], "finding_id string, scan_id string")
    stream.store_batch(rows, str(out), "w", 0, key)
    assert stream.stored_by_others(rows, str(out), "w", ["s1"], key) is None
    assert stream.stored_by_others(rows, str(out), "v", ["s2"], key) is None
    assert stream.stored_by_others(rows, str(out), "v", ["s1"], key).count() == 1


def events(*rows):
    return pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["ord", "kind", "position", "total", "current_file"])


def test_latest_of_a_period_and_an_exact_end():
    state = (0, 0, "", 0, False)
    row, state = stream.progress_step("s", [events(("total", 0, 9, None), ("done", 0, 0, "a"))], state, 1000, 250)
    assert row is None and state == (1, 9, "a", 1250, False)
    row, state = stream.progress_step("s", [events(("done", 0, 0, "b"))], state, 1200, 250)  # doesn't put the timer off
    assert row is None and state[3] == 1250
    row, state = stream.progress_step("s", [], state, 1250, 250)
    assert row == ("s", 2, 9, "b", False) and state[3] == 0
    row, state = stream.progress_step("s", [events(("total", 0, 1, None))], state, 1300, 250)
    row, state = stream.progress_step("s", [events(("done", 0, 0, "c"))], state, 1600, 250)  # late: data and timer at once
    assert row == ("s", 3, 3, "c", False)
    row, state = stream.progress_step("s", [events(("done", 0, 0, "d"), ("end", 0, 0, None), ("done", 0, 0, "e"))], state, 1610, 250)
    assert row == ("s", 4, 4, "d", True) and state[3:] == (0, True)
    assert stream.progress_step("s", [events(("done", 0, 0, "f"))], state, 1700, 250) == (None, state)


def test_live_progress_by_timers(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()

    def send(name, rows):
        hidden = folder / f".{name}"
        hidden.write_text("\n".join(json.dumps({"scan_id": s, "ord": o, "kind": k, "position": 0, "total": t, "current_file": f}) for s, o, k, t, f in rows))
        hidden.rename(folder / f"{name}.json")

    shape = "scan_id string, ord long, kind string, position long, total long, current_file string"
    rows = stream.live_progress(spark.readStream.schema(shape).json(str(folder)), every=250)
    seen = []
    q = rows.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        send("1", [("s1", 0, "total", 100, None), *[("s1", i, "done", 0, f"f{i}") for i in range(1, 60)], ("s2", 0, "total", 5, None)])
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:  # the timer sends them, no further event comes
            time.sleep(0.1)
        send("2", [*[("s1", i, "done", 0, f"f{i}") for i in range(60, 101)], ("s1", 101, "end", 0, None)])
        while not any(r[4] for r in seen) and time.time() < until:
            time.sleep(0.1)
    finally:
        q.stop()
    assert ("s1", 59, 100, "f59", False) in seen and ("s2", 0, 5, "", False) in seen
    assert [r for r in seen if r[0] == "s1"][-1] == ("s1", 100, 100, "f100", True)
    assert len([r for r in seen if r[0] == "s1"]) <= 3
