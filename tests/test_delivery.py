"""Delivery to a server of this process: signatures, retries, rows left over, and jobs that fail."""

import hashlib
import hmac
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leakwise.sinks import delivery


@pytest.fixture
def server():
    """Accepts a row of an even number at once, of 1 mod 4 at the third try, of 3 mod 4 never."""
    tries, good, bad = Counter(), [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            told = json.loads(body)
            n = told["data"]["n"]
            tries[n] += 1
            if self.headers["X-Signature-256"] != "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest():
                bad.append(n)
            ok = n % 2 == 0 or n % 4 == 1 and tries[n] >= 3
            if ok:
                good.append((n, told["event"], told["id"]))
            self.send_response(204 if ok else 503)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", tries, good, bad
    s.shutdown()


def test_rows_are_signed_retried_and_kept_if_not_accepted(spark, server, tmp_path):
    url, tries, good, bad = server
    rows = spark.range(20).select(F.col("id").cast("int").alias("n"), F.lit("é").alias("name")).repartition(3)
    folder = str(tmp_path / "left")
    delivery.send(rows, url, "k", folder, event="scan", attempts=3, wait=0)
    assert not bad and {n for n, *_ in good} == {n for n in range(20) if n % 4 != 3} and {e for _, e, _ in good} == {"scan"}
    assert len({i for *_, i in good}) == 15 and all(tries[n] == (1 if n % 2 == 0 else 3) for n in range(20))
    left = delivery.undelivered_rows(spark, folder, "n int, name string")
    assert sorted((r.n, r.name) for r in left.collect()) == [(n, "é") for n in (3, 7, 11, 15, 19)]
    (log,) = Path(folder).glob("_delivery-*.json")
    assert {k: v for k, v in json.loads(log.read_text()).items() if k != "time"} == {"sent": 15, "failed": 5}
    assert not list(Path(folder).glob(".*-*.json"))


def test_an_endpoint_that_is_down_is_given_up(spark, server, tmp_path):
    url, tries, *_ = server
    rows = spark.range(50).select((F.col("id") * 4 + 3).alias("n")).coalesce(1)
    delivery.send(rows, url, "k", str(tmp_path / "left"), attempts=1, wait=0, give_up=5)
    assert sum(tries.values()) == 5 and delivery.undelivered_rows(spark, str(tmp_path / "left"), "n long").count() == 50


def test_a_job_that_fails_leaves_no_parts(spark, server, tmp_path):
    rows = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id") * 4 + 3).alias("n")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        delivery.send(rows, server[0], "k", str(tmp_path / "left"), attempts=1, wait=0)
    assert not [f for f in (tmp_path / "left").glob("*") if "part-" in f.name] and not list((tmp_path / "left").glob(".*-*.json"))
