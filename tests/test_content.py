"""The two phases of a path scan: what is opened, how often, and files in pieces."""

import hashlib
import io
import random
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakwise.plans import scan as plan
from leakwise.sources import content as c
from leakwise.sources import files as sf

GH = "ghp_" + "Ab1" * 12


def secret(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def big_text(lines, seed=1):
    """Lines with and without findings, in several scripts, some secrets more than once."""
    rng = random.Random(seed)
    out = []
    for i in range(lines):
        out.append(rng.choice(["// é 中 😀 plain", "", f'String apiKey = "{secret(i)}";', f'  String x = "{GH}";', f'String token = "{secret(i % 7)}";', "x" * 90]))
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "root"
    for name, body in {
        "src/A.java": f'String apiKey = "{secret(1)}";\n', "src/with space.java": f'String apiKey = "{secret(2)}";\n', "movie.mkv": "x" * 5000, "LICENSE": "Plain words. " * 60 + f'\nkey = "{secret(3)}"\n',
        "core": "\x00\x01" * 400, "short": "tiny", "node_modules/B.java": f'String apiKey = "{secret(4)}";\n', "certs/k.pem": "-----BEGIN RSA PRIVATE KEY-----\nx\n",
        "store.p12": "p" * 3000, "big.json": "\n".join(f'{{"authKey": "{secret(i)}"}}' for i in range(100)), "large.txt": "word " * 10,
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def recording(log):
    def opener(uri):
        with open(log, "a") as f:
            f.write(uri.rsplit("/", 1)[-1] + "\n")
        return c.open_uri(uri)

    return opener


def test_only_wanted_files_are_opened_and_once(spark, corpus, tmp_path):
    log = tmp_path / "opened"
    found = plan.scan_paths(spark, [str(corpus)], plan.ScanOptions(prune=("node_modules",)), opener=recording(log)).collect()
    opened = sorted(log.read_text().split("\n")[:-1])
    # the files without extension show their first bytes; only the one that is text is fetched after that
    assert opened == sorted(["A.java", "with space.java", "LICENSE", "LICENSE", "core", "short", "k.pem", "store.p12", "big.json", "large.txt"])
    assert {Path(r.location).name for r in found} == {"A.java", "with space.java", "LICENSE", "k.pem", "store.p12", "big.json"}
    (p12,) = [r for r in found if r.location.endswith(".p12")]
    assert p12.sha256 == hashlib.sha256(b"p" * 3000).hexdigest() and p12.confidence == 4


def test_files_beyond_the_reader_s_limit_do_not_stop_a_scan(spark, corpus):
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        names = {Path(r.location).name for r in plan.scan_paths(spark, [str(corpus)]).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert {"A.java", "big.json", "store.p12"} <= names


def test_the_listing_reads_no_content(spark, corpus):
    listed = sf.list_roots(spark, [str(corpus), str(corpus / "src"), str(corpus)])
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert {(r.repo_index, r.size) for r in listed.where(F.col("path").endswith("A.java")).collect()} == {(0, 52), (1, 52)}


def test_both_readers_give_the_same(spark, corpus):
    whole = plan.scan_files(sf.with_text(sf.read_roots(spark, [str(corpus)])))
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(plan.scan_paths(spark, [str(corpus)])) == key(whole)


@given(st.binary(max_size=200).map(lambda b: b.replace(b"\x07", b"\n").replace(b"\x08", b"\n")) | st.text(alphabet="a\né中😀", max_size=80).map(str.encode), st.integers(1, 60), st.integers(1, 80))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_a_file(body, length, carry):
    file = pa.PythonFile(io.BytesIO(body), mode="r")
    last = max(0, -(-len(body) // length) - 1)
    ranges = [c.piece_range(file, k, len(body), length, carry) for k in range(last + 1)]
    assert ranges[0][0] == 0 and ranges[-1][1] == len(body)
    assert all(a[1] == b[0] and b[0] <= b[1] for a, b in zip(ranges, ranges[1:], strict=False))
    if carry >= length >= 4 and b"\n" in body:
        assert all(body[s - 1 : s] == b"\n" or b"\n" not in body[s - 1 : s + length - 4] for s, _ in ranges if 0 < s < len(body))
    try:
        body.decode()
    except UnicodeDecodeError:
        return
    if length >= 4:
        for s, e in ranges:
            body[s:e].decode()


@pytest.mark.parametrize("length", [150, 997, 6000])
def test_findings_of_pieces_equal_those_of_the_whole(spark, tmp_path, length):
    root = tmp_path / "root"
    root.mkdir()
    for i in range(3):
        (root / f"{i}.java").write_text(big_text(150, seed=i))
    (root / "small.java").write_text(big_text(1, seed=2))
    got = plan.scan_paths(spark, [str(root)], piece=length)
    want = plan.scan_paths(spark, [str(root)])
    rows = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert rows(got) == rows(want) and want.count() > 50


def test_long_lines_are_cut_and_counted(spark, tmp_path):
    body = "a" * 100 + "\n" + "é" * 300 + f' apiKey = "{secret(5)}"; ' + "b" * 300 + "\nlast\n"
    (tmp_path / "one.java").write_text(body)
    files = sf.list_roots(spark, [str(tmp_path)])
    bases = c.line_bases(c.in_pieces(files, 64), 64)
    (row,) = c.cuts(bases).collect()
    assert row.pieces == -(-len(body.encode()) // 64) and row.cuts >= 10
    got = plan.scan_paths(spark, [str(tmp_path)], piece=720).collect()
    raw = body.encode()
    assert len(got) == 1 and raw[got[0].raw_start : got[0].raw_end].decode() == f'apiKey = "{secret(5)}"'
    assert (got[0].start_line, got[0].start_char) == (1, raw.index(b"apiKey") - 101)
