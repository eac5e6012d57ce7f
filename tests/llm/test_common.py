import os
from types import SimpleNamespace

import pytest

from leakwise.llm import common


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[4]", None)).startswith("/tmp/")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master, None))


def test_scopes_delete_what_was_written_within(spark):
    rows = spark.range(5)
    exists = lambda df: os.path.exists(df._leakwise_path)
    with common.scope() as outer:
        with common.scope() as inner:
            gone, kept = common.written(rows, "a"), common.written(rows, "b")
            inner.append(kept)
        assert not exists(gone) and exists(kept)
        last = common.written(rows, "c")
        outer.append(last)
    assert not exists(kept) and exists(last) and last.count() == 5
    common.forget(last)
    assert not exists(last)
