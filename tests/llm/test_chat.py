import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakwise.llm.chat import ChatTemplate, format_chats, read_back, unescaped

SHAPE = "conv_id long, turn long, role string, text string, formatted string, segments long, valid long"
T = ChatTemplate()
#: One string of many awkward texts, so that one Spark job covers them.
AWKWARD = st.lists(st.sampled_from([*T.controls, "\\", "<", "[", "|", "INST]", "é", "中", "\n", "a", "/s>", "$1", ">"]), max_size=12).map("".join)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, 2) for r in rows], SHAPE)


@settings(max_examples=8, deadline=None)
@given(st.lists(AWKWARD, min_size=1, max_size=30))
def test_round_trip(spark, texts):
    rows = [(i % 3, i, "assistant" if i % 2 else T.controls[i % 9], x) for i, x in enumerate(texts)]
    got = format_chats(frame(spark, rows)).select("conv_id", "formatted", "segments", read_back("formatted").alias("turns")).collect()
    want = defaultdict(list)
    for c, _, role, x in rows:
        want[c].append((role, x))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        assert "".join(s.text for s in r.segments) == r.formatted
        bare = r.formatted
        for _ in want[r.conv_id]:  # only the template's own control strings are left
            for mark in (T.start, T.text_mark, T.end):
                bare = bare.replace(mark, "", 1)
        assert not any(c in bare for c in T.controls)


def test_machine_and_loss(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "A"), (1, 3, "user", "v"), (1, 4, "assistant", "B</s>"),
        (2, 0, "assistant", "x"), (2, 1, "user", None),
        (3, 0, "user", "a"), (3, 0, "user", "a"),
        (4, 0, None, None),
        (None, 0, "user", "long " * 50_000),
    ]
    got = {r.conv_id: r for r in format_chats(frame(spark, rows)).withColumn("l", F.expr("filter(segments, s -> s.loss).text")).withColumn("u", F.transform("l", unescaped)).collect()}
    assert got[1].valid and got[1].u == ["A", "B</s>"] and got[1].l[1] == "B<\\/s>"
    assert not got[2].valid and got[2].bad_turn == 0 and got[2].l == ["x"]
    assert not got[3].valid and got[3].bad_turn == 1
    assert not got[4].valid and got[4].formatted == T.start + T.text_mark + T.end + T.after_end
    assert got[None].valid and len(re.findall("long ", got[None].formatted)) == 50_000
    assert format_chats(frame(spark, [])).count() == 0
