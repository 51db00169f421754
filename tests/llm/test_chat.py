"""Chat round trip: exact for hostile texts, with the loss mask on the right characters."""

import random

from pyspark.sql import functions as F

from lodgeflow.llm.chat import format_chats, loss_text, parse


def test_hostile_texts_survive(spark):
    rng = random.Random(2)
    bits = ["### ", "###", "</turn>", "\n", "\\", "\\0", "\\1", "\\2", "\\3", ": ", ":", "assistant", "é😀", " ", "<", "/turn>", "#"]
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "a: b", "### x", "", "\\3"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    rows += [(500, 0, None, None), (501, None, "assistant", "n"), (501, 0, "assistant", "z"), (501, 0, "assistant", "a"), (501, 0, "assistant", "a"),
             (None, 0, "user", "u"), (502, 0, "assistant", "long " * 100000)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "conv_id long, turn long, role string, text string, id string, formatted int")
    out = format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", parse(F.col("formatted")).alias("t"),
                                            loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(x.role, x.text) for x in got[c].t] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert len(got[c].loss_spans) == sum(r == "assistant" for r, _ in turns)
        assert got[c].formatted.count("</turn>") == len(turns) == got[c].formatted.count("### ")
    assert format_chats(df.limit(0)).collect() == []


def test_plain_texts_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b # c: d"), (1, 1, "assistant", "e")], "conv_id long, turn long, role string, text string")
    assert format_chats(df).first().formatted == "### user: a \\ b # c: d</turn>\n### assistant: e</turn>\n"


def test_parser_refuses_what_is_no_sequence_of_turns(spark):
    bad = ["x### u: t</turn>\n", "### u: t", "### u t</turn>\n", "### u: t</turn></turn>\n", "### u: t</turn>\n "]
    df = spark.createDataFrame([(b,) for b in bad] + [("",), ("### u: </turn>\n",)], "s string")
    assert [r[0] is None for r in df.select(parse(F.col("s"))).collect()] == [True] * 5 + [False, False]
