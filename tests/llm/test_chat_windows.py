import hashlib

import pytest
from pyspark.sql import functions as F

from creditscope.llm import chat_windows as chat

ODD = "\\### Assistant: </turn> ok"


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        every = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(-7, 0, "user", ODD), (-7, 1, "assistant", ODD), (1, 0, "assistant", None), (2, None, None, None),
           (3, 0, "system", "a # b < c \\"), (4, 1, "user", "hi"), (4, 1, "user", "hi"), (4, 1, "assistant", "x\n</turn>\n### a:\nb"),
           (None, 0, "user", "no id"), (None, 1, "assistant", "still"), (5, 0, "a:b\\", "\\"), (6, 0, "system", "s" * 9000),
           (6, 1, "user", "u"), (6, 2, "assistant", "")]
    out += [(8, i, "system" if i == 0 else ["user", "assistant"][i % 2], f"t{i} " * (i * 7 % 150)) for i in range(400)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as window", "'x' as conv", "2 as t")


def test_output_reads_back(spark, rows):
    windows = chat.windows(frame(spark, rows), budget=256, history=64)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == expected(rows)


def test_windows_keep_budget_system_and_history(spark, rows):
    windows = chat.windows(frame(spark, rows), budget=256, history=64).where("conv = 8").orderBy("window").collect()
    assert len(windows) > 20
    previous = []
    for w in windows:
        segs = w.formatted.split(chat.END)[:-1]
        context, new = segs[:w.n_context], segs[w.n_context:]
        tokens = lambda some: sum(-(-len(x + chat.END) // 4) for x in some)
        # Over the budget only if the system turn and one new turn are so on their own.
        head = tokens(previous[:1]) + tokens(new)
        assert new and (w.n_tokens <= 256 or head > 256 and len(new) == 1 and w.n_context <= 1)
        if previous:
            assert context[0] == previous[0] and context[0].startswith("### system")
            # The repeated turns are the last ones before, as many as fit.
            size = [-(-len(s + chat.END) // 4) for s in previous[1:]]
            room = min(64, 256 - head)
            keep = next(i for i in range(len(size) + 1) if i == len(size) or sum(size[i:]) <= room)
            assert context[1:] == previous[1:][keep:]
        previous += new
    assert len(previous) == 400


def test_targets_are_the_new_assistant_texts(spark, rows):
    for w in chat.windows(frame(spark, rows), budget=256, history=64).collect():
        segs = w.formatted.split(chat.END)[:-1][w.n_context:]
        want = [s.split(":\n", 1)[1] for s in segs if s.startswith("### assistant:\n")]
        assert [w.formatted[t.start:t.start + t.length] for t in w.targets] == want


def test_no_rows_and_no_python(spark, rows):
    assert chat.digests(chat.windows(frame(spark, rows).limit(0))).collect() == []
    plan = chat.digests(chat.windows(frame(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\", "#<\\#", "</turn>", "### a:\nb", "a\nb\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = df.select(F.col("t"), chat.unescaped(chat.escaped(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in back)
