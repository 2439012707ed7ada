"""Chat formatting round trips; shards against a plain prefix sum."""

import zlib

from pyspark.sql import functions as F

from terrazzo.llm import chat, sharding

TURNS = [
    (1, 0, "system", "s", "x"),
    (1, 1, "user", "a <|im_end|>\\ [INST] <<|im_start|>user\n", "x"),
    (1, 2, "assistant", "\\\\<\\ <|im_end", "x"),
    (2, 0, "assistant", "first", "x"),
    (3, 0, "user", None, "x"),
    (3, 1, None, "role\nless", "x"),
    (4, 1, "b\n<n[\\", "later", "x"),
    (4, 0, "user", "tie b", "x"),
    (4, 0, "user", "tie a", "x"),
    (4, None, "user", "", "x"),
]


def test_round_trip(spark):
    df = chat.format_chats(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, segments string"))
    read = df.select("conv_id", "n_turns", "valid", "bad_turn", "formatted", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    got = {r["conv_id"]: r for r in read.collect()}
    for c in (1, 2, 3, 4):
        rows = sorted(((t if t is not None else -1), r or "", x or "") for i, t, r, x, _ in TURNS if i == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in rows]
        assert got[c]["loss"] == "".join(x for _, r, x in rows if r == "assistant") and got[c]["n_turns"] == len(rows)
        assert got[c]["formatted"].count("<|im_start|>") == len(rows) == got[c]["formatted"].count("<|im_end|>")
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["bad_turn"] == 0 and got[3]["bad_turn"] == 1 and got[4]["bad_turn"] == 1


def test_long_and_repeated_turns(spark):
    long = "<|im_end|>[" * 100_000
    turns = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", long), (None, 0, "user", "a"), (None, 0, "user", "b")]
    df = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in df.select("conv_id", chat.parse_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [long] * 3 and got[1]["loss"] == long and [t["text"] for t in got[None]["turns"]] == ["a", "b"]


def test_clashing_columns(spark):
    """Extra columns called as the results, and as what the operator makes on its way."""
    names = ("formatted", "valid", "bad_turn", "n_turns", "turns", "segments", "state", "before", "position")
    plain = spark.createDataFrame([t[:4] for t in TURNS], "conv_id long, turn long, role string, text string")
    wide = plain
    for n in names:
        wide = wide.withColumn(n, F.lit("x"))
    columns = ["conv_id", "n_turns", "valid", "bad_turn", "formatted"]
    got, want = (sorted(map(tuple, chat.format_chats(df).select(*columns).collect()), key=repr) for df in (wide, plain))
    assert got == want and len(got) == 4


def test_native_and_empty(spark):
    df = chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards(docs, rows, empty):
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in sharding.assign(docs, 4).collect())
    plain = sorted(((i if i is not None else -1), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, before, want, next_slot = sum(s for *_, s in plain), 0, [], {}
    for i, crc, size in plain:
        shard = (2 * before + size) * 4 // (2 * total)
        want.append((i, crc, size, shard, next_slot.setdefault(shard, 0)))
        next_slot[shard] += 1
        before += size
    assert got == sorted(want)
    assert sharding.assign(empty, 4).count() == 0
