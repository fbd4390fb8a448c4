import random

from plumbline.llm import chat

EVENTS = "conv_id long, seq long, msg_id long, kind string, role string, text string, formatted string, ord string"


def turns(spark, events):
    df = spark.createDataFrame([(*e, "x", "x") for e in events], EVENTS)
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.render(chat.fold(df))).collect()}


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "Hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 1, "regenerate", None, "Good "), (1, 4, 1, "delta", None, "day"),
        (1, 5, 0, "edit", None, "hello"), (1, 6, 2, "delta", "user", "late"), (2, None, None, None, None, None), (None, 1, 1, "message", "user", "x"), (1, 7, 0, "message", "user", "again"),
    ]
    got = turns(spark, events)
    assert got[1] == [("user", "hello"), ("assistant", "Good day"), ("user", "late"), ("user", "again")]
    assert got[2] == [("", "")] and got[None] == [("user", "x")]


def plain(events):
    out, place = [], {}
    for conv, seq, msg, kind, role, text in sorted(events, key=lambda e: (e[1], chat.KINDS.index(e[3]), e[4], e[5])):
        if kind == "message" or (conv, msg) not in place:
            place[conv, msg] = len(out)
            out.append([seq, role, text])
        elif kind == "delta":
            out[place[conv, msg]][2] += text
        else:
            out[place[conv, msg]][2] = text
    return out


def test_random_logs(spark):
    rng = random.Random(3)
    logs = []
    for conv in range(30):
        for seq in range(rng.randint(1, 25)):
            logs.append((conv, seq, rng.randint(0, 3), rng.choice(chat.KINDS), rng.choice(["user", "assistant"]), "".join(rng.choice("ab\\<lb>\n/turn") for _ in range(5))))
    got = turns(spark, logs)
    for conv in got:
        assert got[conv] == [(r, t) for _, r, t in plain([e for e in logs if e[0] == conv])]


def test_round_trip_and_mask(spark):
    rng = random.Random(9)
    bits = ["<turn>", "</turn>\n", "<text>", "\\", "\\l", "\\b", "<", "b", "l", "\n", "é", "😀", "", "### Assistant:"]
    rows = [(c, t, rng.choice(["user", "assistant", "sy<st\\em"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(40) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.log_of(df)))
    back = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    for r in rendered.collect():
        own = [(a, b) for c, _, a, b in sorted(rows) if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in back[r["conv_id"]]["turns"]] == own
        masked = [r["formatted"][s["start"] : s["start"] + s["length"]].replace("\\l", "<").replace("\\b", "\\") for s in r["loss"]]
        assert masked == [t for role, t in own if role == "assistant"]


def test_repeated_turns_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (2, 5, None, "x" * 200000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["turns"] for r in chat.read_back(chat.render(chat.fold(chat.log_of(df)))).collect()}
    assert [tuple(t) for t in got[1]] == [("assistant", ""), ("user", "a"), ("user", "a")] and got[2][0]["text"] == "x" * 200000
    assert chat.render(chat.fold(chat.log_of(df.limit(0)))).count() == 0


def test_query_reads_the_loss_mask(spark, tmp_path):
    rows = [(1, 0, "user", "a < b"), (1, 1, "assistant", "é \\ <x>"), (1, 2, "assistant", ""), (1, 3, "user", "c"), (1, 4, "assistant", "\U0001f600 end"), (2, 0, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    query = chat.op5_format_chats(spark, str(tmp_path))
    assert "Window" in query._jdf.queryExecution().optimizedPlan().toString()
    assert {r["conv_id"]: r["loss_chars"] for r in query.collect()} == {1: 12, 2: 0, -7: 26}


def test_streamed_logs_fold_back(spark):
    rng = random.Random(4)
    bits = ["<turn>", "\\", "é", "😀", "word ", "\n", ""]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))])) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(99, 1, "assistant", "twice the same")] * 3 + [(98, (1 << 63) - 1, "assistant", "late"), (97, -(1 << 63), "assistant", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed_log(df)
    assert {r["kind"] for r in log.collect()} == set(chat.KINDS)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    for conv in got:
        own = [(t is not None, t or 0, role, text or "") for c, t, role, text in rows if c == conv]
        assert got[conv] == [r[2:] for r in sorted(own)]
