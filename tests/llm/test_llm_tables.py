import hashlib
import zlib

from hazeline.llm import chat, sharding

ROWS = [(1, "a"), (2, None), (3, ""), (4, "é" * 5), (4, "a"), (None, "x")] + [(i, f"t{i}") for i in range(10, 400)]


def test_shards_are_whole_and_move_only_into_the_new_one(spark):
    docs = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "doc_id long, text string, shard string, slot int")
    got = sharding.assign(docs, [1.0] * 7).collect()
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        data = (t or "").encode()
        assert any((r["id"], r["size"], r["text_crc32"]) == (i, len(data) + 16, zlib.crc32(data)) for r in got)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 7) for r in got)
    moved = sum(r["grown_shard"] == 7 for r in got)
    assert 0 < moved < len(ROWS) / 4
    more = {(r["id"], r["text_crc32"]): r["shard"] for r in sharding.assign(docs, [1.0] * 8).collect()}
    assert all(more[r["id"], r["text_crc32"]] == r["grown_shard"] for r in got)
    assert len({r["shard"] for r in got if r["id"] == 4}) == 1
    heavy = sharding.assign(docs, [3.0, 1.0]).where("shard = 0").count()
    assert 0.65 * len(ROWS) < heavy < 0.85 * len(ROWS)
    assert sharding.assign(docs.limit(0), [1.0] * 3).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = sharding.assign(docs, [1.0] * 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


TURNS = [
    (1, 0, "system", "be <|nice|> [INST]"), (1, 1, "user", "a\\b <| \\<| |\\ [\\"), (1, 2, "assistant", "</s>[INST] ok [/INST]"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "\\\\<\\|>"), (1, 6, "user", "last"),
    (2, 0, "user", "only"), (3, 0, "assistant", "é" * 3000), (3, 0, "assistant", "tie"), (4, None, None, "x"), (None, 0, "user", "n"), (5, 0, "a|><|end|>", "role"),
]


def test_chat_round_trip_and_masks(spark):
    turns = spark.createDataFrame([(*t, "e") for t in TURNS], "conv_id long, turn long, role string, text string, example string")
    parts = chat.examples(chat.segments(turns))
    back = [r for r in chat.read_back(parts).collect() if r["role"] is not None]
    masks = [r for r in parts.collect() if r["loss_start"] is not None]
    assert len(masks) == sum(t[2] == "assistant" for t in TURNS) == len({(r["conv_id"], r["example"]) for r in masks})
    assert all(len(r["text"]) == r["stop"] - r["start"] and r["start"] < r["loss_start"] <= r["loss_stop"] < r["stop"] for r in masks)
    assert sorted((repr(r["conv_id"]), repr(r["turn"]), r["role"], r["text"]) for r in back) == sorted(
        (repr(c), repr(t), r or "", x or "") for c, t, r, x in TURNS)
    shown = {}
    for r in chat.render(parts).collect():
        shown.setdefault(r["conv_id"], []).append(r)
    for conv, rows in shown.items():
        mine = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        replies = [t[3] or "" for t in mine if t[2] == "assistant"]
        rows.sort(key=lambda r: len(r["text"]))
        masked = [r for r in rows if r["example"] is not None]
        for r, reply in zip(masked, replies, strict=True):
            span = r["text"][r["loss_start"]:r["loss_stop"]]
            for c in chat.GUARDED:
                span = span.replace(c + "\\", c)
            assert span.replace("\\\\", "\\") == reply
            assert r["text"].endswith(chat.END) and r["text"].count(chat.END) == r["text"].count(chat.OPEN) // 2
        assert len(rows) == len(replies) + (mine[-1][2] != "assistant")
        for a, b in zip(rows, rows[1:]):
            assert b["text"].startswith(a["text"])
        assert rows[-1]["text"].count(chat.END) == len(mine)
    assert chat.examples(chat.segments(turns.limit(0))).count() == 0


def test_queries_match_direct_computation(spark, tmp_path):
    from hazeline.llm import queries

    spark.createDataFrame([t for t in TURNS if t[0] == 1], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op8_chat_format(spark, str(tmp_path)).collect()}
    said = "".join(f"{r}\n{x or ''}\n" for c, _, r, x in TURNS if c == 1)
    replies = "".join(x for c, _, r, x in TURNS if c == 1 and r == "assistant")
    assert set(got) == {1, -7}
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (7, hashlib.sha256(said.encode()).hexdigest())
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())


def test_chat_query_takes_an_empty_table(spark, tmp_path):
    from hazeline.llm import queries

    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.op8_chat_format(spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows] == [(-7, 2, 21)]


def test_chat_digests_stream_conversations_of_any_length(spark):
    rows = [*TURNS, *[(6, i, "assistant" if i % 2 else "user", f"turn <{i}> é" * 9) for i in range(3000)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.examples(chat.segments(turns)))
    fields = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"
    want = set()
    for conv in {t[0] for t in rows}:
        mine = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        replies = "".join(x or "" for _, _, r, x in mine if r == "assistant")
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine)
        want.add((conv, len(mine), hashlib.sha256(said.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest()))
    for in_row in (0, 3500, chat.IN_ROW):
        got = [tuple(r[f] for f in fields) for r in chat.digests(read, in_row).collect()]
        assert len(got) == len(want) and set(got) == want
