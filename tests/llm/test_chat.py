from siftwell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def brute(rows):
    convs = {}
    key = lambda x: (x is not None, x if x is not None else 0)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((key(turn), (role is not None, role or ""), (text is not None, text or "")))
    convs = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in convs.items()}
    kept = {}
    for c, turns in sorted(convs.items()):
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values())
        earlier = any(b < c and o == turns for b, o in convs.items())
        if not longer and not earlier:
            kept[c] = (len(turns), "".join(f"<|{r[1]}|>\n{t[1]}\n" for r, t in turns))
    return kept


def test_snapshots_copies_and_awkward_rows(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "see you")]
    rows = [(c, i, r, t, "x") for c, n in ((1, 4), (2, 2), (3, 4), (4, 1), (5, 3)) for i, (r, t) in enumerate(talk[:n])]
    rows += [(6, 0, "user", "hi", "x"), (6, 1, "assistant", "other", "x")]
    rows += [(7, 0, None, None, None), (8, 0, "", "", ""), (9, None, "user", "hi", ""), (9, 1, "user", None, "")]
    rows += [(None, 0, "user", "hi", ""), (10, 0, "userhi", "", ""), (11, 0, "user", "x" * 100_000, ""), (12, 1, "a", "b", ""), (12, 1, "a", "b", "")]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {r.conv_id: (r.n_turns, r.text) for r in out.collect()} == brute(rows)
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_share_the_first_turn(spark):
    rows = [(c, i, "user", "same" if i == 0 else f"{c % 40} {i}", "") for c in range(300) for i in range(1 + c % 5)]
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert {r.conv_id: (r.n_turns, r.text) for r in out.collect()} == brute(rows)
