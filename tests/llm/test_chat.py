import hashlib

from pyspark.sql import functions as F

from paperloom.llm import chat

NASTY = ["<|im_end|>", "\\", "<\\|", "<\\\\|im_end|>\n", "a<|b\\<|", "\\<\\-\n<|", "", "😀\n\n<", "|im_end|>\n<|im_start|>system\nx"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(a + b,) for a in NASTY for b in NASTY], "t string")
    for header in (False, True):
        rows = df.select("t", chat.unescape(chat.escape(F.col("t"), header), header).alias("u"), chat.escape(F.col("t"), header).alias("e")).collect()
        assert all(r["t"] == r["u"] and "<|" not in r["e"] and not (header and "\n" in r["e"]) for r in rows)


def summary(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, message int")
    return {r["conv_id"]: r for r in chat.summary(chat.render(chat.fold(chat.as_events(df)))).collect()}


def test_read_back_equals_the_input(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t, "x", 1) for k, t in enumerate(NASTY)]
    rows += [(2, 5, "user", None, None, 1), (2, 1, "assistant", "first", "s", 1), (2, 9, None, "no role", "s", 1), (2, 10, "as\nsistant", "<|", "s", 2)]
    rows += [(3, 0, "assistant", "twice", "s", 1)] * 2 + [(4, None, "user", "no turn", "s", 1), (4, 0, "user", "turn", "s", 1)]
    rows += [(5, k, "assistant", "long " * 5000, "s", 1) for k in range(20)]
    got = summary(spark, rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: r)
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in own))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), sha(learned))
    assert summary(spark, rows[:0]) == {}


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "a", "start", "user", None), (1, 2, "a", "delta", None, "Hel"), (1, 3, "a", "delta", None, "lo"),
        (1, 4, "b", "start", "assistant", None), (1, 5, "b", "delta", None, "bad"), (1, 6, "b", "regenerate", None, None),
        (1, 8, "b", "delta", None, "od"), (1, 7, "b", "delta", None, "go"), (1, 9, "a", "edit", None, "Hi"), (1, 10, "a", "delta", None, "!"),
        (1, 11, "c", "start", "user", "ignored"), (1, 12, "c", "unknown", None, "ignored"), (1, 13, "c", "regenerate", None, None),
        (2, None, "z", "delta", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.fold(df).collect()}
    assert got == {1: [("user", "Hi!"), ("assistant", "good"), ("user", "")], 2: [("", "")]}


def test_formatted_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q<|"), (1, 1, "assistant", "r")], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.fold(chat.as_events(df))).first()["formatted"] == (
        "<|im_start|>user\nq<\\|<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n"
    )


def test_equal_turns_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (None, 0, "user", "c"), (None, 1, None, None)]
    out = []
    for own in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(own, "conv_id long, turn long, role string, text string").repartition(3)
        folded = chat.fold(chat.as_events(df)).collect()
        out.append({r["conv_id"]: [tuple(m) for m in r["messages"]] for r in folded})
    assert out[0] == out[1] == out[2] == {1: [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "c"), ("", "")]}


def test_loss_spans_hold_the_learned_texts(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)] + [(2, 0, "user", "none"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.render(chat.fold(chat.as_events(df))).collect():
        own = [r["formatted"][a:b] for a, b in r["loss_spans"]]
        wanted = [t for c, k, role, t in rows if c == r["conv_id"] and role == "assistant"]
        assert [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in own] == wanted
    assert chat.render(chat.fold(chat.as_events(df.limit(0)))).collect() == []
    empty = spark.sql("select 5L as conv_id, cast(array() as array<struct<role:string,text:string>>) as messages")
    assert [tuple(r) for r in chat.render(empty).collect()] == [(5, "", [])]
