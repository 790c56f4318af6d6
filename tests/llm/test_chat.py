import hashlib
import random

import pytest

from lorekeep.llm import chat, registry, runtime


def test_round_trip():
    rng = random.Random(2)
    bits = [*chat.CONTROL, *chat.PLACEHOLDER.values(), "\\", "<", "|", "[", "a", "\n", "|>", "<|end|>\n", "<|turn:user|>\n", "é", "/"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
        role = "".join(rng.choices(bits, k=rng.randrange(0, 4)))
        formatted = chat.OPEN + chat.escape_role(role) + chat.HEAD + escaped + chat.END
        assert chat.parse_turn(formatted) == (role, text)


def test_parts(spark):
    parts = [
        ("text", "look <|image|> ", None, None, None, None, None),
        ("image", None, "a.png", 57, 28, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None),
        ("text", None, None, None, None, None, None),
        ("document", None, "c.pdf", None, None, None, 3),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts, "x"), (1, 1, "assistant", None, "x")], f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string")
    first, second = sorted(chat.format_turns(df).collect(), key=lambda r: r["turn"])
    assert first["formatted"] == "<|turn:user|>\nlook <\\|image|> <|image|><|audio|><|document|><|end|>\n"
    assert [(a["kind"], a["ref"], a["part"], a["tokens"]) for a in first["attachments"]] == [("image", "a.png", 1, 3), ("audio", "b.wav", 2, 38), ("document", "c.pdf", 4, 1536)]
    assert all(first["formatted"][a["at"] :].startswith(chat.PLACEHOLDER[a["kind"]]) for a in first["attachments"])
    assert (first["expanded_tokens"], first["text_words"], first["loss_start"], first["loss_end"]) == (1577, 2, 0, 0)
    assert second["formatted"] == "<|turn:assistant|>\n<|end|>\n" and second["loss_start"] == second["loss_end"] == 19
    bad = spark.createDataFrame([(1, 0, "user", [("video", "", None, None, None, None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_turns(bad).collect()


def expected(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        x = out.setdefault(conv, [0, "", ""])
        x[0] += 1
        x[1] += f"{role or ''}\n{text or ''}\n"
        x[2] += (text or "") if role == "assistant" else ""
    return {k: (n, hashlib.sha256(t.encode()).hexdigest(), len(a), hashlib.sha256(a.encode()).hexdigest()) for k, (n, t, a) in out.items()}


def digests(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.read_back(chat.format_turns(df.select("conv_id", "turn", "role", chat.text_part(df["text"]).alias("parts")))).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:5] for r in got}


def test_edges(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (3, 1, None, None), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 2, "assistant", "z" * 200_000), (4, 0, "sys\ntem|>", "\\")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"{i}</s>") for i in range(4000)]
    assert digests(spark, rows) == expected(rows)
    assert digests(spark, []) == {}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in runtime.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert {r["conv_id"]: tuple(r)[1:5] for r in registry.op4_typed_parts(spark, sf_dir).collect()} == expected(rows)


def test_ties_by_text(spark):
    """Turns that tie stand in the order of their texts, not of what escaping or the turn's end makes of them."""
    texts = ["<s>", "<a", "ab", "ab!", "ab~", "", None, "\\", "[", "[INST]", "[J", "<|", "<~"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, "assistant", t) for t in texts]
    assert digests(spark, rows) == expected(rows)
