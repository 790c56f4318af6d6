import json

from pyspark.sql import functions as F

from lorekeep.functions.noise import strip_noise
from lorekeep.sources import transcripts


def lines(*entries):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries)


FILES = {
    "agent": lines({"type": "user", "message": {"content": "hello <b>"}}, "not json", {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool"}, {"type": "text", "text": "there"}]}}),
    "rollout": lines({"type": "session_meta"}, {"type": "event_msg", "payload": {"type": "user_message", "message": " q "}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "a"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": 5}}),
    "session": lines({"type": "session", "version": 3}, {"type": "message", "message": {"role": "user", "content": "q"}}, {"type": "message", "message": {"role": "toolResult", "content": "x"}}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "thinking"}, {"type": "text", "text": "a"}]}}),
    "messages": json.dumps({"messages": [{"role": "human", "content": "q"}, {"role": "ai", "content": {"text": "a"}}, {"role": "user", "content": "r"}]}),
    "nested": json.dumps([{"chat_messages": [{"role": "user", "content": "q"}]}, {"chat_messages": [{"role": "assistant", "content": "a"}]}, {"x": 1}]),
    "mapping": json.dumps({"mapping": {"r": {"parent": None, "message": None, "children": ["a"]}, "a": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["q", 3]}}, "children": ["b", "z"]}, "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["a"]}}, "children": ["a"]}}}),
    "channel": json.dumps([{"type": "message", "user": "u1", "text": "one"}, {"type": "message", "user": "u2", "text": "two"}, {"type": "join"}, {"type": "message", "username": "u3", "text": "three"}, {"type": "message", "user": "u1", "text": "four"}]),
    "plain": "> a\nb\n> c\nd\n> e",
    "empty": "",
    "null": None,
    "single": json.dumps([{"role": "user", "content": "q"}]),
}


def test_dialects(spark):
    df = spark.createDataFrame(list(FILES.items()), "path string, content string")
    got = {r["path"]: (r["dialect"], r["transcript"]) for r in transcripts.normalise(df).collect()}
    assert got["agent"] == ("agent", "> hello <b>\nhi there\n")
    assert got["rollout"] == ("rollout", "> q\na\n")
    assert got["session"] == ("session", "> q\na\n")
    assert got["messages"] == ("messages", "> q\na\n\n> r\n")
    assert got["nested"] == ("messages", "> q\na\n")
    assert got["mapping"] == ("mapping", "> q\na\n")
    assert got["channel"] == ("channel", "> one\ntwo\n\n> three\n\n> four\n")
    for name in ("plain", "empty", "null", "single"):
        assert got[name] == ("plain", FILES[name])


def test_noise(spark):
    cases = {
        "a\n<system-reminder>x\ny</system-reminder>\nb": "a\nb",
        "a\n<system-reminder>x\n\ny</system-reminder>\nb": "a\n<system-reminder>x\n\ny</system-reminder>\nb",
        "in a line <command-name>x</command-name>": "in a line <command-name>x</command-name>",
        "> CURRENT TIME: 5\nb\nRan 2 Stop hooks (x)\nc\n… +7 lines (y)": "b\nc",
        "out [12 tokens] (ctrl+o to expand)": "out",
        "a\n\n\n\n\nb": "a\n\n\nb",
        "<hook_output>" + "line\n" * 3000 + "</hook_output>\nz": "z",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").repartition(2)
    assert {r[0]: r[1] for r in df.select("t", strip_noise(F.col("t"))).collect()} == cases


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.txt", "sub/b.JSONL", "c.meta.json", "d.png"):
        (tmp_path / name).write_text(name)
    got = {r["path"].rpartition("/")[2]: r["content"] for r in transcripts.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "a.txt", "b.JSONL": "sub/b.JSONL"}
