import hashlib
import random

import duckdb
import numpy as np
import pytest

from lorekeep.llm import infill, registry, sql, text


def brute(doc, body):
    body = body or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(body)
    a, b = sorted((one % (n + 1), two % (n + 1)))
    form = "plain" if not body or any(s in body for s in ("<P>", "<S>", "<M>")) or three % 100 >= 90 else "spm" if four % 100 < 20 else "psm"
    if form == "plain":
        return doc, n, form, None, None, body
    out = {"psm": f"<P>{body[:a]}<S>{body[b:]}<M>{body[a:b]}", "spm": f"<S>{body[b:]}<P>{body[:a]}<M>{body[a:b]}"}[form]
    return doc, n, form, a, b - a, out


def order(rows):
    return sorted(rows, key=repr)


def hard_texts(seed, count):
    rng = random.Random(seed)
    bits = ["<", "P", "S", "M", ">", "<P>", "<S", "M>", "é", "漢", "😀", "\x00", "\n", " ", "a", "", "b" * 50, " ", "�"]
    return ["".join(rng.choices(bits, k=rng.randrange(0, 12))) for _ in range(count)]


def test_edges(spark):
    rows = [(k, t, "x") for k, t in enumerate(hard_texts(5, 1500))]
    rows += [(None, "no id", "x"), (None, None, "x"), (3, "again", "x"), (3, "again", "x"), (-7, "é" * 300_000, "x"), (9_000_000, "a<P>b", "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    made = infill.transform(df)
    want = [brute(d, t) for d, t, _ in rows]
    assert order(map(tuple, made.collect())) == order(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = infill.restore(made, "n")
    assert order(map(tuple, back.collect())) == order((d, brute(d, t)[2], t or "", len(t or "")) for d, t, _ in rows)
    empty = infill.digest_columns(infill.transform(df.limit(0)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_slices(monkeypatch):
    texts = [t.encode() for t in hard_texts(6, 300)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for most in (1, 7, 64, 1 << 20):
        cuts = list(infill.slices(offsets, most))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(texts)
        assert all(b == a + 1 or offsets[b] - offsets[a] <= most for a, b in cuts)
    monkeypatch.setattr(infill.slices, "__defaults__", (16,))
    body = np.frombuffer(b"".join(texts), np.uint8)
    drawn = np.random.default_rng(1).integers(0, 1 << 32, (len(texts), 4))
    whole = infill.arrange(body, offsets, drawn, infill.UNITS["codepoint"])
    parts = [infill.arrange(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], drawn[a:b], infill.UNITS["codepoint"]) for a, b in infill.slices(offsets)]
    for k in range(5):
        assert np.array_equal(whole[k], np.concatenate([p[k] for p in parts]))


def test_runs(spark):
    """Units of one class of bytes: cuts fall between words, blanks and signs only."""
    texts = ["naïve 漢字, ok\n\nit's  <P", "a", "  ", "x.y.z" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import regex

    for r in infill.transform(df, "run").collect():
        units = regex.findall(r"[\s]+|(?:[^\W_]|[^\x00-\x7f])+|[!-/:-@\[-`{-~\x00-\x08]+", texts[r["doc_id"]])
        assert "".join(units) == texts[r["doc_id"]] and r["n"] == len(units)
        if r["form"] != "plain":
            middle = r["output"].split("<M>")[1]
            assert middle == "".join(units[r["prefix_chars"] : r["prefix_chars"] + r["middle_chars"]])
    assert infill.restore(infill.transform(df, "run")).select("text").collect() == df.select(text.whole(df["text"]).alias("text")).collect()


def test_bad_output():
    at = np.array([0, 4])
    for body, form in ((b"<P>a", infill.PSM), (b"none", infill.SPM)):
        with pytest.raises(ValueError, match="three sentinels"):
            infill.rearrange(np.frombuffer(body, np.uint8), at, np.array([form]))
    with pytest.raises(ValueError, match="order"):
        infill.rearrange(np.frombuffer(b"<P>a<S><M>", np.uint8), np.array([0, 10]), np.array([infill.SPM]))


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(sql.OP11)
    got = registry.op11_infill_buffers(spark, sf_dir).select(*want.columns)
    assert order(map(tuple, got.collect())) == order(want.fetchall())
