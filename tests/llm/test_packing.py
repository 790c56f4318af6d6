import zlib

import numpy as np
from tokenizers import Tokenizer

from lorekeep.llm import packing, registry, runtime


def expected(texts):
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check(rows, docs):
    """Every id in exactly one piece, windows full but the last, offsets without gaps."""
    ids = dict(zip([d for d, _ in docs], expected([t for _, t in docs]), strict=True))
    per_doc, per_seq = {}, {}
    for r in rows:
        per_doc.setdefault(r["doc_id"], []).append(r)
        per_seq.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert set(per_doc) == set(ids)
    for doc, pieces in per_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[doc])
    assert sorted(per_seq) == list(range(len(per_seq)))
    for seq, pieces in per_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or (seq == max(per_seq) and at <= 1024)


def test_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in runtime.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(registry.op8_concat_and_cut(spark, sf_dir).collect(), docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "x <|endoftext|> y"), (4, "long " * 6000), (5, "  Ünï ² \U0001f600\n\n  z"), (6, "exact")]
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in docs], "doc_id long, text string, part int, ids string").repartition(3)
    check(packing.pack(df, *registry.bpe_50k()).collect(), docs)
    assert packing.pack(df.limit(0), *registry.bpe_50k()).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(twice, *registry.bpe_50k()).collect()) == [(0, 3), (7, 3), (7, 3)]


def test_long_blanks(spark):
    """Runs of white space of any length have the ids of the tokenizers library: before words, at the end, beside special tokens."""
    run = "\n" * 5000
    texts = [run, run + "x", "a" + run + " b", "a" + run + "\n", run + "<|endoftext|>" + run + "1", " " * 9000 + "a" + "　" * 4097 + "é", "\x1c" * 5000 + " a", "\t" * 4095 + "!", "a" * 30_000 + run]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(packing.pack(df, *registry.bpe_50k()).collect(), list(enumerate(texts)))
    path, pattern, special = registry.bpe_50k()
    ids = packing._encode(packing.encoder(path, pattern, special), "\n" * 1_000_000 + "x", special)
    assert packing.encoder(path, pattern, special).decode(ids) == "\n" * 1_000_000 + "x"
