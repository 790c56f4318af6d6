import random
import re

from lorekeep.llm import registry, runtime, wordpiece


def greedy(word, vocabulary, most):
    at, n = 0, 0
    while at < len(word):
        size = next((k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def test_random_vocabularies():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        automaton = wordpiece.PieceCounter(pieces)
        for _ in range(80):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 14)))
            assert automaton.count(word) == greedy(word, pieces, 6), (pieces, word)


def test_whole_table(spark, sf_dir):
    vocabulary = set(wordpiece.byte_level_pieces(registry.tokenizer_file("byte_bpe_50k.json")))
    assert len(vocabulary) == 50256 and {bytes([b]) for b in range(256)} <= vocabulary
    most = max(map(len, vocabulary))
    texts = {r[0]: r[1] for r in runtime.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in registry.op7_wordpiece_counts(spark, sf_dir).collect():
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])]
        assert (r["n_words"], r["n_unknown"]) == (len(words), 0)
        assert r["n_pieces"] == sum(greedy(b" " + w, vocabulary, most) for w in words)


def test_edges(spark, tmp_path):
    file = tmp_path / "v.json"
    file.write_text('{"added_tokens": [{"content": "<s>"}], "model": {"vocab": {"<s>": 0, "Ġa": 1, "b": 2, "bc": 3, "Ġ": 4}}}')
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "abcb a ", 0), (3, "a d " * 2000, 0), (3, "b", 0)], "doc_id long, text string, n_words int")
    got = sorted(((r[0] or 0, *r[1:]) for r in wordpiece.piece_counts(df, str(file)).collect()))
    assert got == [(0, 2, 4, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 2, 0), (3, 4000, 4000, 2000)]
    assert wordpiece.piece_counts(df.limit(0), str(file)).count() == 0
