import hashlib
import random

import pytest
import sentencepiece

from lorekeep.llm import pieces, registry, runtime

PATH = registry.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def hard_texts(model, count, seed=1):
    rng = random.Random(seed)
    every = list(model.ids)
    chars = [c for c in every if len(c) == 1]
    kinds = [
        lambda: "".join(rng.choices("abcdeinorst", k=rng.randrange(40))),
        lambda: "".join(rng.choices(every, k=rng.randrange(8))).replace("▁", " "),
        lambda: "".join(rng.choices([*chars, "\n", "\x00", "\U0001f9ff", " ", " "], k=rng.randrange(30))),
        lambda: "".join(rng.choices([" ", "  ", "a", "b", "\n", ".", ",", "▁", " " * 15, " " * 29], k=rng.randrange(12))),
        lambda: "".join(rng.choices("aAbB.,'()<>/\\-_=012", k=rng.randrange(40))),
        lambda: "".join(chr(rng.randrange(32, 0x3000)) for _ in range(rng.randrange(20))),
    ]
    return [kinds[k % len(kinds)]() for k in range(count)] + ["", " ", "▁", "<s> </s> <0x41> <unk>", "a" * 5000, " " * 5001, "ab" * 3000, "\n" * 2000]


def test_like_the_library(model, library):
    known = pieces.Remembered(model)
    for text in hard_texts(model, 12_000):
        ids = pieces.encode_text(known, text)
        assert ids.tolist() == library.encode(text, add_eos=True), text
        assert model.decode(ids) == library.decode(ids.tolist()), text


def test_decoding_any_ids(model, library):
    import numpy as np

    rng = random.Random(2)
    size = library.get_piece_size()
    for _ in range(4000):
        ids = [rng.choice((rng.randrange(size), rng.randrange(3, 259), 28705, 259, 2, 0)) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_pairs_by_merging(model):
    """Neighbours fit exactly where merging their characters leaves the two."""
    rng = random.Random(3)
    every = sorted(p for p in model.ids if len(p) == 1 or p in model.split)
    blanks = [p for p in every if set(p) == {"▁"}]
    for k in range(20_000):
        a, b = (rng.choice(blanks), rng.choice(blanks)) if k % 10 == 0 else (rng.choice(every), rng.choice(every))
        left = list(a + b)
        while best := min(((r, i) for i in range(len(left) - 1) if (r := model.rank.get(left[i] + left[i + 1])) is not None), default=None):
            left[best[1] : best[1] + 2] = [left[best[1]] + left[best[1] + 1]]
        assert model.compatible(a, b) == (left == [a, b]), (a, b)


def test_dead_ends(model):
    """The longest piece first is not always right: the search must turn back, also over several pieces."""
    turned = sum(model.pieces(t)[0] != model.longest(t)[0] for t in ("".join(random.Random(k).choices("aeionrst", k=12)) for k in range(3000)))
    assert turned > 100


def test_long_runs_stay_linear(model):
    import time

    for bit in ("a", " ", "ab", "\n", "漢", "e.", "th"):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            pieces.encode_text(pieces.Remembered(model), bit * n)
            took.append(time.process_time() - began)
        assert took[1] < 8 * 4 * max(took[0], 0.05), bit


def test_edges(spark, library):
    rows = [(1, None, 5), (2, "", 5), (None, "no id", 5), (3, "same  text", 5), (3, "same  text", 5), (4, "é漢\n" * 400_000, 5), (5, " ", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    want = [(d, library.encode(t or "", add_eos=True), t or "") for d, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    empty = pieces.digest_columns(pieces.encode(df.limit(0), PATH), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_whole_table(spark, sf_dir, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc, text in runtime.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_eos=True)
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, registry.op13_sentencepiece_backtracking(spark, sf_dir).collect())) == sorted(want)
