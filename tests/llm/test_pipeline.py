import importlib.util
from pathlib import Path

import corpus_pipeline
from lorekeep.llm import registry, runtime


def helpers(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_against_brute_force(spark, sf_dir):
    """Every stage's rows against plain Python, then ``run`` against the last."""
    docs = runtime.table(spark, sf_dir, "documents")
    rows = [r.asDict() for r in docs.collect()]
    columns = docs.columns
    kept = [r for r in rows if helpers("test_quality").figures(r["text"])[-1]]
    parent = {d: c for d, _, c in helpers("test_jaccard").brute_at([(r["doc_id"], r["text"]) for r in kept], 5, 80)}
    kept = [r for r in kept if parent[r["doc_id"]] == r["doc_id"]]
    items = [tuple(r) for r in runtime.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        at = runtime.store(stage(spark, at, sf_dir), "test-stage")
        assert at.columns == columns
        got = {r["doc_id"]: r.asDict() for r in at.collect()}
        if k == 1:
            assert got == {r["doc_id"]: r for r in kept}
        if k == 2:
            leaks = {d for d, _ in helpers("test_decontaminate").brute([(r["doc_id"], r["text"]) for r in kept], items)}
            kept = [r for r in kept if r["doc_id"] not in leaks]
            assert leaks and got == {r["doc_id"]: r for r in kept}
        if k == 3:
            hidden = {d: r["text"] for d, r in got.items()}
            links, n, _ = helpers("test_pseudonyms").replaced({r["doc_id"]: r["text"] for r in kept}, hidden)
            assert n > 5 and got == {r["doc_id"]: {**r, "text": hidden[r["doc_id"]], "n_chars": len(hidden[r["doc_id"]])} for r in kept}
    final = [(r["doc_id"], r["text"]) for r in at.collect()]
    helpers("test_packing").check(corpus_pipeline.run(spark, sf_dir).collect(), final)


def test_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii_pseudonyms", "packing"]


GOOD = " ".join(f"word{i} of" for i in range(40))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_edges(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, ties and extra columns with names that the operators use, at each stage."""
    long = " ".join(f"long{i}" for i in range(30_000)) + " mail a.person@example.org"
    schema = "doc_id long, text string, lang string, kept boolean, component_id long, item_id string, kinds int, __q_text string"
    rest = ("en", None, 5, "x", 6, "y")
    docs = spark.createDataFrame(
        [(None, None, *rest), (None, GOOD, *rest), (1, None, *rest), (1, None, *rest), (2, "", *rest), (3, long, *rest), (4, GOOD, *rest), (4, GOOD, *rest), (5, GOOD + " more", *rest), (6, "other " + long, *rest)], schema
    )
    ids = {}
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names
        rows = out.collect()
        ids[name] = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in rows)
        assert all(tuple(r)[2:] == rest for r in rows)
        assert run(spark, docs.limit(0), sf_dir).count() == 0
    every = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in docs.collect())
    assert ids["benchmark_decontamination"] == every
    assert [d for d, n in ids["quality_rules"]] == [0, 3, 4, 4, 5, 6]
    assert [d for d, n in ids["ngram_jaccard_join"]] == [0, 0, 1, 2, 3, 4]
    assert [d for d, n in ids["pii_pseudonyms"]] == [d for d, n in every] and ids["pii_pseudonyms"] != every
    packed = stage("packing")(spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0) > 0 and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert stage("packing")(spark, docs.limit(0), sf_dir).count() == 0


def test_repeated_rows(spark, sf_dir):
    """One row of those that repeat a doc_id with one text; different texts under one doc_id stay or go together."""
    other = " ".join(f"something{i} else" for i in range(40))
    rows = [(1, GOOD, "b"), (1, GOOD, "a"), (1, other, "c"), (2, GOOD, "d"), (None, other, "e"), (None, other, "e"), (7, None, "f"), (7, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["lang"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).collect())
    assert got == sorted([(1, GOOD, "a"), (1, other, "c"), (0, other, "e"), (0, other, "e"), (7, "", "f")])
