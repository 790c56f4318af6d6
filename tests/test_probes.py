from pyspark.sql import functions as F

from lorekeep.functions import probes as P


def test_file_rejection(spark):
    prose = "some words of a text\n" * 20
    cases = [
        (prose, "a/b.txt", None),
        ("x" * 501, "a.txt", "long_line"),
        (prose, "lib/a.min.js", "minified_name"),
        ("// Code generated by a tool\n" + prose, "a.go", "generated_header"),
        ("/*! For license information please see x */\n" + prose, "a.js", "license_banner"),
        (prose + "//# sourceMappingURL=a", "a.js", "bundled"),
        (("y" * 60 + "\n") * 5, "a.txt", "few_blanks"),
        (("y" * 60 + "\n") * 5, "a.json", None),
        ("ab " * 80, "a.txt", "long_average"),
        ("{} () [] ;; a\n" * 5, "a.js", "many_symbols"),
        ("", "a.txt", None),
        (None, "a.txt", None),
    ]
    df = spark.createDataFrame([(k, t, p) for k, (t, p, _) in enumerate(cases)], "k int, t string, p string")
    got = [r[1] for r in df.select("k", P.file_rejection(F.col("t"), F.col("p"))).orderBy("k").collect()]
    assert got == [w for *_, w in cases]


def test_time(spark):
    df = spark.createDataFrame([("What happened 3 weeks ago?", "2024-01-20"), ("yesterday", "2024-02-01"), ("Recently?", "2020-01-01"), ("nothing", "2024-01-01"), (None, None)], "q string, said string")
    when = P.relative_time(F.col("q"))
    d = P.temporal_distance(F.lit(1.0), F.lit("2024-02-10").cast("date"), F.col("said").cast("date"), when)
    got = df.select("q", when.alias("w"), d.alias("d")).collect()
    assert [tuple(r["w"]) if r["w"] else None for r in got] == [(21, 5), (1, 1), (14, 14), None, None]
    assert [round(r["d"], 6) for r in got] == [0.6, 1.0, 1.0, 1.0, 1.0]
