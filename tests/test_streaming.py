from lorekeep.operators import sync
from lorekeep.sources.versions import VersionedTable
from lorekeep.streaming import changes as C

SCHEMA = "id long, node_id string, seq long, updated_at long, value double"


def feed(spark, folder, *batches):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120)


BATCHES = [[(1, "a", 1, 10, 1.0), (2, "a", 2, 11, 2.0), (1, "b", 1, 12, 3.0)], [(1, "a", 3, 5, 4.0), (2, "b", 2, 11, 5.0), (3, "b", 3, 1, 6.0)]]


def test_merge_and_vector(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), *BATCHES)
    stream = C.stream(spark, str(tmp_path / "in"), SCHEMA, files=1)
    table = VersionedTable(spark, str(tmp_path / "t"))
    run(C.merge_into(stream, table, str(tmp_path / "c1")))
    want = sorted(tuple(r) for r in sync.latest(spark.read.parquet(str(tmp_path / "in"))).select("id", "value").collect())
    assert sorted((r["id"], r["value"]) for r in table.read().collect()) == want == [(1, 3.0), (2, 5.0), (3, 6.0)]
    run(C.version_vectors(stream).writeStream.format("memory").queryName("vv").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")))
    assert sorted(tuple(r) for r in spark.table("vv").collect()) == [("a", 3), ("b", 3)]


def test_counter_goes_on(spark, tmp_path):
    turns = [[(7, k, "user" if k % 2 else "assistant") for k in range(5)], [(7, k, "user") for k in range(5, 8)] + [(8, 0, "user")]]
    schema, folder = "conv_id long, turn long, role string", str(tmp_path / "in")
    writer = lambda: C.save_triggers(C.stream(spark, folder, schema), 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    for batch in turns:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        run(writer())
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("conv_id", "turn", "nth").collect())
    assert got == [(7, 3, 2), (7, 6, 4)]


def test_log(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("add", "t", "{}", None)], "operation string, at string, params string, result string").write.parquet(folder)
    run(C.append_log(C.stream(spark, folder, "operation string, at string, params string, result string"), str(tmp_path / "log"), str(tmp_path / "c")))
    (tmp_path / "log" / "part-x.json").write_text("not json\n")
    assert [r["operation"] for r in C.read_log(spark, str(tmp_path / "log")).collect() if r["operation"]] == ["add"]


def test_allocate(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "node_id string, k int")
    vector = spark.createDataFrame([("a", 10)], "node_id string, seq long")
    assert sorted(tuple(r) for r in C.allocate(rows, vector, "k").select("node_id", "k", "seq").collect()) == [("a", 3, 11), ("a", 5, 12), ("b", 1, 1)]
