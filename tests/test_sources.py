"""Canonical tables, manifests, and streams against the same batch."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources import canonical, files
from quarry.streaming import events

DIR = "/root/testdata/sf0.001"


def test_manifest_and_audit(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / name).write_text(text)
    rows = files.manifest(spark, str(tmp_path)).collect()
    assert len(rows) == 3
    before = spark.createDataFrame(rows)
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("4")
    got = {r.path.rpartition("/")[2]: r.issue for r in files.audit(before, files.manifest(spark, str(tmp_path))).collect()}
    assert got == {"a": "changed", "b": "missing", "d": "unrecorded"}


def test_stream_equals_batch(spark, tmp_path):
    rows = canonical.read(spark, DIR, "events").select("event_id", "ts", "event_type", "value").orderBy("ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = events.windowed(stream, "1 hour", ["event_type"], late="3650 days").writeStream.format("memory").queryName("got").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("got")) == key(events.windowed(rows, "1 hour", ["event_type"]))


def test_pages_hold_twelve_lines(spark):
    b = canonical.blocks(spark, DIR)
    assert b.where("page_no <> 1 + reading_order div 12").count() == 0 and b.where("text = ''").count() == 0


ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())])


def test_csv_headers_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ('say "hi"\nthere', 1), (None, None)], ROW)
    files.write_csv(rows, f"{tmp_path}/ok", ["k", "n"], ["n"])
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/ok", ROW).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv(rows, f"{tmp_path}/ok", ["k", "n"], ["n"])
    for name, text in (("order", "n,k\n1,a\n"), ("type", "k,n\na,x\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            files.read_csv(spark, f"{tmp_path}/{name}.csv", ROW).collect()


def test_json_of_many_files_and_the_last_wins(spark, tmp_path):
    for name, value in (("a/draft", [{"k": "x", "n": 1}, {"k": "y"}]), ("b/draft", {"rows": [{"k": "x", "n": 2}, {"k": "x", "n": 3}]}), ("a/late", [{"k": "y", "n": 9}]), ("b/none", [])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    rows = files.read_json(spark, f"{tmp_path}/*/*.json", ROW, "rows")
    assert rows.count() == 5
    got = files.last_written(rows, ["k"], F.col("file").endswith("late.json")).collect()
    assert {r.k: r.n for r in got} == {"x": 3, "y": 9}


def test_nested_nodes_are_in_order(spark, tmp_path):
    sections = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, pos int")
    nodes = spark.createDataFrame([(1, 0, 9, "b"), (1, 0, 2, "a"), (1, 0, 9, "a")], "doc_id long, pos int, place int, text string")
    out = files.nested(sections, nodes, ["doc_id", "pos"], "place")
    files.write_json(out, f"{tmp_path}/tree")
    got = {r.pos: [(n.place, n.text) for n in r.nodes] for r in spark.read.schema(out.schema).json(f"{tmp_path}/tree").collect()}
    assert got == {0: [(2, "a"), (9, "a"), (9, "b")], 1: []}
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_json(out, f"{tmp_path}/tree")


def test_paths_that_leave_the_folder_are_reported(spark):
    rec = spark.createDataFrame([("a/../b", "1"), ("c", "2")], "path string, sha256 string")
    assert {r.path: r.issue for r in files.audit(rec, rec).collect()} == {"a/../b": "escapes"}


def test_late_rows_and_closed_windows(spark, tmp_path):
    """Append mode: a window is written once, when the watermark passes it; rows that come later than that are left out."""
    sent = [[("2024-01-01 00:10:00", 1), ("2024-01-01 03:30:00", 2)], [("2024-01-01 00:20:00", 4), ("2024-01-01 09:00:00", 8)], [("2024-01-01 12:00:00", 16)]]
    source = f"{tmp_path}/in"
    stream = spark.readStream.schema("ts timestamp, key string, value double").json(source + "/*")
    (tmp_path / "in").mkdir()
    q = None
    for i, rows in enumerate(sent):
        spark.createDataFrame(rows, "ts string, value int").select(F.to_timestamp("ts").alias("ts"), F.lit("k").alias("key"), F.col("value").cast("double")).coalesce(1).write.json(f"{source}/{i}")
        q = events.windowed(stream, "1 hour", ["key"], late="1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(str(r.start), r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 03:00:00", 1, 2.0), ("2024-01-01 09:00:00", 1, 8.0)}


def test_first_seen_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 00:30:00", "b")], "ts string, key string").select(F.to_timestamp("ts").alias("ts"), "key")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = events.first_seen(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "key").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("seen").collect()) == ["a", "b"] == sorted(r.key for r in events.first_seen(rows, "key").collect())
