import json

import pytest
from pyspark.sql import functions as F

from strataform.sources import files
from strataform.streaming.ingest import compact, latest_table, reduce_batch, upsert_stream, windowed_counts


def test_json_lines(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a":1,"z":[1]}\n\n   \n[1]\n{bad\n"x"\n{"a":2}\n')
    d = files.json_lines(spark, str(p), "a int")
    assert sorted((r.ok, r.record.a if r.ok else None) for r in d.collect()) == [(0, None), (0, None), (0, None), (1, 1), (1, 2)]
    with pytest.raises(Exception, match="not a JSON object"):
        files.strict_json_lines(spark, str(p)).collect()


def test_small_files(spark, tmp_path):
    a = tmp_path / "berlin.json"
    a.write_text(json.dumps({"bbox": {"min_lat": 1, "min_lon": 2, "max_lat": 3, "max_lon": 4}}))
    assert files.area(str(a))["name"] == "berlin"
    a.write_text(json.dumps({"bbox": {"min_lat": 3, "min_lon": 2, "max_lat": 1, "max_lon": 4}}))
    with pytest.raises(ValueError):
        files.area(str(a))
    q = tmp_path / "q.txt"
    q.write_text("# c\n cafe \nhotel\n\ncafe\n")
    assert [tuple(r) for r in files.query_list(spark, str(q)).orderBy("position").collect()] == [(0, "cafe"), (1, "hotel")]
    s = tmp_path / "resume.json"
    assert files.completed_inputs(spark, str(s)).count() == 0
    s.write_text(json.dumps({"version": 1, "completed_inputs": ["a", "b"]}))
    assert files.completed_inputs(spark, str(s)).count() == 2
    s.write_text(json.dumps({"version": 1, "completed_inputs": ["a", "a"]}))
    with pytest.raises(ValueError):
        files.completed_inputs(spark, str(s))


def test_sinks_never_overwrite(spark, tmp_path):
    p = str(tmp_path / "plan.json")
    first = files.write_plan({"b": 1, "a": [1.5]}, p)
    assert first == files.write_plan({"a": [1.5], "b": 1}, str(tmp_path / "again.json"))
    with pytest.raises(FileExistsError):
        files.write_plan({}, p)
    assert files.read_plan(p, first) == {"a": [1.5], "b": 1}
    with pytest.raises(ValueError):
        files.read_plan(p, "0" * 64)
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[Infinity]"):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    files.backup(spark.range(3), str(tmp_path / "b"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.backup(spark.range(3), str(tmp_path / "b"))
    assert files.content_addressed(b"x", str(tmp_path)) == files.content_addressed(b"x", str(tmp_path))


def test_stream_equals_batch_in_any_order(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    e.orderBy(F.rand(3)).repartition(6).write.parquet(str(src))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(src))
    out = str(tmp_path / "out")
    upsert_stream(s, out, str(tmp_path / "cp"), "user_id", "ts").awaitTermination(120)
    want = {(r.user_id, r.n, r.latest.event_id) for r in reduce_batch(e, "user_id", "ts").collect()}
    rows = lambda: {(r.user_id, r.n, r.latest.event_id) for r in latest_table(spark, out, "user_id").collect()}
    assert rows() == want
    compact(spark, out, "user_id")
    assert rows() == want and len(list((tmp_path / "out").iterdir())) == 1


def test_windows_close_behind_the_watermark(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    e.write.parquet(str(src))
    s = windowed_counts(spark.readStream.schema(e.schema).parquet(str(src)), "ts", "event_type")
    q = s.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = spark.sql("select sum(n) from closed").first()[0]
    assert 0 < n <= e.count()


def test_snapshots_reports_and_tables(spark, tmp_path):
    from strataform.sources import tables

    p = str(tmp_path / "queries.txt")
    files.write_queries(["cafe", "hotel"], p)
    assert open(p).read() == "cafe\nhotel\n" and [r.query for r in files.query_list(spark, p).orderBy("position").collect()] == ["cafe", "hotel"]
    for bad in ([], ["a\nb"], [" "]):
        with pytest.raises(ValueError):
            files.write_queries(bad, str(tmp_path / "bad.txt"))
    assert files.write_report(lambda: {"checks": 3}, str(tmp_path / "report.json")) == {"ok": True, "checks": 3}
    with pytest.raises(ZeroDivisionError):
        files.write_report(lambda: 1 / 0, str(tmp_path / "fatal.json"))
    assert json.loads((tmp_path / "fatal.json").read_text())["error"] == "ZeroDivisionError"
    assert [r.json for r in files.as_json(spark.createDataFrame([(1, None)], "b int, a string")).collect()] == ['{"b":1}']
    root = str(tmp_path / "tables")
    with pytest.raises(FileNotFoundError):
        tables.write_table(spark.range(2), root, "t", "existing")
    with pytest.raises(ValueError):
        tables.write_table(spark.range(2), root, "t", "read")
    tables.write_table(spark.range(2), root, "t")
    tables.write_table(spark.range(2), root, "t", "existing")
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_table(spark.range(2), root, "t")
    assert tables.table(spark, root, "t").count() == 4
    assert [tuple(r) for r in tables.columns(spark, root, ("t",)).collect()] == [("t", "id", 1, "bigint")]
