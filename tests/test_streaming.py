import random

from pyspark.sql import functions as F

from testloom.operators import quarantine
from testloom.operators.bazel import merge_targets
from testloom.streaming import ingest, targets

SCHEMA = "bundle_id string, test_id string, status string, time_ms long, seq long"
ROWS = [("b", "t1", "FAILURE", 10, 1), ("b", "t1", "SUCCESS", 20, 2), ("b", "t2", "FAILURE", 20, 3), ("b", "t2", "SUCCESS", 20, 4), ("b", "t3", "FAILURE", 5, 5), ("b", "t3", "FAILURE", 5, 6)]


def test_stream_equals_batch(spark, tmp_path):
    runs = spark.createDataFrame(ROWS, SCHEMA)
    runs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_bundles(spark, str(tmp_path / "in"), SCHEMA, 1)
    q = ingest.failed_tests_stream(stream).writeStream.format("memory").queryName("failing").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.test_id, r.seq) for r in spark.table("failing").where("failing").collect()}
    assert got == {(r.test_id, r.seq) for r in quarantine.failed_tests(runs).collect()}
    w = ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)


EVENTS = "bundle_id string, seq long, kind string, label string, attempt int, status string, cached boolean, uri string"


def result(bundle, seq, label, attempt, status, cached, *uris):
    return [(bundle, seq, "result", label, attempt, status, cached, u) for u in uris or [None]]


def test_targets_of_growing_files_equal_batch_for_any_split(spark, tmp_path):
    """Events in three batches of random order: the last version of each label is what the batch gives."""
    draw = random.Random(3)
    rows = [r for b in "ab" for s in range(40) for r in result(b, s, draw.choice(["//x", "//y", "//z", None]), draw.choice([1, 2, 3, None]), draw.choice(["PASSED", "FAILED", "ODD"]), draw.random() < 0.5, *[f"file:///{s}.xml", f"/{s}b.xml", f"{s}.log"][: draw.randint(0, 3)])]
    rows += result("b", 60, "//late", 1, "PASSED", False, "l.xml") + [("b", 25, "error", None, None, None, None, None), ("b", 50, "error", None, None, None, None, None), ("a", 41, "summary", "//x", 1, "PASSED", None, None)]
    whole = spark.createDataFrame([r for r in rows if r[0] == "a" or r[1] < 25], EVENTS)
    columns = ["bundle_id", "label", "cached", "build_status", "build_result", "max_attempt", "xml_files"]
    want = sorted(merge_targets(whole).select(*columns).collect(), key=str)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for split in range(2):
            draw.shuffle(rows)
            for n in range(3):
                spark.createDataFrame(rows[n::3], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{split}"))
            out = targets.merge_targets_stream(ingest.stream_bundles(spark, str(tmp_path / f"in{split}"), EVENTS, 1))
            q = out.writeStream.format("memory").queryName(f"targets{split}").outputMode("update").option("checkpointLocation", str(tmp_path / f"cp{split}")).trigger(availableNow=True).start()
            q.awaitTermination(200)
            last = spark.table(f"targets{split}").groupBy("bundle_id", "label").agg(F.max_by(F.struct("*"), "version").alias("t")).select("t.*").where("present")
            assert sorted(last.select(*columns).collect(), key=str) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
