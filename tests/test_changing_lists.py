"""Lists that change, totals while writing, logs by time, metadata with unknown fields."""

import os
import random

from testloom.operators import quarantine, validation
from testloom.sources import uploads


def test_quarantine_as_of_a_time(spark):
    rng = random.Random(4)
    versions = [(b, t, f"t{i}") for b in "ab" for t in (10, 20, 30) for i in range(6) if rng.random() < 0.5] + [("a", 40, None), ("a", 10, "t0"), ("a", 10, "t0")]
    runs = [(b, f"t{rng.randrange(7)}", rng.choice([None, 5, 10, 15, 20, 29, 30, 35, 40, 99]), n) for n, b in enumerate(rng.choice("abc") for _ in range(200))] + [(None, "t0", 10, 900), ("a", None, 10, 901)]
    out = quarantine.flag_quarantined_as_of(spark.createDataFrame(runs, "bundle_id string, test_id string, time_ms long, seq long"), spark.createDataFrame(versions, "bundle_id string, list_ms long, test_id string"))
    got = {r.seq: (r.list_ms, r.is_quarantined) for r in out.collect()}
    for b, t, ms, n in runs:
        last = max((v for x, v, _ in versions if x == b and ms is not None and v <= ms), default=None)
        assert got[n] == (last, t is not None and (b, last, t) in versions), (b, t, ms)
    assert len(got) == len(runs) and out.count() == len(runs)


def test_totals_while_writing(spark, tmp_path):
    found = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 3, "c")], "file string, level int, error_message string")
    row = validation.write_issues(found, str(tmp_path / "a")).first()
    assert (row.num_issues, row.max_level, row.num_invalid, row.num_suboptimal) == (3, 3, 2, 1) and spark.read.parquet(str(tmp_path / "a")).count() == 3
    row = validation.write_issues(found.limit(0), str(tmp_path / "b")).first()
    assert (row.num_issues, row.max_level, row.num_invalid, row.num_suboptimal) == (0, 0, 0, 0)


def test_newest_log_first(spark, tmp_path):
    big = "x\n" * 200_000
    logs = {
        "r1/_diag/Worker_a.log": ("INFO JobRunner] Job ID old\n", 100), "r1/_diag/Worker_b.log": (f"{big} \"jobId\" : \"mid\" \n[INFO JobRunner] Job ID later\n", 200), "r1/_diag/Worker_c.log": ("nothing\n", 300),
        "r2/_diag/Worker_a.log": (f"INFO JobRunner] Job ID  no\n[INFO JobRunner] Job ID yes now\n{big}", 50), "r3/_diag/Worker_a.log": ("", 1), "r4/_diag/.hidden": ("INFO JobRunner] Job ID h\n", 1),
    }
    for name, (text, modified) in logs.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (modified, modified))
    rows = {r.runner_dir.rpartition("/")[2]: r for r in uploads.scan_runner_logs(spark, str(tmp_path)).collect()}
    assert {k: r.job_id for k, r in rows.items()} == {"r1": "mid", "r2": "yes"}
    assert 400_000 < rows["r1"].bytes_read < 400_100 and rows["r2"].bytes_read < 100


def test_metadata_keeps_what_it_does_not_know(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": "1", "num_files": 3, "num_tests": null, "later": {"a": [1, 2.5, null]}, "n": 7, "envs": {"A": "1"}}')
    (tmp_path / "b.json").write_text("not json")
    rows = sorted(uploads.scan_bundle_meta(spark, str(tmp_path)).withColumn("j", uploads.bundle_meta_json()).collect(), key=lambda r: r.version or "")
    assert [r.schema_version for r in rows] == ["0.5.29", "0.5.29"] and rows[0].unknown is None and rows[0].nulls == []
    assert rows[1].unknown == '{"later":{"a":[1,2.5,null]},"n":7}' and rows[1].nulls == ["num_tests"] and rows[1].envs == {"A": "1"}
    assert rows[1].j == '{"version":"1","envs":{"A":"1"},"num_files":3,"num_tests":null,"later":{"a":[1,2.5,null]},"n":7}'
