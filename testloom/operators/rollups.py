"""Roll-ups of runs to suites, reports and uploads; nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suite_rollup(runs: DataFrame) -> DataFrame:
    """Per suite: tests, skipped, failures, errors (always 0), last start, total seconds."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return runs.groupBy("bundle_id", "parent_name").agg(
        F.count("*").alias("tests"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "FAILURE").alias("failures"),
        F.lit(0).cast("long").alias("errors"), F.max("started_at").alias("started_at"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"),
    )


def report_rollup(suites: DataFrame) -> DataFrame:
    """Per report: sums over its suites."""
    return suites.groupBy("bundle_id").agg(F.sum("tests").alias("tests"), F.sum("failures").alias("failures"), F.sum("seconds").alias("seconds"))


def bundle_counts(runs: DataFrame) -> DataFrame:
    """Files and tests of each bundle."""
    return runs.groupBy("bundle_id").agg(F.countDistinct("file_path").alias("num_files"), F.count("*").alias("num_tests"))


def nested_report(runs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per bundle with an array of results, each with its ordered runs and build.

    Runs with a Bazel label get one result per label, with the target's build result and
    greatest attempt; the other runs of a bundle share one result without build.
    """
    label = F.col("bazel.label") if "bazel" in runs.columns else F.lit(None).cast("string")
    kept = [c for c in runs.columns if c not in ("bundle_id", "seq")]
    results = runs.withColumn("_label", label).groupBy("bundle_id", "_label").agg(F.sort_array(F.collect_list(F.struct("seq", *kept))).alias("test_case_runs"))
    if targets is None:
        build = F.lit(None).cast("struct<label:string,build_result:string,max_attempt:int>")
        results = results.withColumn("build", build)
    else:
        t = targets.select(F.col("bundle_id").alias("_b"), F.struct("label", "build_result", "max_attempt").alias("build"))
        results = results.join(t, (results.bundle_id == t._b) & results["_label"].eqNullSafe(F.col("build.label")), "left").drop("_b")
    return results.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("_label", "test_case_runs", "build"))).alias("test_results")).select(
        "bundle_id", F.transform("test_results", lambda r: F.struct(r["test_case_runs"].alias("test_case_runs"), r["build"].alias("build"))).alias("test_results")
    )


def flat_report(reports: DataFrame) -> DataFrame:
    """The runs of nested reports. A row with `test_case_runs` only is a report of one result.

    Legacy `line` and `attempt_number`, where present and not 0, stand in for the new fields.
    """
    if "test_results" in reports.columns:
        reports = reports.select("bundle_id", F.explode("test_results").alias("r")).select("bundle_id", "r.test_case_runs")
    runs = reports.select("bundle_id", F.explode("test_case_runs").alias("x")).select("bundle_id", "x.*")
    for new, old in (("line_number", "line"), ("attempt_index", "attempt_number")):
        if old in runs.columns:
            value = F.nullif(F.col(old), F.lit(0))
            runs = runs.withColumn(new, F.coalesce(F.col(new), value) if new in runs.columns else value).drop(old)
    return runs
