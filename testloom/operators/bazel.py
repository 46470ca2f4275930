"""Bazel build events: targets, attempt files, build results, sources of a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Test states and what they mean for a build; states a runner summary may have.
BUILD_RESULTS = {
    "PASSED": "SUCCESS", "FLAKY": "FLAKY", "TIMEOUT": "FAILURE", "FAILED": "FAILURE", "INCOMPLETE": "FAILURE", "REMOTE_FAILURE": "FAILURE",
    "FAILED_TO_BUILD": "FAILURE", "TOOL_HALTED_BEFORE_TESTING": "FAILURE", "NO_STATUS": "UNSPECIFIED",
}
RUNNER_STATES = ("PASSED", "FAILED", "FLAKY")
FILE_PREFIX = "^file://"


def build_result(status: Column) -> Column:
    """J11"""
    pairs = F.create_map(*(F.lit(x) for kv in BUILD_RESULTS.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, status), F.lit("UNSPECIFIED"))


def known_status(status: Column) -> Column:
    """A state of BUILD_RESULTS; anything else is an error and counts as NO_STATUS."""
    return F.when(status.isin(*(k for k in BUILD_RESULTS if k != "NO_STATUS")), status).otherwise(F.lit("NO_STATUS"))


def xml_files(events: DataFrame) -> DataFrame:
    """Attempt files of test results: events x their XML outputs; attempts count from 0."""
    results = events.where("kind = 'result' and uri like '%.xml'")
    return results.select("bundle_id", "label", "seq", F.regexp_replace("uri", FILE_PREFIX, "").alias("file"), (F.col("attempt") - 1).cast("int").alias("attempt"), "start_time", "end_time")


def merge_targets(events: DataFrame) -> DataFrame:
    """A1, A2: per label: first `cached`, last status, greatest attempt, ordered files."""
    results = events.where("kind = 'result'")
    file = F.when(F.col("uri").endswith(".xml"), F.struct("seq", F.regexp_replace("uri", FILE_PREFIX, "").alias("file")))
    merged = results.groupBy("bundle_id", "label").agg(
        F.min_by("cached", "seq").alias("cached"), F.max_by(known_status(F.col("status")), "seq").alias("build_status"),
        F.max((F.col("attempt") - 1).cast("int")).alias("max_attempt"), F.sort_array(F.collect_list(file)).alias("_files"),
    )
    return merged.withColumn("build_result", build_result(F.col("build_status"))).withColumn("xml_files", F.transform("_files", lambda f: f["file"])).drop("_files")


def runner_summaries(events: DataFrame) -> DataFrame:
    """Last usable summary per label: passed, failed or flaky, with both times."""
    usable = events.where((F.col("kind") == "summary") & F.col("status").isin(*RUNNER_STATES) & F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    return usable.groupBy("bundle_id", "label").agg(F.max_by(F.struct("status", "start_time", "end_time"), "seq").alias("runner_report"))


def attach_runner_report(targets: DataFrame, summaries: DataFrame) -> DataFrame:
    """J1"""
    return targets.join(summaries, ["bundle_id", "label"], "left")


def attach_attempts(files: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases of Bazel attempt files with the attempt's label, number and times; files that
    couldn't be read have no case and drop out."""
    bazel = F.struct("label", F.col("attempt").alias("attempt_number"), F.col("start_time").alias("started_at"), F.col("end_time").alias("finished_at"))
    f = files.select("bundle_id", F.col("file").alias("file_path"), bazel.alias("bazel"))
    return cases.join(f, ["bundle_id", "file_path"])


def uncached(targets: DataFrame) -> DataFrame:
    """F1"""
    return targets.where(~F.col("cached"))


def xml_file_counts(targets: DataFrame) -> DataFrame:
    """A3: all and cached attempt files of each bundle."""
    n = F.size("xml_files")
    return targets.groupBy("bundle_id").agg(F.sum(n).alias("num_files"), F.sum(F.when(F.col("cached"), n).otherwise(0)).alias("num_cached"))


def prefer_internal(files: DataFrame) -> DataFrame:
    """a bundle's internal report alone if it has one, else its XML files; `problem` where
    there is more than one internal report."""
    w = Window.partitionBy("bundle_id")
    rows = files.withColumn("_any", F.max("is_internal").over(w)).withColumn("_n", F.count_if("is_internal").over(w))
    return rows.where(F.col("is_internal") | ~F.col("_any")).withColumn("problem", F.col("_n") > 1).drop("_any", "_n")


def union_sources(plain: DataFrame, bazel: DataFrame, xcode: DataFrame) -> DataFrame:
    """Files of all sources; a bundle with several Bazel sources is marked."""
    out = plain.withColumn("source", F.lit("junit")).unionByName(bazel.withColumn("source", F.lit("bazel")), allowMissingColumns=True)
    out = out.unionByName(xcode.withColumn("source", F.lit("xcresult")), allowMissingColumns=True)
    if "bep_path" not in out.columns:
        return out
    several = out.where("source = 'bazel'").groupBy("bundle_id").agg((F.countDistinct("bep_path") > 1).alias("several_bazel"))
    return out.join(several, "bundle_id", "left").fillna(False, ["several_bazel"])
