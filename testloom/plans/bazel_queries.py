"""Bazel events over `bep`."""

from __future__ import annotations

from pyspark.sql import functions as F

from testloom.operators import bazel as B
from testloom.plans.adapters import view
from testloom.plans.registry import query

KNOWN = "case when status in ('PASSED', 'FLAKY', 'TIMEOUT', 'FAILED', 'INCOMPLETE', 'REMOTE_FAILURE', 'FAILED_TO_BUILD', 'TOOL_HALTED_BEFORE_TESTING') then status else 'NO_STATUS' end"
TARGETS = f"""t as materialized (select bundle_id, label, arg_min(cached, seq) as cached, arg_max({KNOWN}, seq) as build_status, cast(max(attempt) - 1 as int) as max_attempt,
  count_if(uri like '%.xml') as n, coalesce(string_agg(replace(uri, 'file://', ''), ',' order by seq) filter (where uri like '%.xml'), '') as files from bep where kind = 'result' group by 1, 2)"""
RESULT = "case build_status when 'PASSED' then 'SUCCESS' when 'FLAKY' then 'FLAKY' when 'NO_STATUS' then 'UNSPECIFIED' else 'FAILURE' end"
SUMMARY = "s as (select bundle_id, label, arg_max(status, seq) as status, arg_max(start_time, seq) as st from bep where kind = 'summary' and status in ('PASSED', 'FAILED', 'FLAKY') and end_time is not null group by 1, 2)"


def targets(spark, sf_dir):
    return B.merge_targets(view(spark, sf_dir, "bep"))


@query("A1_A2_merge_targets", "bep", f"with {TARGETS} select bundle_id, label, cached, build_status, max_attempt, files from t")
def merge(spark, sf_dir):
    return targets(spark, sf_dir).select("bundle_id", "label", "cached", "build_status", "max_attempt", F.array_join("xml_files", ",").alias("files"))


@query("A3_xml_file_counts", "bep", f"with {TARGETS} select bundle_id, cast(sum(n) as bigint) as num_files, cast(sum(case when cached then n else 0 end) as bigint) as num_cached from t group by 1")
def counts(spark, sf_dir):
    return B.xml_file_counts(targets(spark, sf_dir))


@query("F1_uncached", "bep", f"with {TARGETS} select bundle_id, label from t where not cached")
def uncached(spark, sf_dir):
    return B.uncached(targets(spark, sf_dir)).select("bundle_id", "label")


@query("J1_attach_runner_report", "bep", f"with {TARGETS}, {SUMMARY} select t.bundle_id, t.label, s.status, epoch_us(s.st) as start_us from t left join s on s.bundle_id = t.bundle_id and s.label = t.label")
def runner(spark, sf_dir):
    out = B.attach_runner_report(targets(spark, sf_dir), B.runner_summaries(view(spark, sf_dir, "bep")))
    return out.select("bundle_id", "label", F.col("runner_report.status").alias("status"), F.unix_micros("runner_report.start_time").alias("start_us"))


@query("J2_attach_attempts", "bep", "select seq, label, cast(attempt - 1 as int) as attempt_number from bep where kind = 'result' and uri like '%.xml' and seq % 2 = 0")
def attempts(spark, sf_dir):
    b = view(spark, sf_dir, "bep")
    cases = b.where("seq % 2 = 0").select("bundle_id", "seq", F.regexp_replace("uri", "^file://", "").alias("file_path"))
    return B.attach_attempts(B.xml_files(b), cases).select("seq", F.col("bazel.label").alias("label"), F.col("bazel.attempt_number").alias("attempt_number"))


@query("J11_build_result", "bep", f"with {TARGETS} select bundle_id, label, {RESULT} as build_result from t")
def result(spark, sf_dir):
    return targets(spark, sf_dir).select("bundle_id", "label", "build_result")


@query("F3_prefer_internal", "bep", """with f as (select *, bundle_id % 3 = 0 and seq % 50 = bundle_id as internal from bep), g as (select *, max(internal) over (partition by bundle_id) as a, count_if(internal) over (partition by bundle_id) as n from f)
  select seq, n > 1 as problem from g where internal or not a""")
def internal(spark, sf_dir):
    b = view(spark, sf_dir, "bep")
    return B.prefer_internal(b.withColumn("is_internal", (F.col("bundle_id") % 3 == 0) & (F.col("seq") % 50 == F.col("bundle_id")))).select("seq", "problem")


@query("U1_union_sources", "bep", "select seq, case seq % 3 when 0 then 'junit' when 1 then 'bazel' else 'xcresult' end as source, bundle_id % 2 = 1 as several_bazel from bep")
def union(spark, sf_dir):
    b = view(spark, sf_dir, "bep").select("bundle_id", "seq", "uri")
    k = F.col("seq") % 3
    bazel = b.where(k == 1).withColumn("bep_path", F.when(F.col("bundle_id") % 2 == 1, (F.col("seq") % 2).cast("string")).otherwise(F.lit("b")))
    return B.union_sources(b.where(k == 0), bazel, b.where(k == 2)).select("seq", "source", "several_bazel")
