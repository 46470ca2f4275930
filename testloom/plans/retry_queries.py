"""Failures after retries, quarantine and summaries, over the view `runs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testloom.functions.ids import failure_id
from testloom.functions.times import millis
from testloom.operators import quarantine as Q
from testloom.plans.adapters import IDS, ORG, QUARANTINE, REPO, view
from testloom.plans.registry import query


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "runs")
    return r.withColumn("test_id", failure_id(F.lit(ORG), F.lit(REPO), F.coalesce("file", F.lit("")), F.col("classname"), F.col("parent_name"), F.col("name"), F.col("raw_id"), F.lit(""))).withColumn("time_ms", millis(F.col("case_ts")))


def quarantine_list(ids: DataFrame) -> DataFrame:
    return ids.where(F.substring(F.md5("test_id"), 1, 1).isin("0", "1", "2", "3")).select("bundle_id", "test_id").distinct()


FAILED = "failed as materialized (select *, row_number() over (partition by bundle_id, test_id order by time_ms desc, seq desc) as rn from ids where status = 'FAILURE')"
PASSED = "passed as (select bundle_id, test_id, max(time_ms) as success_ms from ids where status = 'SUCCESS' group by 1, 2)"
LEFT = "left_over as materialized (select f.* from failed f left join passed p using (bundle_id, test_id) where rn = 1 and (success_ms is null or success_ms <= time_ms))"
SPLIT = "split as materialized (select l.*, q.test_id is not null as quarantined from left_over l left join quarantine q on q.bundle_id = l.bundle_id and q.test_id = l.test_id)"
ALL = f"with {IDS}, {QUARANTINE}, {FAILED}, {PASSED}, {LEFT}, {SPLIT}"


@query("A4_latest_failures", "runs", f"with {IDS}, {FAILED} select bundle_id, test_id, seq, time_ms, message from failed where rn = 1")
def latest_failures(spark, sf_dir):
    return Q.latest_failures(runs(spark, sf_dir)).select("bundle_id", "test_id", "seq", "time_ms", "message")


@query("A5_latest_successes", "runs", f"with {IDS}, {PASSED} select * from passed")
def latest_successes(spark, sf_dir):
    return Q.latest_successes(runs(spark, sf_dir))


@query("A6_failed_tests", "runs", f"{ALL} select bundle_id, test_id, seq, time_ms, parent_name, name, file, message from left_over")
def failed_tests(spark, sf_dir):
    return Q.failed_tests(runs(spark, sf_dir)).select("bundle_id", "test_id", "seq", "time_ms", "parent_name", "name", "file", "message")


@query("J3_drop_recovered", "runs", f"{ALL} select bundle_id, test_id, seq from left_over")
def drop_recovered(spark, sf_dir):
    r = runs(spark, sf_dir)
    return Q.drop_recovered(Q.latest_failures(r), Q.latest_successes(r)).select("bundle_id", "test_id", "seq")


def split(spark, sf_dir):
    r = runs(spark, sf_dir)
    return Q.split_quarantined(Q.failed_tests(r), quarantine_list(r))


@query("J4_split_quarantined", "runs", f"{ALL} select bundle_id, test_id, seq, quarantined from split")
def split_quarantined(spark, sf_dir):
    return split(spark, sf_dir).select("bundle_id", "test_id", "seq", "quarantined")


@query("J5_flag_quarantined", "runs", f"with {IDS}, {QUARANTINE} select seq, ids.test_id, q.test_id is not null as is_quarantined from ids left join quarantine q on q.bundle_id = ids.bundle_id and q.test_id = ids.test_id")
def flag_quarantined(spark, sf_dir):
    r = runs(spark, sf_dir)
    return Q.flag_quarantined(r, quarantine_list(r)).select("seq", "test_id", "is_quarantined")


#: Three versions of each bundle's list, over the time of its runs; every version has members of its own.
VERSIONS = """span as (select bundle_id, min(time_ms) as t0, max(time_ms) - min(time_ms) as d from ids group by 1),
  versions as (select bundle_id, t0 + (d // 4) * k as list_ms, test_id from span join (select distinct bundle_id, test_id from ids) using (bundle_id), (values (1, '0'), (2, '4'), (3, '8')) v(k, c)
    where substr(md5(test_id), k, 1) >= c)"""


@query("J5_flag_quarantined_as_of", "runs", f"""with {IDS}, {VERSIONS}, x as (select ids.bundle_id, seq, ids.test_id, max(l.list_ms) as list_ms from ids left join (select distinct bundle_id, list_ms from versions) l on l.bundle_id = ids.bundle_id and l.list_ms <= ids.time_ms group by all)
  select seq, x.list_ms, v.test_id is not null as is_quarantined from x left join versions v on v.bundle_id = x.bundle_id and v.list_ms = x.list_ms and v.test_id = x.test_id""")
def flag_quarantined_as_of(spark, sf_dir):
    r = runs(spark, sf_dir)
    span = r.groupBy("bundle_id").agg(F.min("time_ms").alias("t0"), (F.max("time_ms") - F.min("time_ms")).alias("d"))
    tests = r.select("bundle_id", "test_id").distinct().join(span, "bundle_id")
    member = F.array_compact(F.array(*(F.when(F.substring(F.md5("test_id"), k, 1) >= c, F.lit(k)) for k, c in ((1, "0"), (2, "4"), (3, "8")))))
    versions = tests.withColumn("k", F.explode(member)).select("bundle_id", (F.col("t0") + F.floor(F.col("d") / 4) * F.col("k")).alias("list_ms"), "test_id")
    return Q.flag_quarantined_as_of(r, versions).select("seq", "list_ms", "is_quarantined")


@query(
    "J6_is_quarantined", "runs",
    f"""with {IDS}, {QUARANTINE}, sw as (select distinct bundle_id, bundle_id % 7 = 0 as d from runs where bundle_id % 11 <> 0)
    select seq, q.test_id is not null as listed, coalesce(d, false) as disabled, d is null as lookup_failed, q.test_id is not null and coalesce(not d, false) as effective
    from ids left join quarantine q on q.bundle_id = ids.bundle_id and q.test_id = ids.test_id left join sw on sw.bundle_id = ids.bundle_id""",
)
def is_quarantined(spark, sf_dir):
    r = runs(spark, sf_dir)
    switch = r.where("bundle_id % 11 <> 0").select("bundle_id").distinct().withColumn("is_disabled", F.col("bundle_id") % 7 == 0)
    return Q.is_quarantined(r, quarantine_list(r), switch).select("seq", "listed", "disabled", "lookup_failed", "effective")


COUNTS = "counts as (select bundle_id, t.total, count_if(not quarantined) as failed, count_if(quarantined) as quarantined from (select bundle_id, count(*) as total from runs group by 1) t left join split using (bundle_id) group by 1, 2)"


@query(
    "A10_upload_summary", "runs",
    f"""{ALL}, {COUNTS} select bundle_id, total, failed, quarantined, greatest(0, total - failed - quarantined) as passed,
    printf('%.1f%%', round(100.0 * greatest(0, total - failed - quarantined) / total, 1)) as pass_ratio from counts""",
)
def upload_summary(spark, sf_dir):
    totals = runs(spark, sf_dir).groupBy("bundle_id").agg(F.count("*").alias("total"))
    parts = split(spark, sf_dir).groupBy("bundle_id").agg(F.count_if(~F.col("quarantined")).alias("failed"), F.count_if("quarantined").alias("quarantined"))
    return Q.upload_summary(totals.join(parts, "bundle_id", "left").fillna(0, ["failed", "quarantined"]))


@query(
    "A11_quarantine_verdict", "runs",
    f"""{ALL}, b as (select distinct bundle_id, case when bundle_id % 3 = 0 then null else 1 end as exit_code, bundle_id % 7 = 0 as off from runs),
    c as (select b.bundle_id, any_value(exit_code) as exit_code, any_value(off) as off, count(s.test_id) as total, count_if(s.quarantined) as nq from b left join split s on s.bundle_id = b.bundle_id group by 1)
    select bundle_id, total, case when off then 0 else nq end as n_quarantined, not off and total = nq as group_is_quarantined,
      cast(case when off then coalesce(exit_code, 0) when total = nq and total > 0 then 0 else coalesce(exit_code, case when total > 0 then 1 else 0 end) end as int) as exit_code from c""",
)
def quarantine_verdict(spark, sf_dir):
    bundles = runs(spark, sf_dir).select("bundle_id").distinct().select("bundle_id", F.when(F.col("bundle_id") % 3 != 0, F.lit(1)).alias("exit_code"), (F.col("bundle_id") % 7 == 0).alias("is_disabled"), F.lit(False).alias("no_files"))
    return Q.quarantine_verdict(bundles, split(spark, sf_dir))


@query(
    "A12_query_result", "runs",
    """select bundle_id, parent_name, case when skipped = 0 then 'DISABLED' when k = 0 then 'FAILURE' when k = 1 then 'SKIPPED' when k = 2 then 'SUCCESS' else 'UNSPECIFIED' end as query_result
    from (select bundle_id, parent_name, count_if(status = 'FAILURE') % 4 as k, count_if(status = 'SKIPPED') as skipped from runs group by all)""",
)
def query_result(spark, sf_dir):
    """The outcome told by a suite's numbers of failed and skipped runs."""
    k = F.count_if(F.col("status") == "FAILURE") % 4
    fetch = F.when(k == 0, F.lit("FAILED")).when(k == 1, F.lit("SKIPPED")).when(k == 2, F.lit("SUCCEEDED"))
    return view(spark, sf_dir, "runs").groupBy("bundle_id", "parent_name").agg(Q.query_result(F.count_if(F.col("status") == "SKIPPED") == 0, fetch).alias("query_result"))


@query("F2_runner_gate", "runs", "select seq from runs where case k3 when 0 then null when 1 then 'FAILED' else 'PASSED' end is null or k3 = 1".replace("from runs", "from (select *, seq % 3 as k3 from runs)"))
def runner_gate(spark, sf_dir):
    k = F.col("seq") % 3
    files = view(spark, sf_dir, "runs").withColumn("runner_status", F.when(k == 1, F.lit("FAILED")).when(k == 2, F.lit("PASSED")))
    return Q.runner_gate(files).select("seq")


@query(
    "L3_failure_groups", "runs",
    f"""{ALL}, g as (select *, coalesce(nullif(file, ''), nullif(parent_name, ''), 'Other') as failure_group from left_over),
    h as (select bundle_id, failure_group, name, seq, row_number() over (partition by bundle_id, failure_group order by name, seq) as place, greatest(count(*) over (partition by bundle_id, failure_group) - 3, 0) as more from g)
    select * from h where place <= 3""",
)
def failure_groups(spark, sf_dir):
    return Q.failure_groups(Q.failed_tests(runs(spark, sf_dir))).select("bundle_id", "failure_group", "name", "seq", "place", "more")
