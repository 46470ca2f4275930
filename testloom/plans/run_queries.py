"""Run building, texts and roll-ups, over `runs`, `documents` and `cases_t`."""

from __future__ import annotations

from pyspark.sql import functions as F

from testloom.functions import text as T
from testloom.functions.ids import run_id, test_id
from testloom.functions.times import legal_seconds, parsed_time
from testloom.operators import rollups as R
from testloom.operators import runs as B
from testloom.plans.adapters import IDS, ORG, REPO, duck_base, duck_uuid5, view
from testloom.plans.registry import query


def cases(spark, sf_dir):
    """The view `runs` in the shape of parsed cases; a suite is a bundle's parent name."""
    r = view(spark, sf_dir, "runs")
    none = F.lit(None).cast("string")
    return r.select(
        "seq", "bundle_id", F.lit("f.xml").alias("file_path"), F.col("parent_name").alias("suite_pos"), F.col("seq").alias("case_pos"), "parent_name", "name", "classname", "raw_id", "line", "attempt_number", "status", "message",
        F.when(F.col("seq") % 3 == 0, F.lit("told")).alias("description"), F.when(F.col("seq") % 5 == 0, F.lit("out")).alias("system_out"), none.alias("system_err"), F.lit("suite out").alias("suite_system_out"), none.alias("suite_system_err"),
        F.when(F.col("seq") % 2 == 0, F.col("case_ts")).alias("case_ts"), F.when(F.col("seq") % 3 == 0, F.col("case_ts")).alias("suite_ts"), F.col("time_s").alias("case_time"), F.when(F.col("seq") % 2 == 0, F.lit(2.5)).alias("suite_time"),
        F.col("file").alias("case_file"), none.alias("case_filepath"), F.when(F.col("seq") % 2 == 0, F.lit("suite.rb")).alias("suite_file"), none.alias("suite_filepath"),
    )


TIMES = """t as (select *, coalesce(case when seq % 2 = 0 then case_ts end, case when seq % 3 = 0 then case_ts end) as st, coalesce(time_s, case when seq % 2 = 0 then 2.5 end) as sec from runs),
u as (select *, coalesce(st, case when sec is not null then timestamp '1970-01-01' end) as started from t),
w as (select *, case when sec is not null then make_timestamp(epoch_us(started) + cast(round(sec * 1e6) as bigint)) end as finished from u)"""


@query("P2_run_times", "runs", f"with {TIMES} select seq, epoch_us(started) as started_us, epoch_us(finished) as finished_us from w")
def run_times(spark, sf_dir):
    return B.with_run_times(cases(spark, sf_dir)).select("seq", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"))


@query(
    "P3_status_output", "runs",
    """select seq, case when status = 'SUCCESS' then '' when seq % 3 = 0 then 'told' else coalesce(message, '') end as status_output_message,
    status <> 'SUCCESS' and (message is not null or seq % 3 = 0 or seq % 5 = 0) as has_output from runs""",
)
def status_output(spark, sf_dir):
    return B.with_status_output(cases(spark, sf_dir)).select("seq", "status_output_message", F.col("test_output").isNotNull().alias("has_output"))


@query(
    "P4_inherited_output", "runs",
    """select seq, case when status = 'FAILURE' and count(*) over (partition by bundle_id, parent_name, name, classname) = 1 then case when seq % 5 = 0 then 'out' else 'suite out' end when seq % 5 = 0 then 'out' end as system_out from runs""",
)
def inherited_output(spark, sf_dir):
    return B.with_inherited_output(cases(spark, sf_dir).withColumn("suite_pos", F.concat_ws("/", "parent_name", "name", "classname"))).select("seq", "system_out")


@query("P5_file", "runs", "select seq, coalesce(file, case when seq % 2 = 0 then 'suite.rb' end) as run_file, coalesce(case when seq % 2 = 0 then 'suite.rb' end, file) as bindings_file from runs")
def file_rules(spark, sf_dir):
    return cases(spark, sf_dir).select("seq", B.resolved_file().alias("run_file"), B.resolved_file("bindings").alias("bindings_file"))


@query("P6_line_attempt", "runs", "select seq, try_cast(line as int) as line_number, try_cast(attempt_number as int) as attempt_index from runs")
def line_attempt(spark, sf_dir):
    return B.with_line_attempt(cases(spark, sf_dir)).select("seq", "line_number", "attempt_index")


@query("P1_test_case_runs", "runs", f"""with {TIMES}, x as (select *, coalesce(file, case when seq % 2 = 0 then 'suite.rb' end, '') as f from w),
  y as (select * exclude (file), f as file from x)
  select seq, file, status, coalesce(raw_id, '') as raw_id, coalesce(raw_id, {duck_base()}) as test_id, epoch_us(started) as started_us, epoch_us(finished) as finished_us, try_cast(line as int) as line_number from y""")
def test_case_runs(spark, sf_dir):
    return B.to_test_case_runs(cases(spark, sf_dir), ORG, F.lit(REPO)).select("seq", "file", "status", "raw_id", "test_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), "line_number")


FIRST = duck_base("raw_id").replace("'JUNIT_TESTCASE'", "'JUNIT_TESTCASE', 'v' || cast(seq % 3 as varchar)").replace(f"'{REPO}', raw_id", f"'{REPO}', raw_id, 'v' || cast(seq % 3 as varchar)")


@query("P9_test_ids", "runs", f"""with a as (select *, {FIRST} as first_id from runs)
  select seq, {duck_base('raw_id')} as test_id, coalesce(raw_id, {duck_base()}) as run_id, {duck_uuid5("first_id || '#v' || cast(seq % 3 as varchar)")} as variant_id from a""")
def test_ids(spark, sf_dir):
    key = (F.lit(ORG), F.lit(REPO), F.coalesce("file", F.lit("")), F.col("classname"), F.col("parent_name"), F.col("name"), F.col("raw_id"))
    variant = F.concat(F.lit("v"), (F.col("seq") % 3).cast("string"))
    return view(spark, sf_dir, "runs").select("seq", test_id(*key).alias("test_id"), run_id(*key, F.lit("")).alias("run_id"), test_id(*key, variant).alias("variant_id"))


@query("P7_timestamps", "runs", """select seq, case when seq % 4 = 3 then null when seq % 4 = 0 then epoch_us(case_ts) when seq % 4 = 1 then epoch_us(date_trunc('day', case_ts)) else epoch_us(case_ts) + 587000 - 12600000000 end as micros from runs""")
def timestamps(spark, sf_dir):
    k, t = F.col("seq") % 4, F.col("case_ts")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd")).when(k == 2, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".587+03:30"))).otherwise(F.lit("not a date"))
    return view(spark, sf_dir, "runs").select("seq", F.unix_micros(parsed_time(text)).alias("micros"))


@query("P8_truncate_text", sql="""with d as (select doc_id, regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as t from documents),
  c as (select doc_id, t, unnest(range(0, 4)) as back from d),
  k as (select doc_id, any_value(t) as t, max(case when octet_length(encode(left(t, n))) <= 100 then n end) as n from (select doc_id, t, unnest(range(0, 101)) as n from d) group by doc_id)
  select doc_id, left(t, n) as cut from k""")
def truncate_text(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.truncated(F.coalesce("text", F.lit("")), 100).alias("cut"))


@query("P15_bazel_package", "bep", "select seq, regexp_extract(label, '^//([^:]*):', 1) as package from bep")
def bazel_package(spark, sf_dir):
    return view(spark, sf_dir, "bep").select("seq", B.bazel_package(F.col("label")).alias("package"))


@query("J10_owner_path", "runs", "select seq, coalesce(nullif(file, ''), parent_name || '/p') as path from runs")
def owner_path(spark, sf_dir):
    label = F.concat(F.lit("//"), F.col("parent_name"), F.lit("/p:t"))
    return view(spark, sf_dir, "runs").select("seq", B.owner_path(F.col("file"), label, True).alias("path"))


@query("P17_rspec_runs", "runs", """select seq, replace(regexp_replace('./' || coalesce(file, 'spec/a_spec.rb'), '\\.[^/.]+$', ''), '/', '.')[3:] as classname, parent_name,
  case when seq % 4 = 0 then case when seq % 3 = 0 then 'FAILURE' else 'SUCCESS' end when seq % 4 = 1 then 'FAILURE' when seq % 4 = 2 then 'SKIPPED' else 'UNSPECIFIED' end as status,
  coalesce(message, '') as message, case when seq % 2 = 0 then 'trunk:' || name || '-' || classname else '' end as raw_id from runs""")
def rspec_runs(spark, sf_dir):
    k = F.col("seq") % 4
    rows = view(spark, sf_dir, "runs").select(
        "seq", F.col("name").alias("id"), F.col("classname").alias("location"), (F.col("seq") % 2 == 0).alias("description_generated"), "name", F.concat(F.lit("./"), F.coalesce("file", F.lit("spec/a_spec.rb"))).alias("file"), "parent_name",
        F.when(k == 0, F.lit("passed")).when(k == 1, F.lit("failed")).when(k == 2, F.lit("pending")).otherwise(F.lit("?")).alias("status"), (F.col("seq") % 3 == 0).alias("quarantined"), F.concat(F.lit("\x1b[31m"), "message", F.lit("\x1b[0m")).alias("message"),
    )
    return B.normalize_rspec_runs(rows).select("seq", "classname", "parent_name", "status", "message", "raw_id")


@query("P21_failure_message_lines", sql="""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
  x as (select doc_id, len(l) as n, unnest(l[1:20]) as line, unnest(range(1, least(20, len(l)) + 1)) as i from l),
  y as (select doc_id, n, i, replace(replace(line, chr(9), '    '), chr(13), '') as line from x)
  select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where i = 1 or regexp_matches(line, '[^\\s\\p{Z}]')), '') as shown, cast(greatest(any_value(n) - 20, 0) as int) as omitted from y group by doc_id""")
def message_lines(spark, sf_dir):
    shown, omitted = T.failure_message_lines(F.col("text"))
    return view(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, "\n").alias("shown"), omitted.alias("omitted"))


@query("F6_legal_seconds", "runs", "select seq, case when seq % 4 = 0 then null when seq % 4 = 1 and time_s > 0 then null else time_s end as seconds from runs")
def seconds(spark, sf_dir):
    k = F.col("seq") % 4
    text = F.when(k == 0, F.lit("Infinity")).when((k == 1) & (F.col("time_s") > 0), F.concat(F.lit("-"), F.col("time_s").cast("string"))).otherwise(F.col("time_s").cast("string"))
    return view(spark, sf_dir, "runs").select("seq", legal_seconds(text).alias("seconds"))


@query("A7_suite_rollup", "runs", f"""with {TIMES} select bundle_id, parent_name, count(*) as tests, count_if(status = 'SKIPPED') as skipped, count_if(status = 'FAILURE') as failures, cast(0 as bigint) as errors,
  epoch_us(max(started)) as started_us, round(coalesce(sum((epoch_us(finished) - epoch_us(started)) / 1e6), 0), 3) as seconds from w group by 1, 2""")
def suite_rollup(spark, sf_dir):
    out = R.suite_rollup(B.with_run_times(cases(spark, sf_dir)))
    return out.withColumn("started_us", F.unix_micros("started_at")).withColumn("seconds", F.round("seconds", 3)).drop("started_at")


@query("A8_report_rollup", "runs", f"""with {TIMES} select bundle_id, count(*) as tests, count_if(status = 'FAILURE') as failures, round(coalesce(sum((epoch_us(finished) - epoch_us(started)) / 1e6), 0), 3) as seconds from w group by 1""")
def report_rollup(spark, sf_dir):
    return R.report_rollup(R.suite_rollup(B.with_run_times(cases(spark, sf_dir)))).withColumn("seconds", F.round("seconds", 3))


@query("A9_bundle_counts", "runs", "select bundle_id, count(distinct coalesce(file, '')) as num_files, count(*) as num_tests from runs group by 1")
def bundle_counts(spark, sf_dir):
    return R.bundle_counts(view(spark, sf_dir, "runs").withColumn("file_path", F.coalesce("file", F.lit(""))))


@query("S12_S14_nested_report", "runs", "select seq, bundle_id, name, status, file from runs")
def nested_report(spark, sf_dir):
    return R.flat_report(R.nested_report(view(spark, sf_dir, "runs").select("bundle_id", "seq", "name", "status", "file").withColumn("run_seq", F.col("seq")))).select(F.col("run_seq").alias("seq"), "bundle_id", "name", "status", "file")
