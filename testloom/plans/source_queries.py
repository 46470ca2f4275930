"""Scans of files that are written from the views first, so each is a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from testloom.functions.steps import shared_folder
from testloom.plans.adapters import ORG, REPO, duck_uuid5, view
from testloom.plans.registry import query
from testloom.sources import bep as E
from testloom.sources import junit as X
from testloom.sources import uploads as U


ROUND_TRIP = """select parent_name, name, classname, coalesce(file, '') as file, status, epoch_us(case_ts) as case_us, time_s, message, count(*) as n
  from (select parent_name, name, classname, file, case when status = 'UNSPECIFIED' then 'SUCCESS' else status end as status, case_ts, time_s, case when status = 'FAILURE' then message end as message from runs) group by all"""


def junit_lines(spark, sf_dir):
    return X.junit_xml_lines(view(spark, sf_dir, "runs").withColumn("raw_id", F.lit(None).cast("string")))


@query("S1_scan_junit", "runs", ROUND_TRIP)
def scan_junit(spark, sf_dir):
    path = shared_folder(spark)
    X.write_junit(junit_lines(spark, sf_dir), path)
    return round_trip(X.scan_junit(spark, path))


def round_trip(out):
    return out.groupBy("parent_name", "name", "classname", F.coalesce("case_file", F.lit("")).alias("file"), "status", F.unix_micros("case_ts").alias("case_us"), F.col("case_time").alias("time_s"), "message").agg(F.count("*").alias("n"))


@query("S1_reports_of_any_shape", "runs", f"""with shaped as (select bundle_id, parent_name, name, seq, status from runs) select bundle_id, parent_name, name, case when status = 'UNSPECIFIED' then 'SUCCESS' else status end as status,
  row_number() over (partition by bundle_id order by first, parent_name, seq) as place from (select *, min(seq) over (partition by bundle_id, parent_name) as first from shaped)""")
def reports_of_any_shape(spark, sf_dir):
    """A file for each bundle: byte order mark, prolog, comment and DOCTYPE, and suites bare, in one report or in a report each; cases in document order."""
    path = shared_folder(spark)
    inner = F.regexp_replace("value", "^<testsuites>|</testsuites>$", "")
    in_reports = F.regexp_replace(F.regexp_replace(inner, "<testsuite ", "<testsuites><testsuite "), "</testsuite>", "</testsuite></testsuites>")
    body = F.when(F.col("bundle_id") % 3 == 0, inner).when(F.col("bundle_id") % 3 == 1, F.col("value")).otherwise(in_reports)
    heads = ["", "\ufeff", '<?xml version="1.0"?>\n<!-- two\nlines <testsuites> -->', "<!DOCTYPE testsuites [<!ELEMENT a (b)>]>"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("bundle_id") % 4 + 1).cast("int"))
    X.write_junit(junit_lines(spark, sf_dir).withColumn("value", F.concat(F.when(F.col("value").startswith("<testsuites>"), head).otherwise(""), body)), path)
    out = X.scan_junit(spark, f"{path}/*")
    return out.select(F.regexp_extract("file_path", r"bundle_id=(\d+)", 1).cast("long").alias("bundle_id"), "parent_name", "name", "status", F.col("seq").alias("place"))


BEP = """select cast(bundle_id as varchar) as bundle_id, kind, label, attempt, status, cached, epoch_us(start_time) as start_us, case when kind = 'result' and uri like '%.xml' then uri end as uri, count(*) as n
  from (select bundle_id, kind, label, case when kind = 'result' then attempt else 0 end as attempt, status, kind = 'result' and cached as cached, start_time, uri from bep) group by all"""


@query("S3_scan_bep", "bep", BEP)
def scan_bep(spark, sf_dir):
    return bep_rows(E.scan_bep(spark, bep_files(spark, sf_dir)))


def bep_files(spark, sf_dir):
    path = shared_folder(spark)
    b = view(spark, sf_dir, "bep")
    stamp = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.when(
        F.col("kind") == "result",
        F.to_json(F.struct(
            F.struct(F.struct("label", F.lit(1).alias("run"), F.lit(1).alias("shard"), "attempt").alias("testResult")).alias("id"),
            F.struct("status", F.col("cached").alias("cachedLocally"), stamp.alias("testAttemptStart"), F.lit("3s").alias("testAttemptDuration"), F.array(F.struct(F.regexp_extract("uri", "[^/]*$", 0).alias("name"), "uri")).alias("testActionOutput")).alias("testResult"),
        )),
    ).otherwise(F.to_json(F.struct(F.struct(F.struct("label").alias("testSummary")).alias("id"), F.struct(F.col("status").alias("overallStatus"), stamp.alias("firstStartTime")).alias("testSummary"))))
    b.select("bundle_id", event.alias("value")).repartition(20, "bundle_id").write.partitionBy("bundle_id").text(path)
    return path


def bep_rows(out):
    return out.groupBy("bundle_id", "kind", "label", "attempt", "status", "cached", F.unix_micros("start_time").alias("start_us"), "uri").agg(F.count("*").alias("n"))


@query("S13_write_bep_events", "bep", BEP)
def write_bep(spark, sf_dir):
    """The events of a scan, written again and scanned again."""
    path = shared_folder(spark)
    E.write_bep_events(E.scan_bep(spark, bep_files(spark, sf_dir)), path)
    return bep_rows(E.scan_bep(spark, path))


#: Files with faults: text, level and messages.
FAULTY = (
    ("no root here", 1, "no_report"), ("<testsuites/><testsuites/>", 2, "reports"), ("<testsuites><testsuite></testsuites>", 3, ""), ('<testsuites><testsuite name="s">', 1, "no_report"),
    ('<testsuites><testsuite name="s"><testcase classname="c"/><testcase name=" "></testcase></testsuite></testsuites>', 2, "name", "name"),
    ('<testsuites><testcase name="t"/><testsuite name="s"></testsuite></testsuites>', 2, "suite"),
    ('<testsuites><testsuite name="s"><testcase name="a"><testcase name="b"/></testcase></testsuite></testsuites>', 2, "case_end"),
    ('<testsuite name="s"><failure/><testcase name="a"><rerunError><flakyFailure/></rerunError></testcase><rerunFailure/></testsuite>', 2, "status", "rerun", "rerun_end"),
    ('<testsuites><testsuite name="s"/><testsuites/></testsuites>', 2, "report_end"),
    ('<testsuites><testsuite name="s"><testcase name="t"/><!-- <failure/> --></testsuite></testsuites>', 0),
    ('<testsuite name="s"/><testsuites/><testsuite name="t"/><testsuite name="u"/>', 2, "reports"),
)


@query("S2_scan_junit_issues", "runs", f"with f as (select distinct parent_name, name, bundle_id, (bundle_id + length(parent_name) + length(name)) % {len(FAULTY)} as k from runs), m as (select * from (values "
       + ", ".join(f"({k}, {level}, '{X.ISSUES.get(m, 'could not parse XML')}')" for k, (_, *found) in enumerate(FAULTY) for level in found[:1] for m in found[1:]) + ") v(k, level, error_message)) select level, error_message, count(*) as n from f join m using (k) group by 1, 2")
def scan_junit_issues(spark, sf_dir):
    """A file for each test of each bundle, sound or with faults."""
    path = shared_folder(spark)
    kinds = F.create_map(*(F.lit(x) for k, (text, *_) in enumerate(FAULTY) for x in (k, text)))
    files = view(spark, sf_dir, "runs").select("parent_name", "name", "bundle_id").distinct()
    text = kinds[((F.col("bundle_id") + F.length("parent_name") + F.length("name")) % len(FAULTY)).cast("int")]
    files.repartition(20, "bundle_id").select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return X.scan_junit_issues(spark, path).groupBy("level", "error_message").agg(F.count("*").alias("n"))


@query("S5_discover_files", "runs", """with d as (select distinct bundle_id, parent_name as a, name as b from runs),
  f as (select bundle_id, a as x from d group by all union all select bundle_id, a || '/' || b from d)
  select cast(bundle_id as varchar) as bundle, count(*) as num_files, cast(count(*) - 1 as int) as last_place from f group by 1""")
def discover(spark, sf_dir):
    """Files two and five folders below a bundle's folder, one a folder."""
    path = shared_folder(spark)
    r = view(spark, sf_dir, "runs").select("bundle_id", F.col("parent_name").alias("a"), F.col("name").alias("b"))
    r.select("bundle_id", "a").distinct().withColumn("value", F.lit("x")).repartition("bundle_id", "a").write.partitionBy("bundle_id", "a").text(path)
    deep = r.distinct().withColumns({"c": F.lit(1), "d": F.lit(2), "value": F.lit("x")})
    deep.repartition("bundle_id", "a", "b").write.mode("append").partitionBy("bundle_id", "a", "b", "c", "d").text(path)
    out = U.discover_files(spark, [path], names=("*.txt",), bundle=r"/bundle_id=(\d+)/")
    return out.groupBy("bundle").agg(F.count("*").alias("num_files"), F.max(F.regexp_extract("bundled_path", r"(\d+)$", 1).cast("int")).alias("last_place"))


@query("S5_discover_globs", "runs", """with f as (select distinct cast(bundle_id as varchar) as bundle, parent_name as a, name as b, (length(name) + bundle_id) % 4 as kind from runs)
  select 0 as set_pos, bundle, count(*) as n from f where kind = 0 group by all union all select 1, bundle, count(*) from f where kind = 1 and a = 'click' group by all union all select 2, bundle, count(*) from f where kind in (0, 1) and b like 'test_1_' group by all""")
def discover_globs(spark, sf_dir):
    """Folders at any depth, names with wildcards and sets of characters, files of several sets, other names."""
    path = shared_folder(spark)
    files = view(spark, sf_dir, "runs").select("bundle_id", F.col("parent_name").alias("a"), F.col("name").alias("b")).distinct()
    kind = (F.length("b") + F.col("bundle_id")) % 4
    for k, name in enumerate(("x.xml", "y.xml.txt")):
        rows = files.where(kind == k).withColumn("value", F.lit("x"))
        rows.repartition(8, "bundle_id").write.partitionBy("bundle_id", "a", "b").text(f"{path}/{name}")
    out = U.discover_files(spark, [f"{path}/x.xml/**/part-*.txt", f"{path}/y*/*/a=[b-d]lick/**", f"{path}/**/b=test_1?/*.t[!a]t"], names=("*.txt",), bundle=r"/bundle_id=(\d+)/")
    return out.groupBy("set_pos", "bundle").agg(F.count("*").alias("n"))


#: Runs of the table, of all bundles, that are uploaded together as result trees.
TREE_SEQ = 100_000


@query("S10_scan_xcresult", "runs", """select bundle_id, 'Unit.' || parent_name as parent_name, name, classname, case when status = 'UNSPECIFIED' then 'SUCCESS' else status end as status,
  case when status = 'FAILURE' then message end as message, count(*) as n from runs group by all""")
def scan_xcresult(spark, sf_dir):
    """A result tree for each bundle and TREE_SEQ runs of the table, a suite for each parent: more runs are more trees, not larger ones."""
    path = shared_folder(spark)
    node = "struct<name: string, nodeType: string>"
    said = F.when(F.col("message").isNotNull(), F.array(F.struct(F.col("message").alias("name"), F.lit("Failure Message").alias("nodeType")).cast(node)))
    result = F.when(F.col("status") == "FAILURE", F.lit("Failed")).when(F.col("status") == "SKIPPED", F.lit("Skipped")).otherwise(F.lit("Passed"))
    case = F.struct("name", F.lit("Test Case").alias("nodeType"), F.concat_ws("/", "classname", "name").alias("nodeIdentifier"), result.alias("result"), F.lit("1s").alias("duration"), said.alias("children"))
    suites = view(spark, sf_dir, "runs").groupBy("bundle_id", F.floor(F.col("seq") / TREE_SEQ).alias("part"), "parent_name").agg(F.collect_list(case).alias("children")).select("bundle_id", "part", F.struct(F.col("parent_name").alias("name"), F.lit("Test Suite").alias("nodeType"), "children").alias("s"))
    unit = suites.groupBy("bundle_id", "part").agg(F.struct(F.lit("Unit").alias("name"), F.lit("Unit test bundle").alias("nodeType"), F.collect_list("s").alias("children")).alias("u"))
    plan = F.struct(F.col("bundle_id").cast("string").alias("name"), F.lit("Test Plan").alias("nodeType"), F.array("u").alias("children"))
    unit.select(F.to_json(F.struct(F.array(plan).alias("testNodes"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = U.scan_xcresult_tests(spark, path, ORG, REPO)
    return out.groupBy(F.col("plan_name").cast("long").alias("bundle_id"), "parent_name", "name", "classname", "status", "message").agg(F.count("*").alias("n"))


@query("S11_scan_runner_logs", "runs", "select cast(bundle_id as varchar) as runner, 'job-' || max(seq) as job_id from runs group by 1")
def scan_runner_logs(spark, sf_dir):
    """Three logs for each bundle: the newest has no id, the one before has its runs from the last on, the oldest from the first on."""
    path = shared_folder(spark)
    said = F.lit("[2024 INFO JobRunner] Job ID job-")
    for order in (F.array_sort, lambda c: F.sort_array(c, asc=False), None):
        lines = F.lit("nothing") if order is None else F.array_join(F.transform(order(F.collect_list("seq")), lambda n: F.concat(said, n.cast("string"), F.lit(" begins"))), "\n")
        logs = view(spark, sf_dir, "runs").groupBy("bundle_id").agg(F.concat(F.lit("started\n"), lines).alias("value"))
        logs.repartition("bundle_id").write.mode("append").partitionBy("bundle_id").text(path)
    return U.scan_runner_logs(spark, path).select(F.regexp_extract("runner_dir", r"bundle_id=(\d+)", 1).alias("runner"), "job_id")


LEGACY = """lg as (select distinct concat('id', cast(seq % 40 as varchar)) as identifier, 'test://' || name as identifier_url, parent_name as suite_name, name as case_name, case when seq % 40 < 15 then 'My ' || name || '.swift' end as file_name from runs),
  fb as (select parent_name as target, 'suite/' || parent_name as file from runs where parent_name <> 'click' group by parent_name union all select 'click.' || name, 'case/' || name from runs group by name)"""


@query("J12_xcresult_legacy", "runs", f"""with {LEGACY}, o as (select lg.identifier, identifier_url, coalesce(replace(file_name, ' ', '%20'), a.file, b.file) as file from lg left join fb a on a.target = suite_name left join fb b on b.target = suite_name || '.' || case_name),
  u as (select identifier, min(identifier_url) as url from o group by 1), m as (select u.identifier, url, min(file) as file from u join o on o.identifier = u.identifier and o.identifier_url = u.url group by 1, 2)
  select seq, {duck_uuid5(f"'{ORG}#{REPO}#' || url")} as raw_id, m.file as case_file from runs join m on m.identifier = concat('id', cast(seq % 40 as varchar))""")
def xcresult_legacy(spark, sf_dir):
    r = view(spark, sf_dir, "runs").withColumn("identifier", F.concat(F.lit("id"), (F.col("seq") % 40).cast("string")))
    name = F.when(F.col("seq") % 40 < 15, F.concat(F.lit("My "), "name", F.lit(".swift")))
    none = F.lit(None).cast("string")
    legacy = r.select("identifier", F.concat(F.lit("test://"), "name").alias("identifier_url"), F.col("parent_name").alias("suite_name"), F.col("name").alias("case_name"), name.alias("file_name"), none.alias("location"), F.array().cast("array<string>").alias("frames")).distinct()
    suites = r.where("parent_name != 'click'").select(F.col("parent_name").alias("target"), F.concat(F.lit("suite/"), "parent_name").alias("file")).distinct()
    fallback = suites.unionByName(r.select(F.concat(F.lit("click."), "name").alias("target"), F.concat(F.lit("case/"), "name").alias("file")).distinct())
    return U.xcresult_legacy(r.select("seq", "identifier"), legacy, fallback, ORG, REPO).select("seq", "raw_id", "case_file")
