"""Uploaded folders: bundle metadata, report files, worker logs, Xcode result trees, nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from testloom.functions.ids import uuid5
from testloom.functions.times import legal_seconds
from testloom.operators.rollups import flat_report, nested_report
from testloom.sources.listing import first_match, knows, list_files

# Names of files that may be uploaded, and the ending of those that bundles leave out.
NAMES = ("*.xml", "*.junit", "*.bin")
UNBUNDLED = ".junit"
# Where a job id stands in a worker's log.
JOB_ID = r"INFO JobRunner\] Job ID (\S+)"
JOB_ID_JSON = r'"jobId"\s*:\s*"([^"]+)"'

REPO = """struct<repo: struct<host: string, owner: string, name: string>, repo_root: string, repo_url: string, repo_head_sha: string, repo_head_sha_short: string,
  repo_head_branch: string, repo_head_commit_epoch: bigint, repo_head_commit_message: string, repo_head_author_name: string, repo_head_author_email: string>"""
TEST = "struct<name: string, parent_name: string, class_name: string, file: string, id: string, timestamp_millis: bigint, is_quarantined: boolean, failure_message: string, variant: string>"
FILE = "struct<original_path: string, original_path_rel: string, path: string, owners: array<string>, team: string>"
META = f"""version string, cli_version string, org string, repo {REPO}, bundle_upload_id string, tags array<struct<key: string, value: string>>,
  file_sets array<struct<file_set_type: string, files: array<{FILE}>, glob: string>>, envs map<string, string>, upload_time_epoch bigint, test_command string, os_info string,
  quarantined_tests array<{TEST}>, codeowners struct<path: string>, use_uncloned_repo boolean, num_files bigint, num_tests bigint, command_line string,
  bundle_upload_id_v2 string, variant string, internal_bundled_file {FILE}, failed_tests array<{TEST}>"""


def schema_version(has_v2: Column, has_failed: Column, has_command: Column, has_counts: Column) -> Column:
    """The newest version whose required fields are there; later optional fields may be absent."""
    return F.when(has_counts & has_command & has_v2 & has_failed, F.lit("0.7.8")).when(has_counts & has_command & has_v2, F.lit("0.7.7")).when(has_counts & has_command, F.lit("0.6.2")).when(has_counts, F.lit("0.5.34")).otherwise(F.lit("0.5.29"))


def _fields() -> dict[str, str]:
    """Names and types of the fields in META."""
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(META).fields}


def scan_bundle_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files of any version in one schema, with schema_version, unknown and nulls.

    A file is an object or an array of objects. `unknown`: JSON of the fields no version
    has, with their types, null without any; `nulls`: known fields that are there as null.
    A file that isn't JSON gives a row of nulls.
    """
    rows, known = spark.read.text(path, wholetext=True), _fields()
    others = [c for c in rows.columns if c != "value"]  # of partitioned folders
    value = F.try_parse_json("value")
    rows = rows.select(*others, F.explode(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))).alias("v"))
    rows = rows.select(*others, F.try_variant_get("v", "$", f"struct<{', '.join(f'{k}: {t}' for k, t in known.items())}>").alias("m"), F.try_variant_get("v", "$", "map<string, variant>").alias("fields"))
    unknown = F.map_filter("fields", lambda k, _: ~k.isin(*known))
    nulls = F.array_sort(F.map_keys(F.map_filter("fields", lambda k, v: k.isin(*known) & F.is_variant_null(v))))
    rows = rows.select("m.*", *others, F.when(F.size(unknown) > 0, F.to_json(unknown)).alias("unknown"), F.coalesce(nulls, F.array().cast("array<string>")).alias("nulls"))
    return rows.withColumn("schema_version", schema_version(F.col("bundle_upload_id_v2").isNotNull(), F.col("failed_tests").isNotNull(), F.col("command_line").isNotNull(), F.col("num_files").isNotNull() & F.col("num_tests").isNotNull()))


def bundle_meta_json() -> Column:
    """A scanned row as JSON again: known fields, those that were null, and unknown ones as they were."""
    known = F.to_json(F.struct(*_fields()))
    nulls = F.array_join(F.transform("nulls", lambda n: F.concat(F.lit('"'), n, F.lit('":null'))), ",")
    parts = F.array(F.substring(known, F.lit(2), F.length(known) - 2), nulls, F.substring("unknown", F.lit(2), F.length("unknown") - 2))
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p != ""), ","), F.lit("}"))


def discover_files(spark: SparkSession, globs: list[str], start: str | None = None, names: tuple[str, ...] = NAMES, bundle: str = "") -> DataFrame:
    """Report files of each glob: set_pos, path, modified, bundle, is_internal, bundled_path.

    `**` stands for any number of folders. If nothing that can be bundled is found, globs are
    taken as folders and files of `names` at any depth below them are found, a set for each
    folder and name. Files of other names, and files older than the run's start, are left
    out. Files of one bundle and kind are numbered in order of their sets and paths; a file of
    two sets is bundled twice, and one of an allowed name that bundles don't take (`.junit`) has a
    row without bundled_path. Contents aren't read, and tasks list the folders. `bundle` is a
    pattern whose first group in a path is its bundle. Without it all files are one.
    """
    allowed = "|".join("(?:" + n.replace(".", r"\.").replace("*", "[^/]*") + "$)" for n in names)

    def found(which: list[str]) -> DataFrame:
        rows = list_files(spark, which).where(F.col("path").rlike(allowed))
        return rows.where(F.col("modified") >= F.lit(start).cast("timestamp")) if start else rows

    bundled = ~F.col("path").endswith(UNBUNDLED)
    rows = found(globs)
    if rows.where(bundled).isEmpty():
        rows = found([f"{g.rstrip('/')}/**/{n}" for g in globs for n in names if not n.endswith(UNBUNDLED)])
    rows = rows.withColumn("bundle", F.regexp_extract("path", bundle, 1) if bundle else F.lit("")).withColumn("is_internal", F.col("path").endswith(".bin"))
    place = F.count_if(bundled).over(Window.partitionBy("bundle", "is_internal").orderBy("set_pos", F.split("path", "/"))) - 1
    return rows.select("set_pos", "path", "modified", "bundle", "is_internal", F.when(bundled, F.concat(F.when(F.col("is_internal"), F.lit("internal/")).otherwise(F.lit("junit/")), place.cast("string"))).alias("bundled_path"))


def scan_runner_logs(spark: SparkSession, path: str) -> DataFrame:
    """runner_dir, job_id, bytes_read: of each runner's folder the newest log with an id, its first line with one.

    Logs are ranked by their times before any is read; a task opens a folder's logs newest
    first and stops at the first id. Of logs of one time the later name comes first. Folders
    without an id have no row. A store that only the JVM can open is read as a whole.
    """
    glob = f"{path.rstrip('/')}/**"
    runner = F.regexp_replace("file", r"/(?:_diag/)?[^/]*$", "").alias("runner_dir")
    if knows(glob):
        files = list_files(spark, [glob]).where(~F.regexp_extract("path", "[^/]*$", 0).rlike("^[._]")).withColumnRenamed("path", "file")
        newest = F.transform(F.sort_array(F.collect_list(F.struct("modified", "file")), asc=False), lambda x: x["file"])
        logs = files.select(runner, "modified", "file").groupBy("runner_dir").agg(newest.alias("files"))
        found = logs.mapInArrow(first_match(f"{JOB_ID}|{JOB_ID_JSON}"), "runner_dir string, job_id string, bytes_read long")
        return found.where("job_id != ''")
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.octet_length("value").alias("size"), F.posexplode(F.split("value", "\n")).alias("line_number", "line"))
    first, second = F.regexp_extract("line", JOB_ID, 1), F.regexp_extract("line", JOB_ID_JSON, 1)
    found = rows.withColumn("job_id", F.trim(F.when(first != "", first).otherwise(second))).where("job_id != ''")
    return found.groupBy(runner).agg(F.max_by("job_id", F.struct("modified", "file", -F.col("line_number"))).alias("job_id"), F.sum("size").cast("long").alias("bytes_read"))


_LEAF = "name: string, nodeType: string, nodeIdentifier: string, result: string, duration: string"


def _node(depth: int) -> str:
    return f"struct<{_LEAF}>" if depth == 0 else f"struct<{_LEAF}, children: array<{_node(depth - 1)}>>"


def _leaf_of(c: Column) -> Column:
    """A case with what is read of it: its own fields, its children and theirs."""
    leaf = [x.split(":")[0] for x in _LEAF.split(", ")]
    kid = lambda k: F.struct(*(k[x].alias(x) for x in leaf), F.transform(k["children"], lambda g: F.struct(*(g[x].alias(x) for x in leaf))).alias("children"))
    return F.struct(*(c[x].alias(x) for x in leaf), F.transform(c["children"], kid).alias("children"))


# Kinds of nodes and the name of a suite that has none.
BUNDLES = ("Unit test bundle", "UI test bundle")
DEFAULT_SUITE = "swift"


def scan_xcresult_tests(spark: SparkSession, path: str, org: str, repo: str, default_suite: str = DEFAULT_SUITE) -> DataFrame:
    """Cases of Xcode result trees: plan, suite (`bundle.suite`), case, status, message, time, id, failed repetitions as reruns.

    A tree is read once and is one value in its task. Its cases become one array of small
    structs, and only that is exploded: no case carries the suite it comes from.
    """
    trees = spark.read.schema(f"testNodes array<{_node(5)}>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("file_path"), "testNodes")
    none = F.expr(f"cast(array() as array<struct<plan_name: string, top_pos: int, pos: int, case_pos: int, parent_name: string, c: {_node(2)}>>)")

    def each(nodes: Column, f) -> Column:
        """The arrays that f gives for the nodes and their places, one after the other."""
        return F.flatten(F.transform(F.coalesce(nodes, F.array()), lambda n, i: F.coalesce(f(n, i), none)))

    def found(plan: Column, top_pos: Column, pos: Column, parent_name: Column, cases: Column, place=None) -> Column:
        kept = F.transform(cases, lambda c, i: F.struct(plan["name"].alias("plan_name"), top_pos.alias("top_pos"), pos.alias("pos"), (i if place is None else place).alias("case_pos"), parent_name.alias("parent_name"), _leaf_of(c).alias("c")))
        return F.filter(kept, lambda x: x["c"]["nodeType"] == "Test Case")

    def in_suite(plan: Column, t: Column, i: Column):
        return lambda n, j: F.when(n["nodeType"] == "Test Suite", found(plan, i, j, F.concat_ws(".", t["name"], n["name"]), n["children"])).when(
            n["nodeType"] == "Test Case", found(plan, i, F.lit(1 << 30), F.coalesce(t["name"], F.lit(default_suite)), F.array(n), j))

    def in_plan(plan: Column):
        return lambda t, i: F.when(t["nodeType"].isin(*BUNDLES), each(t["children"], in_suite(plan, t, i))).when(t["nodeType"] == "Test Suite", found(plan, i, F.lit(0), t["name"], t["children"]))

    cases = each(F.col("testNodes"), lambda p, _: F.when(p["nodeType"] == "Test Plan", each(p["children"], in_plan(p))))
    rows = trees.select("file_path", F.inline(cases))
    c = F.col("c")
    result = c["result"]
    status = F.when(result.isin("Passed", "Expected Failure"), F.lit("SUCCESS")).when(result == "Failed", F.lit("FAILURE")).when(result == "Skipped", F.lit("SKIPPED"))
    kids = F.coalesce(c["children"], F.array())

    def said(nodes: Column) -> Column:
        texts = F.transform(F.filter(nodes, lambda k: k["nodeType"] == "Failure Message"), lambda k: k["name"])
        return F.nullif(F.array_join(texts, "\n"), F.lit(""))

    def seconds(node: Column) -> Column:
        return legal_seconds(F.replace(node["duration"], F.lit("s"), F.lit("")))

    failed = F.filter(kids, lambda k: (k["nodeType"] == "Repetition") & (k["result"] == "Failed") & (status != "SKIPPED"))
    reruns = F.transform(failed, lambda k: F.struct(said(k["children"]).alias("message"), seconds(k).alias("time")))
    return rows.select(
        "file_path", "plan_name", "top_pos", "pos", "case_pos", "parent_name", c["name"].alias("name"), F.element_at(F.split(c["nodeIdentifier"], "/"), 1).alias("classname"), c["nodeIdentifier"].alias("identifier"),
        status.alias("status"), F.when(status == "FAILURE", said(kids)).alias("message"), seconds(c).alias("case_time"),
        F.size(failed).alias("num_reruns"), reruns.alias("reruns"), uuid5(F.concat_ws("#", F.lit(org), F.lit(repo), c["nodeIdentifier"])).alias("raw_id"),
    ).where("status is not null")


def xcresult_legacy(cases: DataFrame, legacy: DataFrame, fallback: DataFrame, org: str, repo: str) -> DataFrame:
    """Stable ids from legacy identifier URLs, and source files.

    legacy: identifier, identifier_url, suite_name, case_name, file_name, location, frames (paths of
    the first failure's stack). fallback: target (suite, or `Suite.case`), file. A file comes from the
    failure, else its location, else the stack's last Swift or Objective-C frame, else the
    fallback by suite, else by `Suite.case`. Of several legacy rows the smallest URL counts.
    """
    source = F.try_element_at(F.filter("frames", lambda f: f.rlike(r"\.(?:swift|m)$")), F.lit(-1))
    own = F.replace(F.coalesce("file_name", "location", source), F.lit(" "), F.lit("%20"))
    by_suite = fallback.select(F.col("target").alias("suite_name"), F.col("file").alias("_suite_file"))
    by_case = fallback.select(F.col("target").alias("_case_key"), F.col("file").alias("_case_file"))
    rows = legacy.withColumn("own", own).withColumn("_case_key", F.concat_ws(".", "suite_name", "case_name")).join(by_suite, "suite_name", "left").join(by_case, "_case_key", "left")
    found = rows.groupBy("identifier").agg(F.min(F.struct("identifier_url", F.coalesce("own", "_suite_file", "_case_file").alias("file"))).alias("x"))
    out = cases.join(found, "identifier", "left")
    name = F.concat_ws("#", F.lit(org), F.lit(repo), F.coalesce("x.identifier_url", "identifier"))
    return out.withColumn("raw_id", uuid5(name)).withColumn("case_file", F.col("x.file")).drop("x")


def write_test_report(runs: DataFrame, path: str, targets: DataFrame | None = None) -> None:
    """One nested report per bundle, as Parquet."""
    nested_report(runs, targets).write.parquet(path)


def read_test_report(spark: SparkSession, path: str) -> DataFrame:
    """The runs of nested reports."""
    return flat_report(spark.read.parquet(path))
