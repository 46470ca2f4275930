"""Values the operators must give, as literals."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from testloom.functions import ids, text, times
from testloom.operators import ci, owners, quarantine, validation
from testloom.sources import codeowners, junit, uploads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_id_without_variant(spark):
    key = [F.lit(v) for v in ("example_org", "example_repo", "src/lib.rs", "ExampleClass", "parent/fact/path", "example_name")]
    assert one(spark, ids.test_id(*key)) == "06cb6db5-f807-5198-b072-af67a0636f8a"
    own = "08e1c642-3a55-45cf-8bf9-b9d0b21785dd"  # version 4: ignored
    assert one(spark, ids.test_id(*key, F.lit(own))) == "06cb6db5-f807-5198-b072-af67a0636f8a"
    assert one(spark, ids.test_id(*key, F.lit("06cb6db5-f807-5198-b072-af67a0636f8a"))) == "06cb6db5-f807-5198-b072-af67a0636f8a"


@pytest.mark.parametrize(
    ("value", "micros"),
    [
        ("not a date", None), ("2024", None), ("2024-01-09T16:52:28.443565", 1704819148443565), ("2024-01-09", 1704758400000000), ("2024-07-23T14:12:17.587Z", 1721743937587000),
        ("2024-07-23T14:40:59+00:00", 1721745659000000), ("2025-09-25T14:52:32.774867-07:00", 1758837152774867), ("2025-09-25T21:36:24.602-07:00", 1758861384602000), ("2025-09-25T21:36:24.602567+03:30", 1758823584602567),
    ],
)
def test_dates(spark, value, micros):
    assert one(spark, F.unix_micros(times.parsed_time(F.lit(value)))) == micros


@pytest.mark.parametrize("value", ["", "  ab  ", "aé", " é€😀x ", "😀😀😀", "éé", "a" * 12])
@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7, 8])
def test_byte_cut(spark, value, limit):
    want = value.strip()
    while len(want.encode()) > limit:
        want = want[:-1]
    assert one(spark, text.truncated(F.lit(value), limit)) == want


@pytest.mark.parametrize(("value", "seconds"), [("1.5", 1.5), ("-1", None), ("NaN", None), ("Infinity", None), ("x", None), (None, None)])
def test_legal_seconds(spark, value, seconds):
    assert one(spark, times.legal_seconds(F.lit(value).cast("string"))) == seconds


def test_retry_rule(spark):
    rows = [("b", "t1", "FAILURE", 10, 1), ("b", "t1", "SUCCESS", 20, 2), ("b", "t2", "FAILURE", 20, 3), ("b", "t2", "SUCCESS", 20, 4), ("b", "t3", "FAILURE", 5, 5), ("b", "t3", "FAILURE", 5, 6), ("b", "t4", "SKIPPED", 9, 7)]
    runs = spark.createDataFrame(rows, "bundle_id string, test_id string, status string, time_ms long, seq long")
    assert sorted((r.test_id, r.seq) for r in quarantine.failed_tests(runs).collect()) == [("t2", 3), ("t3", 6)]
    again = quarantine.drop_recovered(quarantine.latest_failures(runs), quarantine.latest_successes(runs))
    assert sorted((r.test_id, r.seq) for r in again.collect()) == [("t2", 3), ("t3", 6)]


GITHUB = """# comment
*       @global-owner1 @global-owner2
*.js    @js-owner
*.go docs@example.com
/build/logs/ @doctocat
docs/*  docs@example.com
apps/ @octocat
/docs/ @doctocat
"""


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("foo.txt", ["@global-owner1", "@global-owner2"]), ("foo/bar.txt", ["@global-owner1", "@global-owner2"]), ("foo.js", ["@js-owner"]), ("foo/bar.js", ["@js-owner"]), ("foo/bar.go", ["docs@example.com"]),
        ("build/logs/foo.go", ["@doctocat"]), ("build/logs/foo/bar.go", ["@doctocat"]), ("foo/build/logs/foo.go", ["docs@example.com"]), ("foo/docs/foo.js", ["docs@example.com"]), ("foo/bar/docs/foo/foo.js", ["@js-owner"]),
        ("foo/apps/foo.js", ["@octocat"]), ("./foo/apps/foo.js", ["@octocat"]), ("docs/foo.js", ["@doctocat"]), ("./docs/foo.js", ["@doctocat"]),
    ],
)
def test_github_owners(spark, path, want):
    files = spark.createDataFrame([("f", GITHUB)], "codeowners_id string, content string")
    paths = spark.createDataFrame([("f", path)], "codeowners_id string, path string")
    assert owners.owners_github(paths, codeowners.scan_codeowners_github(files)).first().owners == want


def test_gitlab_rules(spark):
    content = "* @a\n\\#file.rb @pound\nREADME\\ x/ @sp me@x.com\n[Docs] @d\ndocs\n^[Opt]\n*.md\n[docs]\ndocs @e\n"
    rules = codeowners.scan_codeowners_gitlab(spark.createDataFrame([("f", content)], "codeowners_id string, content string")).orderBy("rule_pos").collect()
    assert [(r.section, r.pattern, r.owners) for r in rules] == [("codeowners", "/**/*", ["@a"]), ("codeowners", "/**/#file.rb", ["@pound"]), ("codeowners", "/**/README x/**/*", ["me@x.com", "@sp"]), ("Docs", "/**/docs", ["@e"]), ("Opt", "/**/*.md", [])]


def test_literals_of_patterns_only_save_work(spark):
    """Owners are the same when every rule's regex meets every path."""
    patterns = ["*", "**", "*.JS", "/Docs/", "src/**/x", "a[b-d]efgh", "?ile.txt", "/x/*", "**/deep/**", "./y", "UP/low*", "m[!a]n.md", "logs", "a+b(c).txt"]
    files = spark.createDataFrame([("f", "\n".join(f"{p} @o{n}" for n, p in enumerate(patterns)))], "codeowners_id string, content string")
    paths = ["q.js", "docs/a", "src/1/2/x", "src/x", "acefgh", "abefgh/z", "File.txt", "x/1", "x/1/2", "u/deep/v", "./y", "y", "up/LOWER", "mbn.md", "man.md", "logs/1", "a+b(c).txt", "none", "", "Σ/ς"]
    rows = spark.createDataFrame([("f", p) for p in paths], "codeowners_id string, path string")
    for rules, find in ((codeowners.scan_codeowners_github(files), owners.owners_github), (codeowners.scan_codeowners_gitlab(files), owners.owners_gitlab)):
        got = sorted(find(rows, rules).collect())
        assert len(got) == len(paths) and got == sorted(find(rows, rules.drop("pattern")).collect())
    assert len({tuple(r.owners) for r in owners.owners_github(rows, codeowners.scan_codeowners_github(files)).collect()}) > 5


def test_indexed_rules_equal_all_rules_on_random_patterns(spark):
    """Under every key or under none, 200 random rules a file give 1,000 random paths the same owners."""
    draw = random.Random(7)
    words = ["a", "b", "src", "Lib", "x.js", "m.tar.gz", ".git", "t[", "é", "a b", "..", ""]
    globs = ["*", "**", "*.js", "*.GZ", "?", "a*", "*b", "[ab]", "[!a]", "s?c", "t[a/b]", "*.t?r.gz", "]", "***"]
    files, paths = [], []
    for n in range(2):
        lines = []
        for at in range(200):
            # the second file has sound globs only, whose rules GitHub keeps
            known = [[w for w in some if n == 0 or w not in ("t[", "]", "***")] for some in (words, globs)]
            parts = [draw.choice(known[draw.random() < 0.2]).replace(" ", "\\ ") for _ in range(draw.randint(2, 4))]
            text = draw.choice(["", "", "/", "./", "//"]) + "/".join(parts) + draw.choice(["", "", "/", "/**", "/*"])
            lines.append(("" if at % 50 else f"^[S{at}]\n") + f"{text} @o{at}")
        files.append((f"f{n}", "\n".join(lines)))
        paths += [(f"f{n}", draw.choice(["", "", "/", "./", "././", ".//"]) + "/".join(draw.choice([*words, "SRC", "cab", "q.js"]) for _ in range(draw.randint(1, 6))) + draw.choice(["", "", "\n", "/"])) for _ in range(500)]
    files, rows = spark.createDataFrame(files, "codeowners_id string, content string"), spark.createDataFrame(paths, "codeowners_id string, path string")
    for rules, find in ((codeowners.scan_codeowners_github(files), owners.owners_github), (codeowners.scan_codeowners_gitlab(files), owners.owners_gitlab)):
        rules = rules.cache()
        got = sorted(find(rows, rules).collect())
        assert len({tuple(r.owners) for r in got}) > 10 and got == sorted(find(rows, rules.drop("pattern")).collect())


def test_unsound_globs(spark):
    """An open class or a `**` inside a part: no rules of that file in one dialect, no match in the other; classes hold no `/`."""
    files = spark.createDataFrame([("ok", "a[]b]c @1\nz[!x]/q @2\nm[z-a]n @3\nk[a-c&-]l @4\n"), ("open", "* @all\nt[ @1\n"), ("stars", "* @all\na**b @1\n")], "codeowners_id string, content string")
    paths = ["a]c", "abc", "axc", "zy/q", "zx/q", "mzn", "k-l", "k&l", "kbl", "kdl"]
    rows = spark.createDataFrame([*(("ok", p) for p in paths), ("open", "t["), ("stars", "ab")], "codeowners_id string, path string")
    for scan, find in ((codeowners.scan_codeowners_github, owners.owners_github), (codeowners.scan_codeowners_gitlab, owners.owners_gitlab)):
        got = {(r.codeowners_id, r.path): r.owners for r in find(rows, scan(files)).collect()}
        want = {"a]c": ["@1"], "abc": ["@1"], "zy/q": ["@2"], "k-l": ["@4"], "k&l": ["@4"], "kbl": ["@4"]}
        gitlab = find is owners.owners_gitlab
        assert {p: o for (f, p), o in got.items() if f == "ok" and o} == want
        assert got.get(("open", "t[")) == got.get(("stars", "ab")) == (["@all"] if gitlab else None)


def test_codeowners_errors(spark):
    content = "[] @x\n^[S][2] @x\n[T] nobody\n[unclosed\n*.rb nobody\n*.go @ok\n"
    found = codeowners.codeowners_errors(spark.createDataFrame([("f", content)], "codeowners_id string, content string")).collect()
    assert {(r.line_number, r.error) for r in found} >= {(0, "missing section name"), (1, "invalid approval requirement"), (3, "invalid section format"), (4, "invalid entry owner format")}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://github.com/user/repository.git", ("github.com", "user", "repository")), ("git@gitlab.com:a/b/c.git", ("gitlab.com", "a/b", "c")), ("ssh://git@host:22/o/r/", ("host:22", "o", "r")), ("nope", (None, None, None)),
    ],
)
def test_repo_urls(spark, url, want):
    r = ci.parse_repo_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.host, r.owner, r.name) == want


def test_platform_order(spark):
    def of(*keys):
        return one(spark, ci.detect_platform(F.create_map(*(x for k in keys for x in (F.lit(k), F.lit("1"))))))

    assert of("GITHUB_ACTIONS", "CUSTOM") == "CUSTOM"
    assert of("BUILD_ID", "TRIGGER_NAME") == "TRIGGER_NAME"
    assert of("X") == "UNKNOWN"


NESTED = """<testsuites name="r"><testsuite name="outer" timestamp="2024-01-09"><testsuite name="inner"><testsuite name="deep"><testcase name="a" classname="A"/></testsuite>
<testcase name="b" time="1.5"><failure message="m">text &lt;x&gt;</failure></testcase></testsuite></testsuite></testsuites>"""


def test_junit_scan(spark, tmp_path):
    (tmp_path / "a.xml").write_text(NESTED)
    (tmp_path / "b.xml").write_text('<testsuite name="bare"><testcase name="c"><skipped/></testcase></testsuite>')
    (tmp_path / "c.xml").write_text("no reports here!")
    (tmp_path / "d.xml").write_text("<testsuites")
    (tmp_path / "e.xml").write_text("")
    rows = {(r.parent_name, r.name): r for r in junit.scan_junit(spark, str(tmp_path)).collect()}
    assert set(rows) == {("outer", "a"), ("outer", "b"), ("bare", "c")}
    b = rows["outer", "b"]
    assert (b.status, b.message, b.description, b.case_time) == ("FAILURE", "m", "text <x>", 1.5)
    assert rows["bare", "c"].status == "SKIPPED"
    found = {(r.file_path[-5:], r.error_message) for r in junit.scan_junit_issues(spark, str(tmp_path)).collect()}
    assert ("c.xml", "no reports found") in found and ("e.xml", "no reports found") in found


def test_junit_issues_follow_the_order_of_elements(spark, tmp_path):
    """A row for each place; comments, quoted texts and CDATA hold no elements."""
    rerun = "<rerunError><stackTrace>x</stackTrace></rerunError>"
    files = {
        "a": ('<?xml version="1.0"?><!DOCTYPE testsuites [<!ELEMENT x (y)>]><testsuites><testsuite><testcase note=\' name="q" \' name="a > b"><![CDATA[<failure>]]><error/>' + rerun + "</testcase></testsuite></testsuites>", []),
        "b": ("<testsuites><skipped/><testsuite><testcase note=' name=\"q\" '/><testcase name=''/><testcase name='t'/></testsuite></testsuites>", ["test case status found without a test case found"] + 2 * ["could not parse test case name"]),
        # the case outside stays open, so the status after it has a case
        "c": ("<testsuites><testcase name='t'/><failure/></testsuites>", ["test case found without a test suite found"]),
        "d": (f"<testsuite><testcase name='t'/>{rerun}<testcase name='u'><rerunError><rerunError/></rerunError></testcase></testsuite>", ["test rerun end tag found without start tag", "test rerun found without a test case found"]),
        "e": ("<testsuites><testsuite><testcase name='t'></testsuite></testsuites>", ["could not parse XML"]),
        "f": ("<testsuites", ["could not parse XML"]),
        "g": ("<testsuites><testsuite><testcase/></testsuite>", ["could not parse test case name", "no reports found"]),
        "h": ("<testsuite/><testsuite/>", []),
        "i": ("<testsuite/><testsuites/><testsuite/>", ["multiple reports found"]),
        "j": ("</testsuites>", ["could not parse XML"]),
        "k": ("", ["no reports found"]),
        "l": ("a < b", ["could not parse XML"]),
        "m": ("<html><body/></html>", ["no reports found"]),
        "n": (f"<testsuite {'x' * 50000} note='{'<' * 50000}'><failure/></testsuite>", ["test case status found without a test case found"]),
    }
    for name, (text, _) in files.items():
        (tmp_path / f"{name}.xml").write_text(text)
    found = {}
    for r in junit.scan_junit_issues(spark, str(tmp_path)).collect():
        found.setdefault(r.file_path[-5], []).append(r.error_message)
    assert found == {name: want for name, (_, want) in files.items() if want}


def test_junit_scan_of_deep_suites(spark, tmp_path):
    """Cases at any depth belong to the outermost suite; text that only looks like a tag stays."""
    xml = '<testcase name="z"/>'
    for k in range(12, 0, -1):
        xml = f'<testsuite name="s{k}" note="a > b"><testsuite name="e"/><!-- <testsuite> --><testcase name="c{k}"><system-out><![CDATA[<testsuite name="no">]]></system-out></testcase>{xml}</testsuite>'
    (tmp_path / "a.xml").write_text(f"<testsuites>{xml}<testsuite name='flat'><testcase name='f'/></testsuite></testsuites>")
    (tmp_path / "b.xml").write_text(f"<testsuites>{xml.removesuffix('</testsuite>')}</testsuites>")
    rows = junit.scan_junit(spark, str(tmp_path)).collect()
    assert sorted((r.parent_name, r.name) for r in rows) == sorted([("flat", "f"), ("s1", "z")] + [("s1", f"c{k}") for k in range(1, 13)])
    assert {r.system_out for r in rows if r.name.startswith("c")} == {'<testsuite name="no">'}
    assert {(r.file_path[-5:], r.level) for r in junit.scan_junit_issues(spark, str(tmp_path)).collect()} >= {("b.xml", 3)}


def test_junit_scan_keeps_the_order_of_statuses_and_reruns(spark, tmp_path):
    first = '<testcase name="a"><!-- <failure/> --><skipped message="s"/><failure message="f">x</failure></testcase><testcase name="b"><error message="e"/><failure message="f"/></testcase>'
    again = """<testcase name="c"><failure message="f"/><rerunError message="1" type="T" time="0.5" timestamp="2024-01-09T00:00:00Z"><stackTrace>at x</stackTrace><system-out>o</system-out></rerunError>
<rerunFailure message="2">why</rerunFailure><rerunError message="3"/></testcase><testcase name="d"><flakyFailure message="4"/><system-out><![CDATA[<error >]]></system-out></testcase>"""
    (tmp_path / "a.xml").write_text(f'<testsuites><testsuite name="s">{first}{again}</testsuite></testsuites>')
    (tmp_path / "b.xml").write_text('<testsuites><testsuite name="s"><testcase name="e"><rerunFailure message="z"/><rerunFailure message="y"/></testcase></testsuite></testsuites>')
    rows = {r.name: r for r in junit.scan_junit(spark, str(tmp_path)).collect()}
    assert {n: (r.status, r.message) for n, r in rows.items()} == {"a": ("SKIPPED", "s"), "b": ("FAILURE", "e"), "c": ("FAILURE", "f"), "d": ("SUCCESS", None), "e": ("SUCCESS", None)}
    assert [(r.kind, r.message, r.description) for r in rows["c"].reruns] == [("rerunError", "1", None), ("rerunFailure", "2", "why"), ("rerunError", "3", None)]
    one = rows["c"].reruns[0]
    assert (one.type, one.time, one.stack_trace, one.system_out, one.system_err, one.ts.year) == ("T", 0.5, "at x", "o", None, 2024)
    assert (rows["c"].num_reruns, rows["d"].num_flaky, rows["d"].system_out) == (3, 1, "<error >")
    assert [r.message for r in rows["e"].reruns] == ["z", "y"]


def test_runner_logs(spark, tmp_path):
    d = tmp_path / "runner" / "_diag"
    d.mkdir(parents=True)
    (d / "Worker_1.log").write_text('x\n[INFO JobRunner] Job ID abc-1\n "jobId": "zzz"\n')
    assert uploads.scan_runner_logs(spark, str(d)).first().job_id == "abc-1"


XCODE = """{"testNodes": [{"name": "Plan", "nodeType": "Test Plan", "children": [{"name": "Bundle", "nodeType": "Unit test bundle", "children": [
 {"name": "Suite", "nodeType": "Test Suite", "children": [{"name": "t1", "nodeType": "Test Case", "nodeIdentifier": "Suite/t1", "result": "Failed", "duration": "1.5s",
   "children": [{"name": "boom", "nodeType": "Failure Message"}, {"name": "r", "nodeType": "Repetition", "result": "Failed", "duration": "2s", "children": [{"name": "bang", "nodeType": "Failure Message"}]}]}]},
 {"name": "t2", "nodeType": "Test Case", "nodeIdentifier": "t2", "result": "Expected Failure"}]}]}]}"""


def test_xcode_tree(spark, tmp_path):
    (tmp_path / "x.json").write_text(XCODE)
    rows = {r.name: r for r in uploads.scan_xcresult_tests(spark, str(tmp_path), "o", "r").collect()}
    t = rows["t1"]
    assert (t.parent_name, t.status, t.message, t.case_time, t.num_reruns, t.classname) == ("Bundle.Suite", "FAILURE", "boom", 1.5, 1, "Suite")
    assert [tuple(r) for r in t.reruns] == [("bang", 2.0)]
    assert (rows["t2"].parent_name, rows["t2"].status, rows["t2"].reruns) == ("Bundle", "SUCCESS", [])


def test_xcode_cases_leave_their_suite(spark, tmp_path):
    """Cases of all three places, from one read; an exploded case carries no tree or suite."""
    case = {"nodeType": "Test Case", "result": "Passed"}
    suite = {"name": "S", "nodeType": "Test Suite", "children": [case | {"name": f"c{k}", "nodeIdentifier": f"S/c{k}"} for k in range(300)]}
    bundle = {"name": "B", "nodeType": "UI test bundle", "children": [case | {"name": "d", "nodeIdentifier": "d"}, suite, {"name": "E", "nodeType": "Test Suite"}]}
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"devices": [{"name": "x"}], "testNodes": [{"name": f"p{k}", "nodeType": "Test Plan", "children": [bundle, suite]}, {"name": "q", "nodeType": "Other", "children": [bundle]}]}))
    df = uploads.scan_xcresult_tests(spark, str(tmp_path), "o", "r")
    rows = {(r.plan_name, r.top_pos, r.pos, r.case_pos): (r.parent_name, r.name) for r in df.collect()}
    assert rows == {k: v for p in ("p0", "p1") for k, v in [((p, 0, 1 << 30, 0), ("B", "d")), *(x for i in range(300) for x in (((p, 0, 1, i), ("B.S", f"c{i}")), ((p, 1, 0, i), ("S", f"c{i}"))))]}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and plan.count("Generate ") == 1 and len(rows) == df.count()
    assert re.search(r"Generate inline\(.*\), \[file_path#\d+\], false", plan)


def test_xcode_legacy(spark):
    cases = spark.createDataFrame([("S/t1",), ("S/t2",), ("S/t3",)], "identifier string")
    legacy = spark.createDataFrame(
        [("S/t1", "u1", "S", "t1", None, None, ["a.c", "b/x y.swift", "z.h"]), ("S/t2", "u2", "S", "t2", None, None, [])],
        "identifier string, identifier_url string, suite_name string, case_name string, file_name string, location string, frames array<string>",
    )
    fallback = spark.createDataFrame([("S.t2", "f.swift")], "target string, file string")
    rows = {r.identifier: r for r in uploads.xcresult_legacy(cases, legacy, fallback, "o", "r").collect()}
    assert rows["S/t1"].case_file == "b/x%20y.swift" and rows["S/t2"].case_file == "f.swift" and rows["S/t3"].case_file is None


def test_discover_and_reports(spark, tmp_path):
    for name in ("a.xml", "b.bin", "c.txt"):
        (tmp_path / name).write_text("x")
    rows = {r.path[-5:]: r.bundled_path for r in uploads.discover_files(spark, [str(tmp_path)]).collect()}
    assert rows == {"a.xml": "junit/0", "b.bin": "internal/0"}
    runs = spark.createDataFrame([("b", 1, "t", 3), ("b", 2, "u", 0)], "bundle_id string, seq long, name string, line int")
    uploads.write_test_report(runs, str(tmp_path / "r"))
    assert sorted((r.name, r.line_number) for r in uploads.read_test_report(spark, str(tmp_path / "r")).collect()) == [("t", 3), ("u", None)]


def test_bundle_meta(spark, tmp_path):
    (tmp_path / "meta.json").write_text('{"version": "1", "num_files": 1, "num_tests": 2, "command_line": "x", "bundle_upload_id_v2": "v"}')
    assert uploads.scan_bundle_meta(spark, str(tmp_path)).first().schema_version == "0.7.7"


def test_message_lines(spark):
    shown, omitted = text.failure_message_lines(F.lit("\n\ta\r\n\n" + "b\n" * 20))
    r = spark.range(1).select(shown.alias("s"), omitted.alias("o")).first()
    assert r.s[:2] == ["", "    a"] and r.o == 4


def test_summary_counts_a_file_with_warnings_as_not_valid(spark):
    files = spark.createDataFrame([("r", "clean"), ("r", "warned"), ("r", "broken")], "run string, file string")
    levels = spark.createDataFrame([("warned", 0, 2), ("broken", 1, 0)], "file string, num_invalid long, num_suboptimal long")
    row = validation.validation_summary(files, levels, ["run"], ["file"]).first()
    assert (row.num_valid_files, row.num_warning_files, row.num_error_files, row.exit_code) == (1, 1, 1, 1)


def test_reports_are_limited_run_by_run(spark):
    found = spark.createDataFrame([(run, f"f{i:02}", 1, f"m{k}") for run, n in (("a", 10), ("b", 3)) for i in range(n) for k in range(9)], "run string, file string, level int, error_message string")
    rows = validation.limit_report(found, ["run"], "file").groupBy("run", "files_left_out").count().collect()
    assert {(r.run, r.files_left_out, r["count"]) for r in rows} == {("a", 2, 64), ("b", 0, 24)}


def test_files_five_folders_down_are_found(spark, tmp_path):
    for place in ("u1/a/b/c/d/e/x.xml", "u1/y.xml", "u2/a/b/z.xml", "u2/a/w.bin", "u2/no.txt"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text("x")
    rows = uploads.discover_files(spark, [str(tmp_path)], bundle=r"/(u\d)/").collect()
    assert {(r.bundle, r.path.rpartition("/")[2], r.bundled_path) for r in rows} == {("u1", "x.xml", "junit/0"), ("u1", "y.xml", "junit/1"), ("u2", "z.xml", "junit/0"), ("u2", "w.bin", "internal/0")}
