"""Report files: every report of a file, in document order, and files that several tasks read."""

import random

import pytest
from pyspark.sql import functions as F

from testloom.sources import junit, listing, uploads

CASE = '<testcase name="{0}"><failure message="m{0}">t</failure></testcase>'
FILES = {
    # name: (text, [(suite, case)] in order)
    "prolog": ('<?xml version="1.0" encoding="UTF-8"?>\n<!-- one\nline > two <testsuites> -->\n<testsuite name="s"><testcase name="a"/></testsuite>', [("s", "a")]),
    "mark": ('﻿<testsuite name="s"><testcase name="a"/></testsuite>', [("s", "a")]),
    "marked_report": ('﻿<?xml version="1.0"?><testsuites><testsuite name="s"><testcase name="a"/></testsuite></testsuites>', [("s", "a")]),
    "doctype": ('<!DOCTYPE testsuite [<!ELEMENT x (y)> <!ENTITY z "q">\n]><testsuite name="s"><testcase name="a"/></testsuite>', [("s", "a")]),
    "plain_doctype": ('<!DOCTYPE testsuite SYSTEM "a.dtd"><testsuite name="s"><testcase name="a"/></testsuite>', [("s", "a")]),
    "two_reports": ('<testsuites name="1"><testsuite name="s"><testcase name="a"/></testsuite></testsuites>\n<testsuites name="2"><testsuite name="t"><testcase name="b"/><testcase name="c"/></testsuite></testsuites>', [("s", "a"), ("t", "b"), ("t", "c")]),
    "bare_suites": ('<testsuite name="s"><testcase name="a"/></testsuite><testsuite name="t"><testcase name="b"/></testsuite>', [("s", "a"), ("t", "b")]),
    "mixed": ('<testsuite name="s"><testcase name="a"/></testsuite><testsuites><testsuite name="t"><testcase name="b"/></testsuite></testsuites><testsuite name="u"><testcase name="c"/></testsuite>', [("s", "a"), ("t", "b"), ("u", "c")]),
    "order": ('<testsuites><testsuite name="o"><testcase name="a"/><testsuite name="i"><testcase name="b"/></testsuite><testcase name="c"/><testsuite name="j"><testcase name="d"/></testsuite></testsuite></testsuites>', [("o", x) for x in "abcd"]),
    "open_suite": ('<testsuites><testsuite name="s"><testcase name="a"/></testsuite></testsuites><testsuite name="t"><testcase name="b"/>', [("s", "a")]),
    "open_report": ('<testsuite name="s"><testcase name="a"/></testsuite><testsuites><testsuite name="t"><testcase name="b"/></testsuite>', [("s", "a")]),
    "outside": ('<testsuites><testcase name="x"/><testsuite name="s"><testcase name="a"/></testsuite></testsuites>', [("s", "a")]),
    "foreign": ('<a><testsuite name="s"><b><testcase name="a"/></b></testsuite></a>', [("s", "a")]),
    "broken": ('<testsuites><testsuite name="s"><testcase name="a"/></testsuites>', []),
    "quotes": ("<testsuite name='s \"x\" > y'><testcase name='a' note=' name=\"no\" '/></testsuite>", [('s "x" > y', "a")]),
}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.file_path, r.seq)):
        out.setdefault(r.file_path.rpartition("/")[2].removesuffix(".xml"), []).append(r)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("reports")
    for name, (text, _) in FILES.items():
        (path / f"{name}.xml").write_text(text)
    (path / "empty.xml").write_text("")
    return str(path)


@pytest.mark.parametrize("large_file", [junit.LARGE_FILE, 0])
def test_every_report_in_document_order(spark, folder, large_file):
    rows = found(junit.scan_junit(spark, folder, large_file))
    assert {n: [(r.parent_name, r.name) for r in rs] for n, rs in rows.items()} == {n: want for n, (_, want) in FILES.items() if want}
    for rs in rows.values():
        assert [r.seq for r in rs] == list(range(1, len(rs) + 1))
    assert [(r.suite_pos, r.case_pos) for r in rows["two_reports"]] == [(0, 0), (1, 0), (1, 1)]
    assert [r.case_pos for r in rows["order"]] == [0, 1, 2, 3]
    assert len({r.report_no for r in rows["mixed"]}) == 3 and len({r.report_no for r in rows["bare_suites"]}) == 1
    issues = {(r.file_path.rpartition("/")[2], r.level, r.error_message) for r in junit.scan_junit_issues(spark, folder, large_file).collect()}
    assert issues == {
        ("empty.xml", 1, "no reports found"), ("broken.xml", 3, "could not parse XML"), ("two_reports.xml", 2, "multiple reports found"), ("mixed.xml", 2, "multiple reports found"), ("outside.xml", 2, "test case found without a test suite found"),
    }


def test_texts_and_references(spark, tmp_path):
    text = """<testsuites time="9" timestamp="2024-01-09"><testsuite name=" &#x41;&amp;lt;&#66; " time="2"><system-out>early</system-out>
<testcase name="a" classname="&lt;C&gt;" file="&nosuch;"><failure message='say "x"' type="T">first<![CDATA[ a < b && c ]]></failure></testcase>
<testcase name="b">before<failure message="m"/></testcase><testcase name="c">before<failure message="m"/>after</testcase><testcase name="d">1<x>2</x> 3 </testcase>
<testcase name="e"><system-out>o1</system-out><system-out></system-out><system-err>e &#128512;</system-err></testcase><testcase name="é"/><system-out> late </system-out></testsuite></testsuites>"""
    (tmp_path / "a.xml").write_text(text)
    for large_file in (junit.LARGE_FILE, 0):
        rows = {r.name: r for r in junit.scan_junit(spark, str(tmp_path), large_file).collect()}
        a = rows["a"]
        assert (a.parent_name, a.classname, a.case_file, a.message, a.type, a.description) == ("A&lt;B", "<C>", None, 'say "x"', "T", "a < b && c")
        assert (a.suite_time, a.report_time, a.report_ts.year) == (2.0, 9.0, 2024)
        assert {n: rows[n].description for n in "bcde"} == {"b": None, "c": "after", "d": "3", "e": None}
        assert (rows["e"].system_out, rows["e"].system_err) == ("o1", "e \U0001f600")
        assert {r.suite_system_out for r in rows.values()} == {"late"} and "é" in rows


def long_file(rng, suites):
    """A report with all that can hold a `<`, so that chunks begin anywhere."""
    out = ["<?xml version='1.0'?><!DOCTYPE r [<!ELEMENT a (b)>]><testsuites>"]
    n = 0
    for s in range(suites):
        out.append(f'<testsuite name="s{s}" time="{s}">')
        for _ in range(rng.randint(0, 40)):
            n += 1
            body = rng.choice(["", "<failure message='f'>x &lt; y</failure>", "<![CDATA[<testcase name='no'><b>]]>", "<!-- <testcase name='no'/> > -->", "<system-out><![CDATA[a <init> b <c> ]]]]><![CDATA[> d]]></system-out>", "<rerunFailure message='r'><stackTrace>at <![CDATA[<x>]]></stackTrace></rerunFailure><skipped/>"])
            out.append(f'<testcase name="c{n}" classname="k > l">{body}</testcase>\n' if body or rng.random() < 0.5 else f'<testcase name="c{n}"/>')
            if rng.random() < 0.1:
                out.append("<testsuite name='inner'><testcase name='in'/></testsuite>")
        out.append(rng.choice(["", f"<system-out>out {s}</system-out>", "<system-err><![CDATA[ <e> ]]></system-err>"]) + "</testsuite>")
    return "".join(out) + "</testsuites>"


def test_large_files_equal_small_ones(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(junit, "CHUNK_BITS", 5)
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text(long_file(rng, 30))
    (tmp_path / "cut.xml").write_text(long_file(rng, 12).removesuffix("</testsuite></testsuites>"))
    (tmp_path / "wrong.xml").write_text(long_file(rng, 12).replace("</testsuite><testsuite name=\"s7\"", "</testsuit><testsuite name=\"s7\""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path), lineSep="<").rdd.getNumPartitions() > 8
        large = junit.scan_junit(spark, str(tmp_path), 0).collect()
        issues = junit.scan_junit_issues(spark, str(tmp_path), 0).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(large, key=repr) == sorted(junit.scan_junit(spark, str(tmp_path)).collect(), key=repr) and len(large) > 1000
    assert sorted(issues) == sorted(junit.scan_junit_issues(spark, str(tmp_path)).collect())
    assert any(r.level == 3 and "wrong" in r.file_path for r in issues)


def test_tokens_of_large_files_are_made_once(spark, tmp_path, monkeypatch):
    """What later steps read of the tokens is written; none makes them again."""
    (tmp_path / "a.xml").write_text(long_file(random.Random(2), 5))
    plans, write = [], junit.written
    monkeypatch.setattr(junit, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    rows = junit.scan_junit(spark, str(tmp_path), 0)
    plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
    made = [p for p in plans if "posexplode(regexp_extract_all(" in p]
    small = [p for p in made if "wholetext" in p or p is plans[-1]]
    assert len(made) - len(small) == 1 and rows.count() > 0


def test_lines_are_documents(spark, tmp_path):
    """A bundle's lines are its report; no group holds a document."""
    cases = [(b, n, f"{'ts'[(n + b) % 2]} &", f"c{n}", "FAILURE" if n % 3 == 0 else "SUCCESS", f"<{n}>") for b in (1, 2) for n in range(40)]
    df = spark.createDataFrame(cases, "bundle_id long, seq long, parent_name string, name string, status string, message string")
    empty = {k: F.lit(None).cast(t) for k, t in (("classname", "string"), ("file", "string"), ("raw_id", "string"), ("time_s", "double"), ("case_ts", "timestamp"))}
    lines = junit.junit_xml_lines(df.withColumns(empty))
    assert "collect_list" not in lines._jdf.queryExecution().optimizedPlan().toString()
    junit.write_junit(lines, str(tmp_path / "out"))
    for large_file in (junit.LARGE_FILE, 0):
        rows = junit.scan_junit(spark, str(tmp_path / "out" / "*"), large_file).collect()
        found_cases = sorted((int(r.file_path.split("bundle_id=")[1].split("/")[0]), r.seq, r.parent_name, r.name, r.status, r.message) for r in rows)
        want = []
        for b in (1, 2):
            own = [c for c in cases if c[0] == b]
            first = {c[2]: c[1] for c in reversed(own)}
            ordered = sorted(own, key=lambda c: (first[c[2]], c[1]))
            want += [(b, k + 1, c[2], c[3], c[4], c[5] if c[4] == "FAILURE" else None) for k, c in enumerate(ordered)]
        assert found_cases == want and len({r.file_path for r in rows}) == 2 and {r.suite_pos for r in rows} == {0, 1}


# --- files under globs


def test_globs_as_automata():
    """Against a search that tries every way to match."""
    import fnmatch

    def plain(parts, names):
        if not parts:
            return not names
        if parts[0] == "**":
            return any(plain(parts[1:], names[k:]) for k in range(len(names) + 1)) or (len(parts) == 1)
        return bool(names) and fnmatch.fnmatchcase(names[0], parts[0]) and plain(parts[1:], names[1:])

    rng = random.Random(1)
    for _ in range(3000):
        parts = [rng.choice(["a", "b", "*", "**", "?", "[ab]", "[!a]*", "a*", "*b"]) for _ in range(rng.randint(1, 5))]
        names = [rng.choice(["a", "b", "ab", "abb", "c"]) for _ in range(rng.randint(1, 6))]
        assert listing.PathAutomaton(parts).matches("/".join(names)) == plain(parts, names), (parts, names)


def test_discovery_by_globs(spark, tmp_path):
    for place in ("a/x.xml", "a/b/y.xml", "a/b/c/z.xml", "w.xml", "a/q.junit", "a/r.bin", "a/no.txt", "d.xml/in.txt", ".h/v.xml", "sp ace/u%20.xml"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text("x")

    def found(*globs, **more):
        return {(r.set_pos, r.path.split(f"{tmp_path}/")[1]): r.bundled_path for r in uploads.discover_files(spark, [f"{tmp_path}/{g}" for g in globs], **more).collect()}

    every = {"w.xml", "a/x.xml", "a/b/y.xml", "a/b/c/z.xml", ".h/v.xml", "sp ace/u%20.xml"}
    assert {p for _, p in found("**/*.xml")} == every
    assert {p for _, p in found("a/**/*.xml")} == {"a/x.xml", "a/b/y.xml", "a/b/c/z.xml"}
    assert found("a/*.junit", "a/*.xml") == {(0, "a/q.junit"): None, (1, "a/x.xml"): "junit/0"}
    assert found("*") == {(0, "w.xml"): "junit/0"}  # folders aren't files, what is in them isn't found
    assert found("a/?.xml", "a/**") == {(0, "a/x.xml"): "junit/0", (1, "a/b/c/z.xml"): "junit/1", (1, "a/b/y.xml"): "junit/2", (1, "a/x.xml"): "junit/3", (1, "a/r.bin"): "internal/0", (1, "a/q.junit"): None}
    assert {p for _, p in found("a")} == {"a/x.xml", "a/b/y.xml", "a/b/c/z.xml", "a/r.bin"}  # no glob: a folder
    assert not found("none/**/*.xml") and not found("a/x.xml", start="2999-01-01 00:00:00")
    assert found("w.xml", start="2000-01-01 00:00:00") == {(0, "w.xml"): "junit/0"}
