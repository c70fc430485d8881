"""Revisions, bundles, results of workers and budgets on small inputs."""

import io
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import documents as D
from quarry.operators import evidence as E
from quarry.operators import revisions as V
from quarry.sources import diffs, git


def test_git_revisions(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("no\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "ü.sql").write_text("select 1")
    run("add", ".")
    run("commit", "-qm", "two")
    both = git.files_at(spark, str(tmp_path), "HEAD~1").withColumn("revision", F.lit("base")).union(git.files_at(spark, str(tmp_path), "HEAD").withColumn("revision", F.lit("head")))
    assert sorted(map(tuple, V.changed_paths(both, "base", "head").collect())) == [("a.py", "modified"), ("ü.sql", "added")]
    lines = diffs.diff_lines(git.diff(spark, str(tmp_path), "HEAD~1", "HEAD"))
    assert {(r.path, r.kind, r.content) for r in lines.collect()} >= {("a.py", "removed", "x = 1"), ("a.py", "added", "x = 2")}
    with pytest.raises(ValueError):
        git.diff(spark, str(tmp_path), "HEAD", "HEAD")
    with pytest.raises(ValueError):
        git.revision(str(tmp_path), "--all")
    with pytest.raises(ValueError):
        git.positive(0, "limit")


def test_standard_input_and_demo(spark):
    assert git.standard_input(spark, "a.py", io.StringIO("x")).collect() == [("a.py", "x")]
    with pytest.raises(ValueError):
        git.standard_input(spark, "a.py", io.StringIO(" \n"))
    assert {r.target_line for r in diffs.diff_lines(diffs.demo(spark)).where("kind = 'added'").collect()} == {47, 48, 49}


def test_bundle(spark, tmp_path):
    units = spark.createDataFrame([("s1", "u1", 1, 2, 3), ("s1", "u10", 1, 2, 3), ("s2", "u2", 5, 6, 7)], "shard_id string, unit_id string, lines int, chars int, risk int")
    payloads = units.select("shard_id", "unit_id", F.lit("text").alias("content"))
    D.write_bundle(units, payloads, f"{tmp_path}/b")
    assert sorted(map(tuple, D.read_bundle(spark, f"{tmp_path}/b", "unit_id string, content string").select("unit_id", "content").collect())) == [("u1", "text"), ("u10", "text"), ("u2", "text")]
    D.write_bundle(units, payloads.where("unit_id <> 'u2'"), f"{tmp_path}/c")
    with pytest.raises(ValueError):
        D.read_bundle(spark, f"{tmp_path}/c", "unit_id string, content string")


def test_results_of_workers(spark):
    doc = ", ".join(f"{c}: string" for c in D.TEXTS) + ", " + ", ".join(f"{c}: array<string>" for c in D.LISTS)
    schema = f"shard_id string, processed_units int, failed_units array<struct<unit_id: string, reason: string>>, files array<struct<path: string, {doc}>>"
    page = lambda path, text, *items: (path, text, "", "", list(items), [], [], [], [])
    rows = [("s2", 2, [("u3", "b")], [page("a", "two", "y", "x"), page("", "lost")]), ("s1", 3, [("u9", "a"), ("u1", "z")], [page("a", "one", "x"), page("b", "one two"), page("b", "two")])]
    results, expected = spark.createDataFrame(rows, schema), spark.createDataFrame([("s1",), ("s2",)], "shard_id string")
    files, failed, stats = D.merge_results(results, expected)
    assert sorted((r.path, r.purpose, r.main_components) for r in files.collect()) == [("a", "one\ntwo", ["x", "y"]), ("b", "one two", [])]
    assert [tuple(r) for r in failed.collect()] == [("s1", "u1", "z"), ("s1", "u9", "a"), ("s2", "u3", "b")]
    assert stats.first().asDict() == {"shard_count": 2, "processed_units": 5, "failed_units": 3, "documented_files": 2}
    with pytest.raises(ValueError, match="missing"):
        D.merge_results(results.where("shard_id = 's1'"), expected)


def test_source_budget():
    b = E.SourceBudget(3)
    b.add(["a", "b"])
    with pytest.raises(ValueError):
        b.add(["c", "d"])
    b.add(["a", "c"])
    assert b.seen == {"a", "b", "c"}


@pytest.mark.parametrize(
    ("path", "line", "name", "want"),
    [("a.py", "async def f.x(", "f.x", True), ("a.py", "def fax(", "f.x", False), ("b.go", "func (r T) Go[K any](", "Go", True), ("b.go", "const Go = 1", "Go", True), ("c.sql", "create table function `T`(", "t", True), ("c.sql", "drop view tt", "t", False), ("a.py", "x == 1", "x", False), ("c.md", "def x(", "x", False)],
)
def test_defines(spark, path, line, name, want):
    df = spark.createDataFrame([(path, line, name)], "path string, line string, name string")
    assert df.select(T.defines(F.col("path"), F.col("line"), F.col("name"))).first()[0] == want


def most_rows(df):
    """The most rows that any step of the plan put out."""
    df.collect()
    stack, most = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        metrics, kind = node.metrics(), node.getClass().getSimpleName()
        most = max(most, metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0)
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        stack += below
    return most


def test_impacts_of_a_batch_do_not_meet_each_naming_of_a_file(spark):
    files = spark.sql("select id % 2 as batch, 'f' as path from range(400)")
    symbols = spark.sql("select 1 as batch, 's' as symbol from range(400) union all select null, 's'")
    impacts = spark.sql("select id as impact, 'f' as changed_file, 's' as symbol from range(300) union all select 0, 'g', 's' union all select 0, 'g', 's' union all select null, 'f', null union all select 7000, 'g', 't'")
    got = E.batch_impacts(files, symbols, impacts)
    want = {(b, i) for i in range(300) for b in (0, 1, None)} | {(0, None), (1, None)}
    assert most_rows(got) < 2000
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_findings_do_not_meet_each_impact_of_their_file(spark):
    findings = spark.sql("select id as finding, 'f' as file, cast(null as string) as symbol, 'on s' || id % 3 as message from range(300) union all select 300, 'g', 'x', null union all select 301, 'h', 'x', '' union all select 302, 'e', 'y', 'y'")
    impacts = spark.sql("select id + 5 as ord, 'f' as changed_file, 's' || id % 2 as symbol from range(400) union all select 900, 'g', 'z' union all select 901, 'h', '' union all select 902, 'h', null")
    changes = spark.sql("select 3 as ord, 'f' as file, 's1' as symbol union all select 2, 'f', 's1' union all select 4, 'g', 'z' union all select 5, 'h', 'x'")
    got = E.report_rows(findings, impacts, changes)
    want = {(i, (5, 6, None)[i % 3], 2 if i % 3 == 1 else None) for i in range(300)} | {(300, 900, 4), (301, None, 5), (302, None, None)}
    assert most_rows(got) < 2000
    assert set(map(tuple, got.collect())) == want
