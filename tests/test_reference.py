"""Operators of the base package on small inputs."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C
from quarry.operators import lineage as L
from quarry.operators import packing as P
from quarry.sources import diffs
from quarry.sources import files as S
from quarry.streaming import increment


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc\x0bd", "\n\n", "x\x85y\u2028z\x1cq", None])
def test_lines_as_python(spark, text):
    assert files(spark, ("p", text)).select(T.lines(F.col("content"))).first()[0] == (text or "").splitlines()


def test_lines_of_files_and_the_cap(spark):
    df = files(spark, ("a.py", "x\x0cy\nz"), ("b.py", "1\n2\n3"), ("c.py", "1\n2"))
    assert rows(C.inventory(df)) == [("a.py", "python", 2), ("b.py", "python", 3), ("c.py", "python", 2)]
    got = C.numbered(df, 2, "cut").collect()
    assert sorted((r.path, str(r.line), r.content, r.truncated) for r in got if r.path != "a.py") == [("b.py", "1", "1", True), ("b.py", "2", "2", True), ("b.py", "None", "cut", True), ("c.py", "1", "1", False), ("c.py", "2", "2", False)]


def test_the_cut_note_counts_against_the_budget(spark):
    docs = files(spark, *[(f"{i}.md", "x" * 9000) for i in range(4)], ("0.md", " \n"))
    got = rows(C.budget(docs, [F.col("path")]))
    third = 24_000 - 2 * (8000 + len(C.CUT_NOTE))
    assert got == [("0.md", 1, 8000, True), ("1.md", 2, 8000, True), ("2.md", 3, third, True)]


def test_sql_rules(spark):
    sql = "select a,\nb,\n\n-- note ((\nfrom t))\nwhere (x = 'it''s\n)"
    got = rows(C.sql_findings(C.numbered(files(spark, ("q.sql", sql), ("ok.sql", "select (1)\nfrom t")))).select("path", "line", "rule"))
    assert got == [("q.sql", 2, "comma_before_clause"), ("q.sql", 5, "closing_parenthesis"), ("q.sql", 7, "odd_quotes")]


def test_c_style_rules(spark):
    code = "public class Other {\n  if (a = 1) {\n if (true);\n int x = 1\n  return x;\n  call.it(1)\n"
    lines = C.numbered(files(spark, ("src/Main.java", code))).withColumn("language", F.lit("java"))
    assert rows(C.c_style_findings(lines).select("line", "rule")) == [(1, "class_name"), (2, "assignment_in_if"), (3, "empty_if"), (4, "missing_semicolon"), (6, "braces"), (6, "missing_semicolon")]


@pytest.mark.parametrize(
    ("path", "line", "want"),
    [
        ("a.py", "async def go(x):", ("go", "function")), ("a.py", "  def go(x):", ("go", "method")), ("a.py", "class A(B):", ("A", "class")), ("a.py", "x: int = 3", ("x", "variable")),
        ("a.py", "x == 3", None), ("b.go", "func (s *T) Run[K any](x int) {", ("Run", "method")), ("b.go", "type T struct {", ("T", "struct")), ("b.go", "var x = 1", ("x", "variable")),
        ("c.sql", "CREATE OR REPLACE TABLE FUNCTION `p.d.f`(", ("p.d.f", "function")), ("c.sql", "drop view if exists d.v;", ("d.v", "table")), ("c.md", "def a(): pass", None), ("b.go", "func main() {", ("main", "function")), ("a.py", "x: int == 3", None), ("c.sql", "alter  table  t add", ("t", "table")),
    ],
)
def test_symbols(spark, path, line, want):
    got = files(spark, (path, line)).select(T.symbol(F.col("path"), F.col("content"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_changes_and_deletions(spark):
    index = C.plan_facts(files(spark, ("a.py", "1"), ("b.py", "1"), ("c.py", "1"))).select("path", "sha256")
    now = files(spark, ("a.py", "1"), ("b.py", "2"), ("d.py", "1"))
    assert rows(C.changes(now, index)) == [("a.py", "unchanged"), ("b.py", "changed"), ("c.py", "deleted"), ("d.py", "new")]
    assert [r[0] for r in rows(C.deleted(now, index))] == ["c.py"]


@pytest.mark.parametrize(
    ("base", "head", "want"),
    [(None, "present", "added"), (None, "absent", "deleted"), ("present", None, "deleted"), ("present", "present", "modified"), ("absent", "present", "added"), ("absent", "absent", None), (None, None, None), ("modified", None, "modified")],
)
def test_transition(spark, base, head, want):
    df = spark.createDataFrame([(base, head)], "b string, h string")
    assert df.select(C.transition(F.col("b"), F.col("h"))).first()[0] == want


def test_closure_goes_on_to_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"v{i}", f"v{i + 1}", "confirmed") for i in range(24)], "src string, dst string, confidence string")
    got = C.closure(edges, spark.createDataFrame([("v0",)], "node string"), P.cut).collect()
    assert sorted(r.depth for r in got) == list(range(1, 25))


def test_closure_prefers_confirmed_paths_and_ends_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "possible"), ("a", "c", "confirmed"), ("c", "b", "confirmed"), ("b", "a", "confirmed"), ("b", "d", "confirmed")], "src string, dst string, confidence string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(C.closure(edges, roots, P.cut)) == [("a", "b", 2, "confirmed"), ("a", "c", 1, "confirmed"), ("a", "d", 3, "confirmed")]


def test_severity_policy(spark):
    found = spark.createDataFrame([("f", 1, "critical", "breaking_change", "about one"), ("f", 9, "critical", "breaking_change", "two"), ("g", 1, "critical", "breaking_change", "one"), ("f", 1, "critical", "syntax_error", "one")], "file string, line int, severity string, category string, message string")
    impacts = spark.createDataFrame([("f", "one", "function", [5], [], 1), ("f", "zzz", "method", [9], ["x"], 2)], "file string, symbol string, symbol_type string, lines array<int>, external_files array<string>, ord int")
    assert rows(C.severity_policy(found, impacts).select("file", "line", "category", "severity")) == [("f", 1, "breaking_change", "high"), ("f", 1, "syntax_error", "critical"), ("f", 9, "breaking_change", "critical"), ("g", 1, "breaking_change", "critical")]


def test_next_fit_and_first_fit():
    assert P.next_fit([("a", 900), ("b", 400), ("c", 2000), ("d", 1), ("e", 1)]) == [1, 2, 3, 4, 4]
    assert P.next_fit([(str(i), 1) for i in range(7)]) == [1] * 5 + [2] * 2
    assert P.first_fit([(800, 1), (200, 1), (100, 1), (700, 1)]) == [0, 1, 0, 1]


def test_shards_do_not_depend_on_order(spark):
    units = [(f"u-{i}", 1000, 50_000, i) for i in range(12)]
    assert P.balance(units, 4) == P.balance(units[::-1], 4)
    df = spark.createDataFrame(units, "unit_id string, n_lines int, n_chars int, risk int")
    assert rows(C.shard_count(df, 3000, 150_000, 4, 8)) == [(12, 12_000, 600_000, 4)]
    assert [len(r.unit_ids) for r in P.shards(df, 4).collect()] == [3] * 4


def test_slices():
    got = P.slices([f"l{i}" for i in range(1000)])
    assert [(a, b) for a, b, _ in got] == [(1, 750), (726, 1000)]
    assert [(a, b, len(t)) for a, b, t in P.slices(["a", "x" * 70_001, "b"])] == [(1, 1, 1), (2, 2, 35_000), (2, 2, 35_000), (2, 2, 1), (3, 3, 1)]
    assert P.slices([]) == [(1, 1, "")]


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ top\n a\n-b\n+c\n+--- d\n--- /dev/null\n+++ b/n.sql\n@@ -0,0 +1 @@\n+select 1\n"


def test_diff():
    pick = lambda text, most=None: [(r[0], r[3], r[12], r[13], r[14], r[15]) for r in diffs.parse(text, most)]
    assert pick(DIFF) == [
        ("x.py", "modified", "context", 1, 1, "a"), ("x.py", "modified", "removed", 2, None, "b"), ("x.py", "modified", "added", None, 2, "c"),
        ("x.py", "modified", "added", None, 3, "--- d"), ("n.sql", "added", "added", None, 1, "select 1"),
    ]
    assert [r[2] for r in pick(DIFF, 2)] == ["context", "removed", "truncated", "truncated"]
    odd = "diff --git a/a b/x.go b/a b/x.go\n--- a/a b/x.go\n+++ b/a b/x.go\n@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n"
    assert [r[:1] + r[2:] for r in pick(odd)] == [("a b/x.go", "removed", 1, None, "a"), ("a b/x.go", "metadata", None, None, " No newline at end of file"), ("a b/x.go", "added", None, 1, "b"), ("a b/x.go", "metadata", None, None, " No newline at end of file")]
    moved = "diff --git a/o.py b/n.py\nsimilarity index 100%\nrename from o.py\nrename to n.py\ndiff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
    assert [r[:6] for r in diffs.parse(moved)] == [("n.py", "a/o.py", "b/n.py", "renamed", False, None), ("i.png", "a/i.png", "b/i.png", "binary", True, None)]


def lineage_of(sql, record):
    return [(r[3], r[5], r[7]) for r in L.analyze(sql, frozenset({"COUNT", "COALESCE"})) if r[0] == record]


def test_lineage():
    assert lineage_of("select a.id from `p.d.t` a -- x.y\n where a.s = 'q.z' and a.k = @p", "column") == [("p.d.t", "confirmed", "id"), ("p.d.t", "confirmed", "s"), ("p.d.t", "confirmed", "k")]
    assert lineage_of("select x from t", "source") == [("t", "possible", None)]
    assert lineage_of("with c as (select 1 from d.t) select * from c", "source") == [("d.t", "confirmed", None), ("c", "ignored", None)]
    assert lineage_of("select z from d.a, d.b", "column") == [("d.a", "possible", "z"), ("d.b", "possible", "z")]
    assert lineage_of("select 1 from d.a join d.b using (k)", "column") == [("d.a", "confirmed", "k"), ("d.b", "confirmed", "k")]
    assert lineage_of("select a.n.f from d.t a", "column") == [("d.t", "confirmed", "n.f")]
    assert lineage_of("select count(*), a * b from d.t", "wildcard") == []
    assert lineage_of("select a.* except (x) from d.t a", "wildcard") == [("d.t", "confirmed", "x")]
    assert lineage_of("select f(1), d.g(2), coalesce(1, 2) from d.t; call d.p()", "routine") == [("f", "possible", None), ("d.g", "confirmed", None), ("d.p", "confirmed", None)]
    assert lineage_of("select u.x from d.t, unnest(t.xs) as u", "column")[-1] == ("u", "possible", "x")
    assert lineage_of("create table d.t (a int64, b array<struct<x int64, y int64>>, primary key (a))", "definition_column") == [("d.t", "confirmed", "a"), ("d.t", "confirmed", "b")]
    assert lineage_of("select 1 from d.o o where exists (select 1 from d.i o where o.k = 1)", "column") == [("d.i", "confirmed", "k")]
    assert lineage_of("alter table d.t rename column a to b, add column c int64, drop column if exists e", "column_mutation") == [("d.t", "confirmed", "a"), ("d.t", "confirmed", "c"), ("d.t", "confirmed", "e")]


def test_lineage_of_dashed_projects_and_truncation():
    assert lineage_of("select a from my-proj-1.d.t where b - c.d > 1", "source") == [("my-proj-1.d.t", "confirmed", None)]
    assert lineage_of("truncate table d.t", "source") == [("d.t", "confirmed", None)]
    assert lineage_of("merge d.t using d.s on t.a = s.a when matched then update set b = 1", "source") == [("d.t", "confirmed", None), ("d.s", "confirmed", None)]
    assert len(L.COUNTERPARTS) == 74 and len(L.RESERVED) >= 97


def test_source_tree_and_stream(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "vendor").mkdir(parents=True)
    (root / "a.py").write_text("x = 1\n")
    (root / "vendor/b.py").write_text("y")
    (root / "c.txt").write_text("z")
    (root / "bad.sql").write_bytes(b"\xff\xfe")
    tree = S.source_tree(spark, str(root))
    assert rows(C.inventory(tree)) == [("a.py", "python", 1)]
    incoming, seen = tmp_path / "in", []
    incoming.mkdir()
    stream = spark.readStream.schema("path string, content string").json(str(incoming))
    for text in ("1", "1", "2"):
        files(spark, ("a.py", text)).write.mode("append").json(str(incoming))
        increment.follow(stream, str(tmp_path / "index"), str(tmp_path / "ck"), lambda df, n: seen.append(rows(df))).awaitTermination()
    assert seen == [[("a.py", "new")], [], [("a.py", "changed")]]


def test_text_functions(spark):
    df = spark.createDataFrame([("docs/design/x.md", "Drop Table a; password")], "path string, content string")
    got = df.select(T.priority(F.col("path")), T.risk_score(F.lit("auth/User.py"), F.col("content")), T.safe_relative(F.lit("../x")), T.clamp(F.lit("99"), 1, 1, 20), T.clamp(F.lit("q"), 4, 1, 20), T.skipped(F.lit("a\\vendor\\b.py"))).first()
    assert tuple(got) == (2, 16, False, 20, 4, True)


def test_first_fit_looks_at_few_units(spark):
    def plain(sizes):
        units, out = [], []
        for lines, chars in sizes:
            at = next((k for k, (n, a, b) in enumerate(units) if n < 8 and a + lines <= 900 and b + chars <= 45_000), len(units))
            units += [[0, 0, 0]] * (at == len(units))
            n, a, b = units[at]
            units[at] = [n + 1, a + lines, b + chars]
            out.append(at)
        return out

    some = random.Random(1)
    for most in ((250, 12_000), (900, 45_000), (1000, 50_000), (3, 3)):
        sizes = [(some.randint(0, most[0]), some.randint(0, most[1])) for _ in range(700)]
        assert P.first_fit(sizes) == plain(sizes)
    began = time.monotonic()
    assert P.first_fit([(500, 9)] * 40_000) == list(range(40_000))
    assert time.monotonic() - began < 15


def test_units_of_languages_in_order_of_path(spark):
    df = spark.sql("select case id % 3 when 0 then 'go' when 1 then 'py' end as language, 'p' || id as path, cast(id % 400 as int) as n_lines, cast(id as int) as n_chars from range(3000)").repartition(5)
    got = {(r.language, r.path): r.unit for r in P.small_units(df).collect()}
    batch = {(r.language, r.path): r.batch for r in P.batches(df, "language").collect()}
    for k, lang in enumerate(("go", "py", None)):
        ids = sorted((i for i in range(3000) if i % 3 == k), key=lambda i: f"p{i}")
        assert [got[lang, f"p{i}"] for i in ids] == P.first_fit([(i % 400, i) for i in ids])
        assert [batch[lang, f"p{i}"] for i in ids] == P.next_fit([(f"p{i}", i % 400) for i in ids])
    assert len(got) == len(batch) == 3000


def test_diffs_of_a_batch_are_not_held_at_once(spark):
    text = "--- a/x\n+++ b/x\n@@ -1,300 +1,300 @@\n" + " y\n" * 300
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(100)]), pa.array([text] * 99 + [None])], ["diff_id", "diff"])
    taken = []

    def inputs():
        for k in range(3):
            taken.append(k)
            yield batch

    df = spark.createDataFrame([(str(i), text) for i in range(100)], "diff_id string, diff string").coalesce(1)
    sizes = diffs.diff_lines(df).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    assert sum(r.n for r in sizes.collect()) == 30_000 and max(r.n for r in sizes.collect()) <= 10_000
    out = diffs.parsed(inputs(), held=1000)
    first = next(out)
    assert first.num_rows == 1000 and taken == [0]
    assert first.num_rows + sum(b.num_rows for b in out) == 3 * 99 * 300
    assert max(b.num_rows for b in diffs.parsed([batch], chars=50)) == 50


def test_sql_rules_sort_no_text(spark):
    sql = "-- a,\nselect a,\n-- b\n\nfrom t\n)\n)(\n--)\n(", "-- only ' ("
    got = C.sql_findings(C.numbered(files(spark, ("q.sql", sql[0]), ("c.sql", sql[1]))))
    want = [("q.sql", 2, "comma_before_clause"), ("q.sql", 6, "closing_parenthesis"), ("q.sql", 9, "open_parenthesis")]
    assert rows(got.select("path", "line", "rule")) == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") and not any("content" in line or " s#" in line for line in plan.splitlines() if "Window" in line or "Exchange" in line)


def test_more_input_is_spread_over_more_tasks(spark):
    tasks = [P.spread(spark.range(n), "id", mb=1).rdd.getNumPartitions() for n in (10, 1_000_000, 4_000_000)]
    assert tasks == [4, 8, 31]
