"""Queries of revisions, symbols, references, documentation and evidence, over inputs that SQL makes of the driver's tables.

An input is one text that both Spark and the check's engine read. Lines of code come from all lines of all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C
from quarry.operators import documents as D
from quarry.operators import evidence as E
from quarry.operators import packing as P
from quarry.operators import references as R
from quarry.operators import revisions as V
from quarry.operators import symbols as S
from quarry.operators.lineage import COUNTERPARTS, lineage
from quarry.sources import diffs

TABLES = ("documents", "nation", "region", "supplier", "customer", "orders", "lineitem", "events", "conversations", "labels")


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text})


def check(text: str) -> str:
    """The same text for the check's engine."""
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


END = "CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'sql' WHEN 'fr' THEN 'go' ELSE 'md' END"
PATH = f"source || '/' || lang || '/' || cast(doc_id AS string) || '.' || {END}"
REVISIONS = f"""SELECT revision, CASE WHEN doc_id % 11 = 0 THEN '../' WHEN doc_id % 13 = 0 THEN 'Vendor/' WHEN doc_id % 17 = 0 THEN '/' ELSE '' END || {PATH} AS path, doc_id, lang,
  text || CASE WHEN revision = 'head' AND doc_id % 5 = 0 THEN '~' ELSE '' END AS content
  FROM {{documents}} JOIN (SELECT 'base' AS revision, 3 AS step UNION ALL SELECT 'head', 4) r ON doc_id % step <> 0"""


def ref_listing(spark, sf_dir):
    return V.listing(made(spark, sf_dir, REVISIONS), "head", ("py", "sql")).select("path", F.length("content").alias("n"))


def ref_changed_paths(spark, sf_dir):
    return V.changed_paths(made(spark, sf_dir, REVISIONS), "base", "head")


#: A line of code for each line of a document: declarations around its first word, comments, and the line itself.
FORM = {
    1: ("'  def ' || w || '(a):'", "'func (r T) ' || w || '() {'", "'create or replace table `a.' || w || '` ('"),
    2: ("'class ' || w || ':'", "'type ' || w || ' struct {'", "'DROP VIEW IF EXISTS ' || w || ';'"),
    3: ("w || ' = 1'", "'var ' || w || ' = 2'", "'create table function ' || w || '() as'"),
    4: ("'# ' || w", "'// ' || w", "'-- ' || w"),
}
FORMED = "CASE WHEN w <> '' THEN CASE line % 5 " + " ".join(f"WHEN {k} THEN CASE x WHEN 'py' THEN {a} WHEN 'go' THEN {b} WHEN 'sql' THEN {c} END" for k, (a, b, c) in FORM.items()) + " END END"


def code(spark, sf_dir) -> DataFrame:
    """(path, doc_id, line, content) of the lines of code."""
    from quarry.plans.registry import corpus

    files = corpus(spark, sf_dir)
    lines = C.numbered(files).join(files.select("path", "doc_id"), "path")
    lines = lines.withColumns({"w": F.regexp_extract("content", "([A-Za-z]+)", 1), "x": T.suffix(F.col("path"))})
    return lines.select("path", "doc_id", "line", F.coalesce(F.expr(FORMED), F.concat(F.lit("> "), "content")).alias("content"))


def ref_symbols(spark, sf_dir):
    lines = code(spark, sf_dir)
    return lines.select("path", "line", T.symbol(F.col("path"), F.col("content")).alias("s"), T.comment_or_blank(F.col("path"), F.col("content")).alias("comment")).select("path", "line", "s.*", "comment")


def ref_definitions(spark, sf_dir):
    names = spark.createDataFrame([("the",), ("of",), ("die",), ("le",)], "symbol string")
    return V.definitions(code(spark, sf_dir), names).select("symbol", "path", "line")


def ref_compare_symbol(spark, sf_dir):
    lines = code(spark, sf_dir)
    base, head = (lines.where(F.col("doc_id") % k != 0).withColumn("revision", F.lit(r)) for r, k in (("base", 3), ("head", 4)))
    return V.snapshots(base.union(head), "the", context=2).select("revision", "kind", "path", "line")


def code_diffs(spark, sf_dir) -> DataFrame:
    """The lines of code as lines of diffs, ten to a hunk."""
    hunk = F.floor((F.col("line") - 1) / 10).cast("int")
    kind = F.when(F.col("line") % 4 == 1, "added").when(F.col("line") % 4 == 2, "removed").otherwise("context")
    x, k = T.suffix(F.col("path")), (hunk % 3).cast("string")
    section = F.when(x == "py", F.concat(F.lit("def s"), k, F.lit("(x):"))).when(x == "go", F.concat(F.lit("func s"), k, F.lit("() {"))).when(hunk % 2 == 0, F.concat(F.lit("create view d.s"), k)).otherwise("")
    lines = code(spark, sf_dir).withColumns({"hunk": hunk, "kind": kind, "section": section, "source_start": 10 * hunk + 1, "target_start": 10 * hunk + 1})
    return lines.withColumns({"source_line": F.when(F.col("kind") != "added", F.col("line")), "target_line": F.when(F.col("kind") != "removed", F.col("line"))})


def listed(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that any engine gives the same."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


def ref_changed_symbols(spark, sf_dir):
    return listed(S.fold(S.declaration_events(code_diffs(spark, sf_dir))), "source_lines", "target_lines", "detected_from")


def ref_fragments(spark, sf_dir):
    parts = S.fragments(code_diffs(spark, sf_dir))
    texts = S.fragment_texts(parts).join(parts.groupBy("path", "hunk", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed")), ["path", "hunk", "side"])
    return texts.withColumn("content", F.sha2(F.col("content").cast("binary"), 256))


#: Lines of SQL in one hunk for each document, by its length: (place, kind, text, and the effects that a changed line has).
DDL = [
    (1, "removed", "'create view d.v' || cast(n_chars % 3 AS string) || ' as select 1;'", [("'d.v' || cast(n_chars % 3 AS string)", "table", "present")]),
    (2, "added", "'create view d.v' || cast(n_chars % 4 AS string) || ' as select 2;'", [("'d.v' || cast(n_chars % 4 AS string)", "table", "present")]),
    (3, "context", "'drop table d.t0;'", []),
    (4, "added", "'alter table d.t' || cast(n_chars % 5 AS string) || ' add column c int64;'", [("'d.t' || cast(n_chars % 5 AS string)", "table", "modified"), ("'d.t' || cast(n_chars % 5 AS string) || '.c'", "column", "present")]),
    (5, "added", "'drop table d.t' || cast(n_chars % 6 AS string) || ';'", [("'d.t' || cast(n_chars % 6 AS string)", "table", "absent")]),
    (6, "removed", "'alter table d.t' || cast(n_chars % 2 AS string) || ' rename column x to y;'", [("'d.t' || cast(n_chars % 2 AS string)", "table", "modified"), ("'d.t' || cast(n_chars % 2 AS string) || '.x'", "column", "absent"), ("'d.t' || cast(n_chars % 2 AS string) || '.y'", "column", "present")]),
    (7, "removed", "'drop function d.f' || cast(n_chars % 3 AS string) || ';'", [("'d.f' || cast(n_chars % 3 AS string)", "function", "absent")]),
]
DDL_LINES = " UNION ALL ".join(f"SELECT 'q' || cast(doc_id AS string) || '.sql' AS path, 1 AS hunk, '' AS section, 1 AS source_start, 1 AS target_start, {n} AS line, '{k}' AS kind, {n} AS source_line, {n} AS target_line, {t} AS content FROM {{documents}}" for n, k, t, _ in DDL)


def ref_side_states(spark, sf_dir):
    parts = P.cut(S.fragments(made(spark, sf_dir, DDL_LINES)))
    texts = S.fragment_texts(parts).select(S.fragment_key().alias("path"), "content")
    return listed(S.fold(S.side_events(parts, lineage(texts))), "source_lines", "target_lines").drop("detected_from")


OWNER_FILES = f"""SELECT {PATH} AS path, 'create view d.o' || cast(n_chars % k AS string) || ' as select 1' || CASE WHEN n_chars % 5 = k THEN '; create function d.f() as (1)' ELSE '' END AS content, k
  FROM {{documents}} JOIN (SELECT 3 AS k UNION ALL SELECT 4) r ON doc_id % (k + 3) <> 0 WHERE lang = 'de'"""


def ref_owner_events(spark, sf_dir):
    files = made(spark, sf_dir, OWNER_FILES)
    own = lambda k: S.owners(lineage(files.where(F.col("k") == k)), ["path"])
    return listed(S.fold(S.owner_events(code_diffs(spark, sf_dir), own(3), own(4))), "source_lines", "target_lines").drop("detected_from")


SQL_FILES = f"SELECT {PATH} AS path, n_chars, doc_id, CASE n_chars % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS change_type FROM {{documents}}"
SQL_SYMBOLS = "SELECT path, 'd.t' || cast(n_chars % 5 AS string) AS symbol, CASE n_chars % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'column' WHEN 2 THEN 'function' ELSE 'variable' END AS symbol_type, change_type FROM f WHERE doc_id % 3 = 0"
SQL_GIVEN = "SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'entire file' ELSE 'd.t1' END AS symbol, 'given' AS symbol_type, change_type FROM f WHERE doc_id % 5 = 0"


def ref_meaningful(spark, sf_dir):
    lines = code_diffs(spark, sf_dir).withColumn("change_type", F.lit("modified"))
    n = F.col("line") % 12
    odd = F.when(n == 1, F.lit("/* a")).when(n == 5, F.lit("b */  -- c")).when(n == 9, F.lit(" \t")).when(n % 4 == 2, F.lit("-- d /*")).otherwise(F.col("content"))
    return S.meaningful(lines.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.col("content")).otherwise(odd))).select("path")


def ref_sql_completion(spark, sf_dir):
    f = made(spark, sf_dir, SQL_FILES)
    given, symbols = (spark.sql(x.replace(" f ", " {f} "), f=f) for x in (SQL_GIVEN, SQL_SYMBOLS))
    meaning = f.where("doc_id % 2 = 0").where(T.suffix(F.col("path")) == "sql").select("path", "change_type")
    return S.completed_changes(given, symbols, f, meaning)


#: Views of nations over tables of regions, views of suppliers over those, and plain queries of customers over these.
SQL_TEXTS = """SELECT 'n/' || cast(n_nationkey AS string) || '.sql' AS path, 'create view d.n' || cast(n_nationkey AS string) || ' as' || chr(10) || 'select a, b.* except (x) from d.r' || cast(n_regionkey AS string) || ' as b' AS content FROM {nation}
  UNION ALL SELECT 's/' || cast(s_suppkey AS string) || '.sql', 'create view d.s' || cast(s_suppkey AS string) || ' as' || chr(10) || 'select t.k from ' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'd.' END || 'n' || cast(s_nationkey AS string) || ' t' FROM {supplier}
  UNION ALL SELECT 'c/' || cast(c_custkey AS string) || '.sql', '-- ' || c_name || chr(10) || 'select q.k, d.f' || cast(c_nationkey AS string) || '(1) from d.s' || cast(c_custkey % (SELECT count(*) FROM {supplier}) + 1 AS string) || ' as q' FROM {customer}"""


def ref_reference_search(spark, sf_dir):
    files = made(spark, sf_dir, SQL_TEXTS)
    rows, lines = P.cut(lineage(files)), C.numbered(files)
    targets = made(spark, sf_dir, "SELECT 'd.R' || cast(r_regionkey AS string) AS target, 'table' AS symbol_type FROM {region} UNION ALL SELECT 'd.f' || cast(n_nationkey AS string), 'function' FROM {nation} WHERE n_nationkey < 3")
    found = R.search(rows, lines, targets, P.cut)
    return found.select("target", "confidence", "dependency_kind", "dependency_depth", F.array_join("dependency_path", ">").alias("way"), "via", "path", "line", F.length("content").alias("n"), "name")


def ref_column_references(spark, sf_dir):
    rows = P.cut(lineage(made(spark, sf_dir, SQL_TEXTS)))
    targets = made(spark, sf_dir, "SELECT t AS target, 'column' AS symbol_type FROM (SELECT 'd.r1.a' AS t UNION ALL SELECT 'r2.a' UNION ALL SELECT 'd.r3.x' UNION ALL SELECT 'd.r3.y' UNION ALL SELECT 'k' UNION ALL SELECT 'x' UNION ALL SELECT 'z' UNION ALL SELECT 'd.n4.k' UNION ALL SELECT 'd.r1.a.b') v")
    found = R.match(R.candidates(rows), targets)
    return found.select("target", "path", "line", "what", F.col("sure").alias("confidence")).distinct()


def ref_reference_counts(spark, sf_dir):
    return R.counts(ref_reference_search(spark, sf_dir))


PIECES = """SELECT 's' || cast(l_suppkey AS string) AS path, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber = 3 THEN '' ELSE l_returnflag || l_linestatus || cast(l_partkey % 5 AS string) END AS purpose,
  CASE WHEN l_linenumber > 2 THEN l_linestatus ELSE l_returnflag || l_linestatus END AS data_flow, cast(l_partkey % 7 AS string) AS a, l_returnflag AS b FROM {lineitem}"""


def ref_merge_documents(spark, sf_dir):
    pieces = made(spark, sf_dir, PIECES).withColumn("main_components", F.array("a", "b"))
    return listed(D.merge(pieces, ["purpose", "data_flow"], ["main_components"]), "main_components")


RESULTS = "SELECT 'docs-shard-' || cast(o_custkey % 40 AS string) AS shard_id, cast(o_orderkey AS string) AS unit_id, o_orderstatus AS reason FROM {orders}"


def shard_results(spark, sf_dir) -> DataFrame:
    rows = made(spark, sf_dir, RESULTS)
    failed = F.collect_list(F.when(F.col("reason") == "F", F.struct("unit_id", "reason")))
    files = F.collect_list(F.struct(F.concat(F.lit("f"), (F.col("unit_id").cast("long") % 50).cast("string")).alias("path"), F.col("reason").alias("purpose")))
    return rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("processed_units"), failed.alias("failed_units"), F.slice(files, 1, 10_000_000).alias("files"))


def ref_failures(spark, sf_dir):
    return D.failures(shard_results(spark, sf_dir))


def ref_shard_problems(spark, sf_dir):
    expected = made(spark, sf_dir, "SELECT DISTINCT 'docs-shard-' || cast(n_nationkey * 2 AS string) AS shard_id FROM {nation}")
    results = made(spark, sf_dir, "SELECT DISTINCT 'docs-shard-' || cast(o_custkey % 40 AS string) AS shard_id, o_orderstatus FROM {orders} WHERE o_custkey % 40 > 5 AND (o_custkey % 2 = 0 OR o_orderstatus = 'O')")
    return D.shard_problems(results, expected)


def ref_run_statistics(spark, sf_dir):
    from quarry.plans import registry

    return D.statistics(registry.ref_changes(spark, sf_dir), 300)


def ref_selected_files(spark, sf_dir):
    from quarry.plans import registry

    return D.selected(registry.ref_changes(spark, sf_dir), 300)


def ref_manifest(spark, sf_dir):
    units = made(spark, sf_dir, "SELECT 'docs-shard-' || cast(o_custkey % 20 AS string) AS shard_id, 'u' || cast(o_orderkey AS string) AS unit_id, o_custkey % 90 AS lines, o_orderkey % 900 AS chars, o_custkey % 9 AS risk FROM {orders}")
    return D.manifest(units).withColumn("unit_ids", F.sha2(F.array_join("unit_ids", ","), 256))


def ref_stale_plan(spark, sf_dir):
    planned = made(spark, sf_dir, "SELECT 'u' || cast(o_orderkey % 5000 AS string) AS unit_id FROM {orders} WHERE o_orderstatus <> 'P'")
    return D.stale_units(planned, made(spark, sf_dir, "SELECT 'u' || cast(l_orderkey % 5001 AS string) AS unit_id FROM {lineitem} WHERE l_linenumber > 5"))


BATCH_FILES = "SELECT o_custkey % 50 AS batch, 'f' || cast(o_orderkey % 700 AS string) AS path FROM {orders}"
BATCH_SYMBOLS = "SELECT c_nationkey AS batch, 's' || cast(c_custkey % 300 AS string) AS symbol FROM {customer}"
IMPACTS = "SELECT event_id AS impact, 'f' || cast(user_id % 900 AS string) AS changed_file, 's' || cast(event_id % 400 AS string) AS symbol FROM {events}"


def ref_batch_impacts(spark, sf_dir):
    files, symbols, impacts = (made(spark, sf_dir, x) for x in (BATCH_FILES, BATCH_SYMBOLS, IMPACTS))
    return E.batch_impacts(files, symbols, impacts)


def ref_batch_context(spark, sf_dir):
    context = made(spark, sf_dir, "SELECT 'f' || cast(s_suppkey AS string) AS path, s_name AS summary FROM {supplier}")
    return E.batch_context(made(spark, sf_dir, BATCH_FILES), context)


USAGE = "SELECT l_orderkey, 'f' || cast(l_orderkey % 10 AS string) AS own, CASE WHEN l_linenumber = 2 THEN '' ELSE 'f' || cast(l_suppkey % 10 AS string) END AS used, l_returnflag AS side FROM {lineitem}"


def ref_usage_files(spark, sf_dir):
    side = lambda r: F.collect_set(F.when(F.col("side") == r, F.col("used")))
    rows = made(spark, sf_dir, USAGE).groupBy("l_orderkey", "own").agg(side("A").alias("a"), side("N").alias("n"), side("R").alias("r"))
    return rows.select("l_orderkey", F.array_join(E.usage_files(F.col("a"), F.col("n"), F.col("r"), own=F.col("own")), ",").alias("files"))


def ref_file_count(spark, sf_dir):
    return E.reviewed_files((made(spark, sf_dir, BATCH_FILES), "path"), (made(spark, sf_dir, IMPACTS), "changed_file"), (made(spark, sf_dir, USAGE), "used"), (made(spark, sf_dir, USAGE), "own"))


CHANGES = """SELECT 'f' || cast(o_orderkey % 60 AS string) AS file, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 's' || cast(o_custkey % 30 AS string) END AS symbol, CASE o_custkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'function' WHEN 2 THEN 'variable' ELSE 'table' END AS symbol_type,
  CASE WHEN o_orderstatus = 'F' THEN 'added' ELSE 'modified' END AS change_type FROM {orders} WHERE o_orderkey % 3 <> 1 OR o_custkey % 4 <> 0"""
USES = "SELECT 'f' || cast(o_orderkey % 60 AS string) AS changed_file, 's' || cast(o_custkey % 45 AS string) AS symbol, CASE WHEN o_custkey % 6 = 0 THEN '' ELSE 'f' || cast(o_custkey % 80 AS string) END AS used FROM {orders} WHERE o_orderkey % 11 < 2"


def ref_relevance_policy(spark, sf_dir):
    uses = made(spark, sf_dir, USES).groupBy("changed_file", "symbol").agg(F.collect_list("used").alias("files"))
    return E.relevance(made(spark, sf_dir, CHANGES), uses)


REFERENCES = "SELECT 's' || cast(l_partkey % 90 AS string) AS symbol, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'f' || cast(l_partkey % 7 AS string) END AS changed_file, CASE WHEN l_partkey % 90 % 3 = 0 THEN 'function' ELSE 'table' END AS symbol_type, 'f' || cast(l_suppkey % 9 AS string) AS path, CASE WHEN l_linenumber < 4 THEN l_linenumber END AS line FROM {lineitem}"
OLD_IMPACTS = "SELECT s_suppkey AS ord, 's' || cast(s_suppkey % 60 AS string) AS symbol, 'table' AS symbol_type, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'f' || cast(s_suppkey % 7 AS string) END AS changed_file, 'f' || cast(s_nationkey AS string) AS file, 'old:1' AS evidence FROM {supplier}"


def ref_evidence_lines(spark, sf_dir):
    return listed(E.evidence_lines(made(spark, sf_dir, REFERENCES), ["symbol", "changed_file"]), "files", "lines")


def ref_evidence_upsert(spark, sf_dir):
    refs = made(spark, sf_dir, REFERENCES)
    found = E.evidence_lines(refs, ["symbol", "symbol_type", "changed_file"])
    impacts = made(spark, sf_dir, OLD_IMPACTS).withColumns({"files": F.array("file"), "evidence": F.array("evidence")})
    return listed(E.with_evidence(impacts, found), "files", "evidence", "external")


FINDINGS = "SELECT event_id AS finding, 'f' || cast(user_id % 40 AS string) AS file, CASE WHEN event_id % 3 = 0 THEN 's' || cast(event_id % 20 AS string) END AS symbol, 'about s' || cast(event_id % 30 AS string) || ' only' AS message FROM {events}"
SHOWN_IMPACTS = "SELECT c_custkey AS ord, 'f' || cast(c_custkey % 55 AS string) AS changed_file, 's' || cast(c_nationkey + 7 AS string) AS symbol FROM {customer} WHERE c_custkey % 55 > 3 OR c_custkey < 55"
SHOWN_CHANGES = "SELECT o_orderkey AS ord, 'f' || cast(o_custkey % 50 AS string) AS file, 's' || cast(o_orderkey % 33 AS string) AS symbol FROM {orders}"


def ref_report_lookup(spark, sf_dir):
    return E.report_rows(*(made(spark, sf_dir, x) for x in (FINDINGS, SHOWN_IMPACTS, SHOWN_CHANGES)))


def ref_prefetch(spark, sf_dir):
    items = made(spark, sf_dir, "SELECT user_id, event_id AS ord, props, event_type FROM {events}")
    return E.prefetched(items, "user_id", F.length(F.concat("event_type", "props")), 40, 300).select("user_id", "ord")


MESSAGES = """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Error 503: retry in 2.5s ' || text WHEN 1 THEN '"retryDelay": "' || cast(turn AS string) || 's" code 429 ' || text WHEN 2 THEN 'HTTP 1503 4290 ' ELSE text END AS message, (conv_id + turn) % 5 AS k FROM {conversations}"""


def ref_model_errors(spark, sf_dir):
    rows = made(spark, sf_dir, MESSAGES).where("k < 3")
    m, delay = F.col("message"), T.retry_delay(F.col("message"))
    return rows.select("conv_id", "turn", delay.alias("delay"), F.when(F.col("k") < 2, F.substring(T.http_status(m), 1, 1)).otherwise(T.http_status(m)).alias("status"), F.sha2(T.compact(m, 100), 256).alias("compact"), T.backoff(F.lit(2.0), F.col("k"), delay).alias("wait"))


def ref_bounded(spark, sf_dir):
    rows = made(spark, sf_dir, "SELECT conv_id, turn, role, text FROM {conversations}")
    return rows.select("conv_id", "turn", T.bounded(F.concat_ws(":", "role", "text"), 200).alias("b")).select("conv_id", "turn", "b.truncated", F.length("b.content").alias("n"))


JSON_TEXTS = r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN o WHEN 1 THEN '```json' || chr(10) || o || chr(10) || '```' WHEN 2 THEN 'It is {so} and ' || o || ' ok' WHEN 3 THEN '[' || o || ']' WHEN 4 THEN 'none {' || event_type ELSE '```' || chr(10) || o END AS t, event_id % 6 AS k, p
  FROM (SELECT event_id, event_type, '{"b": [{"path": "' || event_type || '"}], "path": "p' || cast(user_id AS string) || '"}' AS o, event_type || ',p' || cast(user_id AS string) AS p FROM events_) v"""


def ref_json_objects(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.createOrReplaceTempView("events_")
    return listed(E.json_objects(spark.sql(JSON_TEXTS), "event_id", "t"), "paths")


PYTHON_FILES = """SELECT cast(o_orderkey AS string) || CASE WHEN o_custkey % 10 = 0 THEN '.go' ELSE '.py' END AS path, CASE o_orderkey % 4 WHEN 0 THEN 'x = ' || cast(o_custkey AS string) WHEN 1 THEN 'a = 1' || chr(10) || 'def f(:' WHEN 2 THEN 'def f():' || chr(10) || '    return ' || cast(o_custkey AS string) || chr(10) ELSE 'import os' || chr(10) || chr(10) || 'x = = 2' END AS content,
  o_orderkey % 4 AS k, o_custkey % 10 AS g FROM {orders}"""


def ref_python_findings(spark, sf_dir):
    return E.python_findings(made(spark, sf_dir, PYTHON_FILES))


PAYLOADS = f"SELECT doc_id, {PATH} AS path, CASE n_chars % 9 WHEN 0 THEN 'vendor/x.py' WHEN 1 THEN 'a/b.min.js' WHEN 2 THEN 'A.PY' WHEN 3 THEN 'x/y/z.go' WHEN 4 THEN 'docs/README.markdown' WHEN 5 THEN 'c.h' WHEN 6 THEN 'k.Swift' ELSE {PATH} END AS odd, doc_id % 4 = 0 AS is_binary, doc_id % 5 = 0 AS removed, doc_id % 3 = 0 AS added, doc_id % 2 = 0 AS renamed FROM {{documents}}"


def ref_review_filter(spark, sf_dir):
    p = F.col("odd")
    return made(spark, sf_dir, PAYLOADS).where(~F.col("is_binary") & T.supported(p) & ~T.skipped(p)).select("doc_id", "odd")


def ref_paths(spark, sf_dir):
    p = F.col("odd")
    kind = T.change_type(*(F.col(c) for c in ("is_binary", "removed", "added", "renamed")))
    return made(spark, sf_dir, PAYLOADS).select("doc_id", T.language(p).alias("language"), T.is_markdown(p).alias("markdown"), kind.alias("change_type"), T.plain_change(kind).alias("plain"))


def ref_unit_ids(spark, sf_dir):
    from quarry.plans.registry import corpus

    facts = C.plan_facts(corpus(spark, sf_dir)).select("path", "risk")
    return P.unit_ids(facts, "risk", "path")


def ref_counterparts(spark, sf_dir):
    """Whether Spark has the function that stands for each name."""
    known = {r[0] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} | {"timestampadd", "timestampdiff", "try_cast"}
    rows = [(k, v, v in known) for k, v in sorted(COUNTERPARTS.items()) if v]
    return spark.createDataFrame(rows, "name string, spark string, found boolean")


def document_diffs(spark, sf_dir) -> DataFrame:
    """A diff for each document: all its lines, ten to a hunk, each fourth one added and each fourth removed; some new files, some only renamed."""
    from quarry.plans.registry import corpus

    files = corpus(spark, sf_dir).select("path", "doc_id", T.lines(F.col("content")).alias("l"))

    def hunk(h):
        part = F.slice(F.col("l"), h * 10 + 1, F.lit(10))
        mark = lambda x, i: F.concat(F.when(i % 4 == 0, "+").when(i % 4 == 1, "-").otherwise(" "), x)
        rows = F.transform(part, mark)
        n = lambda *away: F.size(F.filter(rows, lambda r: ~F.substring(r, 1, 1).isin(*away))).cast("string")
        at = (h * 10 + 1).cast("string")
        return F.concat(F.lit("@@ -"), at, F.lit(","), n("+"), F.lit(" +"), at, F.lit(","), n("-"), F.lit(" @@ h"), (h + 1).cast("string"), F.lit("\n"), F.array_join(rows, "\n"), F.lit("\n"))

    hunks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 10).cast("int")), hunk), "")
    new = F.when(F.col("doc_id") % 5 == 0, F.lit("new file mode 100644\n--- /dev/null\n")).otherwise(F.concat(F.lit("--- a/"), "path", F.lit("\n")))
    body = F.concat(new, F.lit("+++ b/"), "path", F.lit("\n"), hunks, F.lit("\\ No newline at end of file\n"))
    moved = F.concat(F.lit("rename from old/"), "path", F.lit("\nrename to "), "path", F.lit("\n"))
    text = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"), F.when((F.col("doc_id") % 7 == 0) | (F.size("l") == 0), moved).otherwise(body))
    return files.select(F.col("path").alias("diff_id"), text.alias("diff"))


def ref_diff_lines(spark, sf_dir):
    lines = diffs.diff_lines(document_diffs(spark, sf_dir))
    return lines.select("diff_id", "path", "source_file", "change_type", "hunk", "section", "source_length", "target_length", "line", "kind", "source_line", "target_line", F.length("content").alias("n"))


def ref_diff_files(spark, sf_dir):
    files = diffs.diff_files(diffs.diff_lines(document_diffs(spark, sf_dir), 50))
    return files.select("path", "change_type", "added_lines", "deleted_lines", "review_lines", "n_hunks", "truncated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("ref_")}
