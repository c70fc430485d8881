"""Queries over the driver's tables and their SQL equivalents.

A corpus of files is made of the documents: the path holds source and language, the suffix follows the language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C
from quarry.operators import packing as P
from quarry.operators.lineage import lineage
from quarry.plans import relational

SUFFIX_OF = {"en": "py", "de": "sql", "fr": "go"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, doc_id, content) of all documents."""
    docs = table(spark, sf_dir, "documents")
    end = T.lookup(F.col("lang"), SUFFIX_OF, "md")
    return docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), end).alias("path"), "doc_id", F.col("text").alias("content"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.plan_facts(corpus(spark, sf_dir))


def ref_inventory(spark, sf_dir):
    return C.inventory(corpus(spark, sf_dir))


def ref_lines(spark, sf_dir):
    return C.numbered(corpus(spark, sf_dir), 500).withColumn("content", F.sha2(F.col("content").cast("binary"), 256))


def ref_section(spark, sf_dir):
    return C.section(corpus(spark, sf_dir), 3, 12, 5).withColumn("content", F.length("content"))


def ref_plan_facts(spark, sf_dir):
    return C.plan_facts(corpus(spark, sf_dir))


def _index(spark, sf_dir):
    """An earlier index: labelled documents, those of quality 0 with another hash, and one path of each label that has gone."""
    files, labels = corpus(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality")
    h = F.sha2(F.concat(F.col("content"), F.when(F.col("quality") == 0, "~").otherwise("")).cast("binary"), 256)
    known = files.join(labels, "doc_id").select("path", h.alias("sha256"))
    gone = labels.select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path"), F.lit("x").alias("sha256"))
    return known.union(gone)


def ref_changes(spark, sf_dir):
    return C.changes(corpus(spark, sf_dir), _index(spark, sf_dir))


def ref_deleted(spark, sf_dir):
    return C.deleted(corpus(spark, sf_dir), _index(spark, sf_dir))


#: Lines that trigger the rules on SQL, made of all lines: some end with a comma or begin a clause, letters stand for marks.
SQL_LINE = "translate(CASE line % 7 WHEN 2 THEN content || ',' WHEN 3 THEN 'from ' || content WHEN 5 THEN '' WHEN 6 THEN '  -- ' || content ELSE content END, 'qzw', chr(39) || '()')"


def ref_sql_findings(spark, sf_dir):
    return C.sql_findings(P.cut(C.numbered(corpus(spark, sf_dir)).withColumn("content", F.expr(SQL_LINE))))


#: Lines of languages with braces, made of all lines.
C_LINE = """CASE line % 8 WHEN 1 THEN 'public class ' || w || ' {' WHEN 2 THEN '  if (' || w || ' = 1);' WHEN 3 THEN 'int ' || w WHEN 4 THEN w || '.call(1)' WHEN 5 THEN '}' WHEN 6 THEN 'if (' || w || ' == 1) ;' WHEN 7 THEN 'static int ' || w || '(int a)' ELSE content END"""


def ref_c_style_findings(spark, sf_dir):
    lines = C.numbered(corpus(spark, sf_dir)).withColumn("w", F.regexp_extract("content", "([A-Za-z]+)", 1)).withColumn("content", F.expr(C_LINE))
    lang = F.when(F.col("path").endswith(".py"), "java").when(F.col("path").endswith(".sql"), "csharp").otherwise("go")
    return C.c_style_findings(lines.withColumn("language", lang))


def ref_first_finding(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return C.first_of(ev.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


def ref_occurrences(spark, sf_dir):
    return C.occurrences_without_definitions(C.numbered(corpus(spark, sf_dir)), "the", T.strip(F.col("content")).startswith("The")).select("path", "line")


def ref_around(spark, sf_dir):
    lines = C.numbered(corpus(spark, sf_dir))
    return C.around(lines, lines.where(F.contains("content", F.lit("worthless"))), 2).select("path", "mark", "line", F.length("content").alias("n"))


def ref_fold_changes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "removed").otherwise("context")
    ev = li.withColumn("kind", kind).where("kind <> 'context'").select("l_partkey", "l_suppkey", "kind", "l_linenumber")
    out = C.fold_changes(ev, ["l_partkey", "l_suppkey"], "kind", "l_linenumber")
    return out.withColumns({c: F.array_join(c, ",") for c in ("source_lines", "target_lines")})


def ref_side_changes(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("effect", F.when(F.col("event_type").isin("click", "view"), "present").when(F.col("event_type") == "error", "absent"))
    ev = ev.where("effect is not null")
    return C.side_changes(ev.where("value < 50"), ev.where("value >= 50"), ["user_id"])


def ref_chunks(spark, sf_dir):
    return C.chunk_spans(C.plan_facts(corpus(spark, sf_dir)), 40, 5)


def ref_shard_count(spark, sf_dir):
    return C.shard_count(C.plan_facts(corpus(spark, sf_dir)))


def ref_tiered_limit(spark, sf_dir):
    facts = C.plan_facts(corpus(spark, sf_dir)).select("path", "risk", "n_lines")
    return C.tiered_limit(facts, F.when(F.col("risk") > 0, 0).otherwise(1), [F.col("path")], 100)


def ref_context_budget(spark, sf_dir):
    return C.budget(corpus(spark, sf_dir), [T.priority(F.col("path")), F.lower("path")])


def ref_integrity(spark, sf_dir):
    return C.integrity(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k")), "k")


def _names(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier")
    nr = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    full = nr.join(s, s["s_nationkey"] == n["n_nationkey"]).select(
        F.concat_ws(".", "r_name", "n_name", F.concat(F.lit("t"), (F.col("s_suppkey") % 7).cast("string"))).alias("name"), F.when(F.col("s_acctbal") > 0, "confirmed").otherwise("possible").alias("confidence")
    )
    return full.distinct(), nr


def ref_object_match(spark, sf_dir):
    full, nr = _names(spark, sf_dir)
    less = full.select(F.concat(F.element_at(F.split("name", r"\."), 2), F.lit("."), F.element_at(F.split("name", r"\."), 3)).alias("name"), "confidence").distinct()
    bare = full.select(F.element_at(F.split("name", r"\."), 3).alias("name"), "confidence").distinct()
    targets = nr.select(F.concat_ws(".", "r_name", "n_name", F.lit("T1")).alias("name")).union(nr.select(F.concat_ws(".", F.lower("n_name"), F.lit("t2")).alias("name"))).union(nr.select(F.lit("t3").alias("name")).distinct())
    return C.object_match(targets, full.union(less).union(bare)).distinct()


def ref_closure(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    at = lambda tag, k: F.concat(F.lit(tag), F.col(k).cast("string"))
    sure = lambda k: F.when(F.col(k) > 0, "confirmed").otherwise("possible").alias("confidence")
    edges = n.select(at("r", "n_regionkey").alias("src"), at("n", "n_nationkey").alias("dst"), F.lit("confirmed").alias("confidence"))
    edges = edges.union(s.select(at("n", "s_nationkey"), at("s", "s_suppkey"), sure("s_acctbal"))).union(c.select(at("n", "c_nationkey"), at("c", "c_custkey"), sure("c_acctbal")))
    edges = edges.union(s.select(at("s", "s_suppkey"), at("n", "s_nationkey"), F.lit("possible")))
    return C.closure(edges, r.select(at("r", "r_regionkey").alias("node")), P.cut)


def ref_relevance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sets = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("external_files"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("added_files"))
    return C.relevance(sets).select("l_orderkey", "relevance", F.array_join(F.array_sort(F.array_except("external_files", "added_files")), ",").alias("outside"), F.array_join(F.array_sort(F.array_intersect("external_files", "added_files")), ",").alias("inside"))


def ref_report(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return C.report(ev, "user_id", ["ts", "event_id"], F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))


def ref_markers(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    t = F.col("text")
    return conv.select("conv_id", "turn", T.any_mark(t, T.TRANSIENT).alias("transient"), T.any_mark(t, T.DAILY_QUOTA).alias("daily"), F.length(T.shorten(t, 400, "...")).alias("n"), T.clamp(F.substring(t, 1, 2), 4, 1, 20).alias("clamped"))


def ref_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k long").getField("k").alias("k"), (F.length("props") > 7).alias("long_props"))


#: A statement for each document, of one of three shapes, with names from its text.
STATEMENTS = {
    0: "'create view d.v' || id || ' as select t.' || w || ', count(*) as n from d.' || source || ' t join (select k from other) o on o.k = t.a where t.b > 1'",
    1: "'insert into d.' || w || '_out select ' || w || ' from p.d.' || source || ' -- ' || w",
    2: "'with c as (select z from d.' || source || ') select c.z, d.' || w || '(1) from c; drop table d.' || w",
}


def ref_lineage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"id": F.col("doc_id").cast("string"), "w": F.concat(F.lit("x"), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)))})
    made = F.expr("CASE n_chars % 3 " + " ".join(f"WHEN {k} THEN {v}" for k, v in STATEMENTS.items()) + " END")
    return lineage(docs.select(F.col("id").alias("path"), made.alias("content"))).select("path", "record", "statement", "scope", "name", "kind", "confidence", "alias", "column", "clause")


def _owned() -> dict[str, Callable]:
    return {k: v for k, v in globals().items() if k.startswith("ref_")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry.plans import review

    return _owned() | P.queries(corpus) | review.queries() | relational.queries()


LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
FILE_LINE_END = r"\r\n|[\n\r]"
SPACE = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"

CORPUS = f"""
WITH RECURSIVE files AS (
  SELECT source || '/' || lang || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'sql' WHEN 'fr' THEN 'go' ELSE 'md' END AS path, doc_id, text AS content FROM documents
), cut AS (
  SELECT path, doc_id, content, CASE WHEN coalesce(content, '') = '' THEN [] WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls
  FROM (SELECT *, regexp_split_to_array(content, '{LINE_END}') AS parts FROM files)
), lines AS (
  SELECT path, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS content FROM cut
), stripped AS (
  SELECT path, line, content, regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') AS s FROM lines
)
"""
_HASH = "sha256(content)"
INDEX = """, idx AS (
  SELECT path, sha256(content || CASE WHEN quality = 0 THEN '~' ELSE '' END) AS sha256 FROM files JOIN labels USING (doc_id)
  UNION ALL SELECT 'gone/' || doc_id, 'x' FROM labels
)"""
_RISK = " + ".join(
    ["CASE WHEN length(content) > 45000 THEN 4 WHEN length(content) > 20000 THEN 2 ELSE 0 END"]
    + [f"CASE WHEN contains(lower(path), '{w}') THEN 3 ELSE 0 END" for w in T.RISK_PATH]
    + [f"CASE WHEN contains(lower(content), '{w}') THEN 5 ELSE 0 END" for w in T.RISK_CONTENT]
)
FACTS = f""", facts AS (
  SELECT path, len(ls) AS n_lines, length(content) AS n_chars,
    CASE WHEN len(ls) <= 250 AND length(content) <= 12000 THEN 'small' WHEN len(ls) <= 900 AND length(content) <= 45000 THEN 'medium' ELSE 'large' END AS size_class,
    {_RISK} AS risk, {_HASH} AS sha256,
    substr(regexp_replace(string_split(path, '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || '.' || substr(sha256(path), 1, 16) || '.json' AS file_name
  FROM cut)"""


def _count(c: str, what: str) -> str:
    return f"((length({c}) - length(replace({c}, '{what}', ''))) // {len(what.replace(chr(39) * 2, chr(39)))})"


ORACLE = {
    "ref_inventory": CORPUS + "SELECT path, CASE split_part(path, '.', -1) WHEN 'py' THEN 'python' ELSE split_part(path, '.', -1) END AS language, CASE WHEN content = '' THEN 0 WHEN fl[-1] = '' THEN len(fl) - 1 ELSE len(fl) END AS line_count FROM (SELECT *, regexp_split_to_array(content, '" + FILE_LINE_END + "') AS fl FROM cut) WHERE NOT path LIKE '%.md' AND content IS NOT NULL",
    "ref_lines": CORPUS + f"SELECT path, line, {_HASH} AS content, n > 500 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM lines) WHERE line <= 500",
    "ref_section": CORPUS + "SELECT path, line, length(content) AS content, n AS total_lines FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM lines) WHERE line BETWEEN 3 AND 7",
    "ref_plan_facts": CORPUS + FACTS + " SELECT * FROM facts",
    "ref_changes": CORPUS + INDEX + f""" SELECT coalesce(f.path, idx.path) AS path, CASE WHEN f.path IS NULL THEN 'deleted' WHEN idx.path IS NULL THEN 'new' WHEN {_HASH} <> idx.sha256 THEN 'changed' ELSE 'unchanged' END AS status
      FROM files f FULL JOIN idx ON f.path = idx.path""",
    "ref_deleted": CORPUS + INDEX + " SELECT * FROM idx WHERE path NOT IN (SELECT path FROM files)",
    "ref_sql_findings": CORPUS + f""", coded AS (SELECT path, line, {SQL_LINE} AS content FROM lines), s2 AS (SELECT path, line, regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') AS s FROM coded),
      v AS (SELECT *, {_count('s', "''")} - 2 * {_count('s', "''''")} AS q, {_count('s', '(')} - {_count('s', ')')} AS b FROM s2 WHERE NOT starts_with(s, '--')),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM v),
      walk AS (SELECT path, n, line, greatest(b, 0) AS bal, b < 0 AS f FROM ranked WHERE n = 1
        UNION ALL SELECT r.path, r.n, r.line, greatest(w.bal + r.b, 0), w.bal + r.b < 0 FROM walk w JOIN ranked r ON r.path = w.path AND r.n = w.n + 1),
      real AS (SELECT *, lag(s) OVER w AS was, lag(line) OVER w AS was_line FROM v WHERE s <> '' WINDOW w AS (PARTITION BY path ORDER BY line)),
      ends AS (SELECT v.path, sum(q) AS q, max(l.last) AS last, max(e.bal) AS bal FROM v JOIN (SELECT path, max(line) AS last FROM lines GROUP BY path) l ON l.path = v.path
        JOIN (SELECT path, arg_max(bal, n) AS bal FROM walk GROUP BY path) e ON e.path = v.path GROUP BY v.path)
      SELECT path, line, 'critical' AS severity, 'syntax_error' AS category, 'closing_parenthesis' AS rule FROM walk WHERE f
      UNION ALL SELECT path, was_line, 'critical', 'syntax_error', 'comma_before_clause' FROM real WHERE ends_with(was, ',') AND regexp_matches(s, '(?i)^(from|where|group\\s+by|order\\s+by|having|limit|union)\\b')
      UNION ALL SELECT path, last, 'critical', 'syntax_error', 'odd_quotes' FROM ends WHERE q % 2 <> 0
      UNION ALL SELECT path, last, 'critical', 'syntax_error', 'open_parenthesis' FROM ends WHERE bal > 0""",
    "ref_first_finding": "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "ref_occurrences": CORPUS + "SELECT path, line FROM stripped WHERE contains(content, 'the') AND NOT starts_with(s, 'The')",
    "ref_around": CORPUS + """, m AS (SELECT path, line FROM lines WHERE contains(content, 'worthless') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 3)
      SELECT l.path, m.line AS mark, l.line, length(l.content) AS n FROM lines l JOIN m ON m.path = l.path AND l.line BETWEEN m.line - 2 AND m.line + 2""",
    "ref_fold_changes": """SELECT l_partkey, l_suppkey, CASE WHEN bool_and(l_returnflag = 'A') THEN 'added' WHEN bool_and(l_returnflag = 'R') THEN 'deleted' ELSE 'modified' END AS change_type,
      coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END, ',' ORDER BY CASE WHEN l_returnflag = 'R' THEN l_linenumber END), '') AS source_lines,
      coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_linenumber END, ',' ORDER BY CASE WHEN l_returnflag = 'A' THEN l_linenumber END), '') AS target_lines
      FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""",
    "ref_side_changes": """WITH e AS (SELECT user_id, value < 50 AS is_base, CASE WHEN event_type IN ('click', 'view') THEN 'present' ELSE 'absent' END AS effect FROM events WHERE event_type IN ('click', 'view', 'error')),
      f AS (SELECT user_id, is_base, CASE WHEN count(DISTINCT effect) > 1 THEN 'modified' ELSE min(effect) END AS x FROM e GROUP BY 1, 2),
      j AS (SELECT coalesce(b.user_id, h.user_id) AS user_id, b.x AS base, h.x AS head FROM (SELECT * FROM f WHERE is_base) b FULL JOIN (SELECT * FROM f WHERE NOT is_base) h USING (user_id)),
      t(b, h, c) AS (VALUES ('none','present','added'),('none','absent','deleted'),('none','modified','modified'),('present','none','deleted'),('present','present','modified'),('present','absent','deleted'),('present','modified','modified'),
        ('absent','none','added'),('absent','present','added'),('absent','modified','modified'),('modified','none','modified'),('modified','present','modified'),('modified','absent','modified'),('modified','modified','modified'))
      SELECT user_id, base, head, c AS change_type FROM j JOIN t ON b = coalesce(base, 'none') AND h = coalesce(head, 'none')""",
    "ref_chunks": CORPUS + """SELECT path, k + 1 AS part, 1 + 35 * k AS start_line, least(40 + 35 * k, n) AS end_line
      FROM (SELECT path, len(ls) AS n, unnest(range(0, CAST(ceil(greatest(len(ls) - 40, 0) / 35) AS BIGINT) + 1)) AS k FROM cut WHERE len(ls) > 0)""",
    "ref_shard_count": CORPUS + """SELECT count(*) AS n_units, sum(len(ls)) AS total_lines, sum(length(content)) AS total_chars,
      least(20, count(*), greatest(1, CAST(ceil(sum(len(ls)) / 6000) AS BIGINT), CAST(ceil(sum(length(content)) / 300000) AS BIGINT), CAST(ceil(count(*) / 24) AS BIGINT))) AS n_shards FROM cut""",
    "ref_tiered_limit": CORPUS + FACTS + """ SELECT path, risk, n_lines, row_number() OVER (ORDER BY risk = 0, path) AS rank, (SELECT count(*) > 100 FROM facts) AS truncated FROM facts QUALIFY rank <= 100""",
    "ref_context_budget": CORPUS + f""", top AS (SELECT path, length(content) AS n, row_number() OVER (ORDER BY lower(path), path) AS rank FROM files WHERE regexp_matches(content, '[^{SPACE[1:-1]}]') QUALIFY rank <= 5),
      b AS (SELECT path, rank, n, CAST(least(8000, n) AS BIGINT) AS used, n > 8000 AS cut, CAST(24000 - least(8000, n) - CASE WHEN n > 8000 THEN {len(C.CUT_NOTE)} ELSE 0 END AS BIGINT) AS room FROM top WHERE rank = 1
        UNION ALL SELECT t.path, t.rank, t.n, least(8000, b.room, t.n), t.n > least(8000, b.room), b.room - least(8000, b.room, t.n) - CASE WHEN t.n > least(8000, b.room) THEN {len(C.CUT_NOTE)} ELSE 0 END FROM b JOIN top t ON t.rank = b.rank + 1 WHERE b.room > 0)
      SELECT path, rank, used, cut FROM b""",
    "ref_integrity": """SELECT coalesce(l.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'unknown' WHEN l.k IS NULL THEN 'missing' ELSE 'duplicate' END AS problem
      FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') o ON l.k = o.k WHERE o.k IS NULL OR l.k IS NULL OR n > 1""",
    "ref_object_match": """WITH nr AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
      f AS (SELECT DISTINCT lower(r_name) AS r, lower(n_name) AS n, 't' || s_suppkey % 7 AS t, r_name || '.' || n_name || '.t' || s_suppkey % 7 AS full_name, n_name || '.t' || s_suppkey % 7 AS less, CASE WHEN s_acctbal > 0 THEN 'confirmed' ELSE 'possible' END AS c FROM nr JOIN supplier ON s_nationkey = n_nationkey),
      cand AS (SELECT full_name AS name, c, r, n, t FROM f UNION SELECT less, c, NULL, n, t FROM f UNION SELECT t, c, NULL, NULL, t FROM f),
      m AS (SELECT r_name || '.' || n_name || '.T1' AS target, cand.name AS candidate, cand.c AS cc, 'confirmed' AS m FROM nr JOIN cand ON cand.t = 't1' AND cand.r = lower(r_name) AND cand.n = lower(n_name)
        UNION SELECT lower(n_name) || '.t2', cand.name, cand.c, CASE WHEN cand.n IS NULL THEN 'possible' ELSE 'confirmed' END FROM nr JOIN cand ON cand.t = 't2' AND (cand.n IS NULL OR cand.n = lower(n_name))
        UNION SELECT 't3', name, c, 'possible' FROM cand WHERE t = 't3')
      SELECT DISTINCT target, candidate, CASE WHEN cc <> 'confirmed' THEN 'possible' ELSE m END AS confidence FROM m""",
    "ref_closure": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 0 AS c FROM nation
        UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier),
      w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS c, 0 AS depth FROM region UNION SELECT root, e.dst, greatest(w.c, e.c), depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 5)
      SELECT root, node, min(depth) FILTER (WHERE c = best) AS depth, CASE WHEN best = 0 THEN 'confirmed' ELSE 'possible' END AS confidence
      FROM (SELECT *, min(c) OVER (PARTITION BY root, node) AS best FROM w WHERE depth > 0) GROUP BY root, node, best""",
    "ref_relevance": """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS x, coalesce(list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag = 'N')), []) AS a FROM lineitem GROUP BY 1),
      p AS (SELECT l_orderkey, list_filter(x, lambda v: NOT list_contains(a, v)) AS o, list_filter(x, lambda v: list_contains(a, v)) AS i FROM s)
      SELECT l_orderkey, CASE WHEN len(o) > 0 THEN 'related' WHEN len(i) > 0 THEN 'unclear_new_files' ELSE 'unclear' END AS relevance, array_to_string(o, ',') AS outside, array_to_string(i, ',') AS inside FROM p""",
    "ref_report": "SELECT user_id, string_agg(event_type || ':' || event_id, chr(10) ORDER BY ts, event_id) AS report, count(*) AS n FROM events GROUP BY 1",
    "ref_markers": f"""SELECT conv_id, turn, {' OR '.join(f"contains(lower(text), '{m}')" for m in T.TRANSIENT)} AS transient, {' OR '.join(f"contains(lower(text), '{m}')" for m in T.DAILY_QUOTA)} AS daily,
      CASE WHEN length(text) > 400 THEN 103 ELSE length(text) END AS n, greatest(1, least(20, coalesce(try_cast(substr(text, 1, 2) AS INT), 4))) AS clamped FROM conversations""",
    "ref_c_style_findings": CORPUS + fr""", coded AS (SELECT path, line, {C_LINE} AS content, CASE x WHEN 'py' THEN 'java' WHEN 'sql' THEN 'csharp' ELSE 'go' END AS language FROM (SELECT *, regexp_extract(content, '([A-Za-z]+)', 1) AS w, split_part(path, '.', -1) AS x FROM lines)),
      c AS (SELECT *, regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') AS s, regexp_extract(content, '\bpublic\s+class\s+([A-Za-z_]\w*)', 1) AS named, split_part(string_split(path, '/')[-1], '.', 1) AS stem FROM coded),
      m AS (SELECT *, regexp_extract(s, '^\w+') AS word FROM c WHERE language IN ('java', 'csharp') AND s <> '' AND NOT regexp_matches(s, '[;{{}}:,]$') AND NOT regexp_matches(s, '^([*@]|//|/\*)'))
      SELECT path, line, 'critical' AS severity, 'syntax_error' AS category, 'class_name' AS rule FROM c WHERE language = 'java' AND named <> '' AND named <> stem
      UNION ALL SELECT path, line, 'high', 'logic_error', 'empty_if' FROM c WHERE regexp_matches(s, '^if\s*\(.*\)\s*;$')
      UNION ALL SELECT path, line, 'critical', 'syntax_error', 'assignment_in_if' FROM c WHERE language IN ('java', 'csharp') AND regexp_matches(s, '\bif\s*\([^)]*[^=!<>]=[^=][^)]*\)')
      UNION ALL SELECT path, line, 'critical', 'syntax_error', 'missing_semicolon' FROM m WHERE word NOT IN ({", ".join(f"'{x}'" for x in C.BLOCK_WORDS)})
        AND NOT (ends_with(s, ')') AND (word IN ({", ".join(f"'{x}'" for x in C.MODIFIERS)}) OR regexp_matches(s, '^[A-Za-z_][\w<>\[\], ?]*\s[A-Za-z_]\w*\s*\([^;{{}}]*$')))
        AND (word IN ({", ".join(f"'{x}'" for x in C.TYPE_WORDS)}) OR {" OR ".join(f"starts_with(s, '{x}')" for x in C.STATEMENT_STARTS)} OR contains(s, '=') OR (ends_with(s, ')') AND regexp_matches(s, '^[A-Za-z_]\w*\.[A-Za-z_]\w*\(')))
      UNION ALL SELECT path, max(line), 'critical', 'syntax_error', 'braces' FROM c GROUP BY path HAVING sum(length(s) - length(replace(s, '{{', '')) - length(s) + length(replace(s, '}}', ''))) <> 0""",
    "ref_batches": CORPUS + FACTS + """, r AS (SELECT path, n_lines, split_part(path, '.', -1) AS language, row_number() OVER (PARTITION BY split_part(path, '.', -1) ORDER BY path) AS i FROM facts),
      w AS (SELECT path, n_lines, language, i, 1 AS batch, n_lines AS held, 1 AS k FROM r WHERE i = 1
        UNION ALL SELECT r.path, r.n_lines, r.language, r.i, CASE WHEN w.k >= 5 OR w.held + r.n_lines > 1200 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.k >= 5 OR w.held + r.n_lines > 1200 THEN r.n_lines ELSE w.held + r.n_lines END,
          CASE WHEN w.k >= 5 OR w.held + r.n_lines > 1200 THEN 1 ELSE w.k + 1 END FROM w JOIN r ON r.language = w.language AND r.i = w.i + 1)
      SELECT language, path, n_lines, batch FROM w""",
    "ref_small_units": CORPUS + FACTS + """, r AS (SELECT path, n_lines, n_chars, split_part(path, '.', -1) AS language, row_number() OVER (PARTITION BY split_part(path, '.', -1) ORDER BY path) AS i FROM facts WHERE size_class = 'small'),
      w AS (SELECT path, language, i, CAST(1 AS BIGINT) AS spot, [{'k': 1, 'a': n_lines, 'b': n_chars}] AS us FROM r WHERE i = 1
        UNION ALL SELECT path, language, i, spot, CASE WHEN spot > len(us) THEN list_append(us, {'k': 1, 'a': n_lines, 'b': n_chars})
            ELSE list_concat(us[:spot - 1], list_concat([{'k': us[spot].k + 1, 'a': us[spot].a + n_lines, 'b': us[spot].b + n_chars}], us[spot + 1:])) END
          FROM (SELECT r.*, w.us, coalesce(list_position(list_transform(w.us, lambda u: u.k < 8 AND u.a + r.n_lines <= 900 AND u.b + r.n_chars <= 45000), true), len(w.us) + 1) AS spot FROM w JOIN r ON r.language = w.language AND r.i = w.i + 1))
      SELECT language, path, spot - 1 AS unit FROM w""",
    "ref_lineage": """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, source, 'x' || lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS w, n_chars % 3 AS k FROM documents),
      r(k, record, st, tail, name, kind, confidence, alias, col, clause) AS (VALUES
        (0, 'definition', 1, '', 'd.v@', 'view', 'confirmed', NULL, NULL, NULL), (0, 'source', 1, '', 'd.$', 'table', 'confirmed', 't', NULL, NULL), (0, 'source', 1, '/subquery:0', 'other', 'table', 'possible', NULL, NULL, NULL),
        (0, 'column', 1, '/subquery:0', 'other', 'table', 'possible', NULL, 'k', 'select'), (0, 'column', 1, '', 'd.$', 'table', 'confirmed', 't', '#', 'select'), (0, 'column', 1, '', 'd.$', 'table', 'confirmed', 't', 'a', 'on'), (0, 'column', 1, '', 'd.$', 'table', 'confirmed', 't', 'b', 'where'),
        (1, 'source', 1, '', 'd.#_out', 'table', 'confirmed', NULL, NULL, NULL), (1, 'source', 1, '', 'p.d.$', 'table', 'confirmed', NULL, NULL, NULL), (1, 'column', 1, '', 'd.#_out', 'table', 'possible', NULL, '#', 'select'), (1, 'column', 1, '', 'p.d.$', 'table', 'possible', NULL, '#', 'select'),
        (2, 'cte', 1, '', 'c', 'cte', 'ignored', NULL, NULL, NULL), (2, 'source', 1, '/cte:c', 'd.$', 'table', 'confirmed', NULL, NULL, NULL), (2, 'column', 1, '/cte:c', 'd.$', 'table', 'confirmed', NULL, 'z', 'select'), (2, 'source', 1, '', 'c', 'cte', 'ignored', NULL, NULL, NULL),
        (2, 'routine', 1, '', 'd.#', 'function', 'confirmed', NULL, NULL, 'select'), (2, 'mutation', 2, '', 'd.#', 'drop_table', 'confirmed', NULL, NULL, NULL))
      SELECT path, record, st AS statement, 'statement:' || st || tail AS scope, replace(replace(replace(name, '@', path), '$', source), '#', w) AS name, kind, confidence, alias, replace(col, '#', w) AS "column", clause FROM t JOIN r USING (k)""",
    "ref_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, length(props) > 7 AS long_props FROM events",
}


def oracle_sql() -> dict[str, str]:
    from quarry.plans import review_sql

    return ORACLE | review_sql.oracle_sql() | relational.oracle_sql()
