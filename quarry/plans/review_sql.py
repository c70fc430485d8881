"""SQL of the queries in ``quarry.plans.review``."""

from __future__ import annotations

from quarry.operators import lineage as L
from quarry.plans import review as Q


def _corpus(index: bool = False) -> str:
    from quarry.plans.registry import CORPUS, INDEX

    return CORPUS + (INDEX if index else "")


def _with(text: str, name: str) -> str:
    return f"{name} AS ({Q.check(text)})"


TRANSITIONS = """t(b, h, c) AS (VALUES ('none','present','added'),('none','absent','deleted'),('none','modified','modified'),('present','none','deleted'),('present','present','modified'),('present','absent','deleted'),('present','modified','modified'),
  ('absent','none','added'),('absent','present','added'),('absent','modified','modified'),('modified','none','modified'),('modified','present','modified'),('modified','absent','modified'),('modified','modified','modified'))"""
NUMBERS = lambda c, when: f"coalesce(string_agg(DISTINCT CASE WHEN {when} THEN {c} END, ',' ORDER BY CASE WHEN {when} THEN {c} END), '')"


def _code() -> str:
    return _corpus() + f""", worded AS (SELECT l.path, f.doc_id, l.line, l.content, regexp_extract(l.content, '([A-Za-z]+)', 1) AS w, split_part(l.path, '.', -1) AS x FROM lines l JOIN files f ON f.path = l.path),
      code AS (SELECT path, doc_id, line, w, x, coalesce({Q.FORMED}, '> ' || content) AS content, w <> '' AND x <> 'md' AND line % 5 = 4 AS comment,
        CASE WHEN w <> '' AND x <> 'md' AND line % 5 IN (1, 2, 3) THEN CASE WHEN x = 'sql' AND line % 5 = 1 THEN 'a.' ELSE '' END || w END AS name,
        CASE WHEN w <> '' AND x <> 'md' THEN CASE x WHEN 'py' THEN CASE line % 5 WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'variable' END WHEN 'go' THEN CASE line % 5 WHEN 1 THEN 'method' WHEN 2 THEN 'struct' WHEN 3 THEN 'variable' END
          ELSE CASE line % 5 WHEN 1 THEN 'table' WHEN 2 THEN 'table' WHEN 3 THEN 'function' END END END AS kind,
        (line - 1) // 10 AS hunk, CASE line % 4 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'context' END AS side FROM worded)"""


DEFINES = "(x IN ('py', 'go') AND name = {s} OR x = 'sql' AND line % 5 IN (2, 3) AND lower(name) = {s})"


def _odd(value: str) -> str:
    return f"CASE n_chars % 9 {value} END"


def oracle_sql() -> dict[str, str]:
    code, lines = _code(), _corpus()
    effects = " UNION ALL ".join(
        f"SELECT 'q' || doc_id || '.sql' AS path, '{'base' if k == 'removed' else 'head'}' AS side, {n} AS line, {s} AS symbol, '{t}' AS symbol_type, '{e}' AS effect FROM documents"
        for n, k, _, all_effects in Q.DDL for s, t, e in all_effects
    )
    listing = Q.REVISIONS.replace("{documents}", "documents")
    places = """, base AS (SELECT path, doc_id, line, length(lines.content) AS n, (line - 1) // 10 AS h, (line - 1) % 10 AS p, CASE (line - 1) % 10 % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'context' END AS kind FROM lines JOIN files USING (path)),
      hunks AS (SELECT *, count(*) FILTER (WHERE kind <> 'added') OVER w AS sl, count(*) FILTER (WHERE kind <> 'removed') OVER w AS tl,
        count(*) FILTER (WHERE kind <> 'added') OVER (w ORDER BY p) + 10 * h AS s, count(*) FILTER (WHERE kind <> 'removed') OVER (w ORDER BY p) + 10 * h AS t, max(line) OVER (PARTITION BY path) AS last FROM base WHERE doc_id % 7 <> 0 WINDOW w AS (PARTITION BY path, h))"""
    search = """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, length('select a, b.* except (x) from d.r' || n_regionkey || ' as b') AS n FROM nation),
      s AS (SELECT s_suppkey AS k, s_nationkey AS nk, s_suppkey % 3 <> 0 AS sure, CASE WHEN s_suppkey % 3 = 0 THEN 'n' ELSE 'd.n' END || s_nationkey AS name FROM supplier),
      c AS (SELECT c_custkey AS k, c_nationkey AS nk, c_custkey % (SELECT count(*) FROM supplier) + 1 AS sk FROM customer),
      found AS (SELECT 'd.R' || r AS target, 'confirmed' AS confidence, 'direct' AS dependency_kind, 0 AS dependency_depth, 'd.R' || r AS way, NULL AS via, 'n/' || k || '.sql' AS path, 2 AS line, n, 'd.r' || r AS name FROM n
        UNION ALL SELECT 'd.R' || r, CASE WHEN sure THEN 'confirmed' ELSE 'possible' END, 'transitive', 1, 'd.R' || r || '>d.n' || nk || '>d.s' || s.k, 'd.n' || nk, 's/' || s.k || '.sql', 2, length('select t.k from ' || name || ' t'), name FROM s JOIN n ON n.k = nk
        UNION ALL SELECT 'd.R' || r, CASE WHEN sure THEN 'confirmed' ELSE 'possible' END, 'transitive', 2, 'd.R' || r || '>d.n' || s.nk || '>d.s' || s.k || '>c/' || c.k || '.sql', 'd.s' || s.k, 'c/' || c.k || '.sql', 2, length('select q.k, d.f' || c.nk || '(1) from d.s' || s.k || ' as q'), 'd.s' || s.k
          FROM c JOIN s ON s.k = c.sk JOIN n ON n.k = s.nk
        UNION ALL SELECT 'd.f' || nk, 'confirmed', 'direct', 0, 'd.f' || nk, NULL, 'c/' || k || '.sql', 2, length('select q.k, d.f' || nk || '(1) from d.s' || sk || ' as q'), 'd.f' || nk FROM c WHERE nk < 3)"""
    return {
        "ref_listing": f"SELECT path, length(content) AS n FROM ({listing}) WHERE revision = 'head' AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND lang IN ('en', 'de')",
        "ref_changed_paths": f"""WITH r AS ({listing}) SELECT coalesce(h.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
          FROM (SELECT * FROM r WHERE revision = 'head') h FULL JOIN (SELECT * FROM r WHERE revision = 'base') b ON h.path = b.path WHERE h.content IS DISTINCT FROM b.content""",
        "ref_symbols": code + " SELECT path, line, name, kind, comment FROM code",
        "ref_definitions": code + f" SELECT symbol, path, line FROM code JOIN (VALUES ('the'), ('of'), ('die'), ('le')) s(symbol) ON contains(content, symbol) AND {DEFINES.format(s='symbol')}",
        "ref_compare_symbol": code + f""", twin AS (SELECT 'base' AS revision, * FROM code WHERE doc_id % 3 <> 0 UNION ALL SELECT 'head', * FROM code WHERE doc_id % 4 <> 0),
          hits AS (SELECT *, {DEFINES.format(s="'the'")} AS d FROM twin WHERE contains(content, 'the')),
          defs AS (SELECT *, row_number() OVER (PARTITION BY revision ORDER BY path, line) AS n FROM hits WHERE d QUALIFY n <= 10)
          SELECT revision, 'definition' AS kind, path, line FROM defs
          UNION ALL SELECT revision, 'occurrence', path, line FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY revision ORDER BY path, line) <= 50)
          UNION ALL SELECT DISTINCT b.revision, 'section', b.path, b.line FROM twin b JOIN defs d ON d.revision = b.revision AND d.path = b.path AND b.line BETWEEN d.line - 2 AND d.line + 2 WHERE d.n <= 3""",
        "ref_changed_symbols": code + f""", c AS (SELECT * FROM code WHERE x IN ('py', 'go') AND side <> 'context'),
          e AS (SELECT path, name AS symbol, kind AS symbol_type, side, line, 'changed_declaration' AS origin FROM c WHERE name IS NOT NULL
            UNION ALL SELECT path, 's' || hunk % 3, 'function', s, 10 * hunk + 1, 'hunk_header' FROM (SELECT path, hunk FROM c GROUP BY ALL HAVING count(name) = 0 AND bool_or(NOT comment)) h, (VALUES ('added'), ('removed')) v(s))
          SELECT path, symbol, symbol_type, {NUMBERS('line', "side = 'removed'")} AS source_lines, {NUMBERS('line', "side = 'added'")} AS target_lines, string_agg(DISTINCT origin, ',' ORDER BY origin) AS detected_from,
            CASE WHEN bool_and(side = 'added') THEN 'added' WHEN bool_and(side = 'removed') THEN 'deleted' ELSE 'modified' END AS change_type FROM e GROUP BY 1, 2, 3""",
        "ref_fragments": code + """, s AS (SELECT path, hunk, v.s AS side, line, content, side = v.k AS changed FROM code, (VALUES ('base', 'added', 'removed'), ('head', 'removed', 'added')) v(s, away, k) WHERE x = 'sql' AND side <> away
            UNION ALL SELECT DISTINCT path, hunk, v.s, 0, 'create view d.s' || hunk % 3, false FROM code, (VALUES ('base'), ('head')) v(s) WHERE x = 'sql' AND hunk % 2 = 0)
          SELECT path, hunk, side, sha256(string_agg(content, chr(10) ORDER BY line)) AS content, count(*) AS n, count(*) FILTER (WHERE changed) AS n_changed FROM s GROUP BY 1, 2, 3""",
        "ref_side_states": f"""WITH e AS ({effects}), {TRANSITIONS},
          f AS (SELECT path, symbol, symbol_type, side, CASE WHEN count(DISTINCT effect) > 1 THEN 'modified' ELSE min(effect) END AS x, string_agg(DISTINCT line, ',' ORDER BY line) AS ls FROM e GROUP BY 1, 2, 3, 4)
          SELECT path, symbol, symbol_type, coalesce(b.ls, '') AS source_lines, coalesce(h.ls, '') AS target_lines, c AS change_type
          FROM (SELECT * FROM f WHERE side = 'base') b FULL JOIN (SELECT * FROM f WHERE side = 'head') h USING (path, symbol, symbol_type) JOIN t ON t.b = coalesce(b.x, 'none') AND t.h = coalesce(h.x, 'none')""",
        "ref_owner_events": code + f""", c AS (SELECT path, {NUMBERS('line', "side = 'removed'")} AS s, {NUMBERS('line', "side = 'added'")} AS t FROM code WHERE x = 'sql' AND side <> 'context' AND NOT comment GROUP BY path),
          o AS (SELECT path, 'd.o' || n_chars % k AS symbol, k FROM (SELECT f.path, n_chars, k, doc_id FROM documents d JOIN files f USING (doc_id), (VALUES (3), (4)) v(k) WHERE lang = 'de') WHERE doc_id % (k + 3) <> 0 AND n_chars % 5 <> k),
          j AS (SELECT path, symbol, bool_or(k = 3) AS b, bool_or(k = 4) AS h FROM o GROUP BY 1, 2)
          SELECT path, symbol, 'table' AS symbol_type, CASE WHEN b THEN s ELSE '' END AS source_lines, CASE WHEN h THEN t ELSE '' END AS target_lines, CASE WHEN b AND h THEN 'modified' WHEN b THEN 'deleted' ELSE 'added' END AS change_type FROM j JOIN c USING (path)""",
        "ref_meaningful": code + " SELECT DISTINCT path FROM code WHERE x = 'sql' AND doc_id % 3 = 0 AND side <> 'context' AND NOT comment",
        "ref_sql_completion": f"""WITH {_with(Q.SQL_FILES, 'f')}, given AS ({Q.SQL_GIVEN}), symbols AS ({Q.SQL_SYMBOLS}), k AS (SELECT * FROM symbols WHERE ends_with(path, '.sql') AND symbol_type <> 'variable'),
          u AS (SELECT path, symbol, symbol_type, change_type, 0 AS origin FROM given UNION ALL SELECT path, 'entire file', 'file', 'added', 1 FROM f WHERE ends_with(path, '.sql') AND change_type = 'added'
            UNION ALL SELECT path, CAST(doc_id AS VARCHAR), 'query', CASE WHEN change_type = 'renamed' THEN 'modified' ELSE change_type END, 2 FROM f WHERE doc_id % 2 = 0 AND ends_with(path, '.sql') AND path NOT IN (SELECT path FROM k)
            UNION ALL SELECT path, symbol, symbol_type, CASE WHEN change_type = 'renamed' THEN 'modified' ELSE change_type END, 3 FROM k)
          SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY path, symbol, change_type ORDER BY origin, symbol_type) = 1""",
        "ref_reference_search": search + " SELECT * FROM found",
        "ref_reference_counts": search + " SELECT target, count(*) FILTER (WHERE dependency_kind = 'direct') AS direct, count(*) FILTER (WHERE dependency_kind = 'transitive') AS transitive, count(*) FILTER (WHERE confidence = 'confirmed') AS confirmed, count(*) AS n FROM found GROUP BY 1",
        "ref_column_references": """WITH n AS (SELECT 'n/' || n_nationkey || '.sql' AS path, n_regionkey AS r FROM nation), s AS (SELECT 's/' || s_suppkey || '.sql' AS path, s_nationkey AS nk, s_suppkey % 3 <> 0 AS sure FROM supplier), c AS (SELECT 'c/' || c_custkey || '.sql' AS path FROM customer)
          SELECT target, path, 2 AS line, what, confidence FROM (
            SELECT 'd.r1.a' AS target, path, unnest(['column', 'wildcard']) AS what, 'confirmed' AS confidence FROM n WHERE r = 1 UNION ALL SELECT 'r2.a', path, unnest(['column', 'wildcard']), 'possible' FROM n WHERE r = 2
            UNION ALL SELECT 'd.r3.y', path, 'wildcard', 'confirmed' FROM n WHERE r = 3 UNION ALL SELECT t, path, 'wildcard', 'possible' FROM n, (VALUES ('k'), ('z')) v(t)
            UNION ALL SELECT 'k', path, 'column', 'possible' FROM (SELECT path FROM s UNION ALL SELECT path FROM c) UNION ALL SELECT 'd.n4.k', path, 'column', CASE WHEN sure THEN 'confirmed' ELSE 'possible' END FROM s WHERE nk = 4)""",
        "ref_merge_documents": f"""WITH {_with(Q.PIECES, 'p')}, texts AS (SELECT path, 'p' AS which, purpose AS v, min(ord) AS o FROM p WHERE purpose <> '' GROUP BY 1, 3 UNION ALL SELECT path, 'd', data_flow, min(ord) FROM p GROUP BY 1, 3),
          folded AS (SELECT path, which, list_reduce(list(v ORDER BY o, v), lambda x, y: CASE WHEN contains(x, y) THEN x ELSE x || chr(10) || y END) AS v FROM texts GROUP BY 1, 2),
          items AS (SELECT path, v, min([ord, k]) AS o FROM (SELECT path, ord, 0 AS k, a AS v FROM p UNION ALL SELECT path, ord, 1, b FROM p) GROUP BY 1, 2)
          SELECT path, coalesce(a.v, '') AS purpose, coalesce(b.v, '') AS data_flow, l.v AS main_components FROM (SELECT path, string_agg(v, ',' ORDER BY o, v) AS v FROM items GROUP BY 1) l
            LEFT JOIN (SELECT * FROM folded WHERE which = 'p') a USING (path) LEFT JOIN (SELECT * FROM folded WHERE which = 'd') b USING (path)""",
        "ref_failures": f"SELECT * FROM ({Q.check(Q.RESULTS)}) WHERE reason = 'F'",
        "ref_shard_problems": """WITH e AS (SELECT DISTINCT 'docs-shard-' || n_nationkey * 2 AS shard_id FROM nation), r AS (SELECT shard_id, count(*) AS n FROM (SELECT DISTINCT 'docs-shard-' || o_custkey % 40 AS shard_id, o_orderstatus FROM orders WHERE o_custkey % 40 > 5 AND (o_custkey % 2 = 0 OR o_orderstatus = 'O')) GROUP BY 1)
          SELECT coalesce(e.shard_id, r.shard_id) AS shard_id, CASE WHEN e.shard_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM e FULL JOIN r ON e.shard_id = r.shard_id WHERE e.shard_id IS NULL OR n IS NULL OR n > 1""",
        "ref_run_statistics": _corpus(True) + """ SELECT count(f.path) AS repository_files, due AS detected_changed_or_new_files, least(due, 300) AS changed_or_new_files, due - least(due, 300) AS skipped_by_limit, count(f.path) - due AS unchanged_files, count(*) - count(f.path) AS deleted_files
          FROM files f FULL JOIN idx ON f.path = idx.path, (SELECT count(*) AS due FROM files f LEFT JOIN idx ON f.path = idx.path WHERE sha256(content) IS DISTINCT FROM idx.sha256) GROUP BY due""",
        "ref_selected_files": _corpus(True) + " SELECT f.path FROM files f LEFT JOIN idx ON f.path = idx.path WHERE sha256(content) IS DISTINCT FROM idx.sha256 ORDER BY 1 LIMIT 300",
        "ref_manifest": """SELECT 'docs-shard-' || o_custkey % 20 AS shard_id, sha256(string_agg('u' || o_orderkey, ',' ORDER BY 'u' || o_orderkey)) AS unit_ids, count(*) AS unit_count, sum(o_custkey % 90) AS total_lines, sum(o_orderkey % 900) AS total_chars, sum(o_custkey % 9) AS total_risk_score,
          'shards/docs-shard-' || o_custkey % 20 || '.json' AS payload_file FROM orders GROUP BY o_custkey % 20""",
        "ref_stale_plan": """WITH p AS (SELECT DISTINCT 'u' || o_orderkey % 5000 AS u FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT DISTINCT 'u' || l_orderkey % 5001 AS u FROM lineitem WHERE l_linenumber > 5)
          SELECT coalesce(p.u, c.u) AS unit_id, CASE WHEN c.u IS NULL THEN 'gone' ELSE 'new' END AS problem FROM p FULL JOIN c ON p.u = c.u WHERE p.u IS NULL OR c.u IS NULL""",
        "ref_batch_impacts": f"WITH {_with(Q.BATCH_FILES, 'f')}, {_with(Q.BATCH_SYMBOLS, 's')}, {_with(Q.IMPACTS, 'i')} SELECT batch, impact FROM f JOIN i ON changed_file = path UNION SELECT batch, impact FROM s JOIN i USING (symbol)",
        "ref_batch_context": f"SELECT DISTINCT path, s_name AS summary, batch FROM ({Q.check(Q.BATCH_FILES)}) JOIN supplier ON path = 'f' || s_suppkey",
        "ref_usage_files": f"SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN used NOT IN ('', own) THEN used END, ',' ORDER BY CASE WHEN used NOT IN ('', own) THEN used END), '') AS files FROM ({Q.check(Q.USAGE)}) GROUP BY 1, own",
        "ref_file_count": f"SELECT count(*) AS n FROM (SELECT path FROM ({Q.check(Q.BATCH_FILES)}) UNION SELECT changed_file FROM ({Q.check(Q.IMPACTS)}) UNION SELECT used FROM ({Q.check(Q.USAGE)}) UNION SELECT own FROM ({Q.check(Q.USAGE)})) WHERE path <> ''",
        "ref_relevance_policy": f"""WITH {_with(Q.CHANGES, 'c')}, {_with(Q.USES, 'u')}, added AS (SELECT DISTINCT file FROM c WHERE change_type = 'added' AND symbol_type = 'file'),
          a AS (SELECT DISTINCT file, symbol, symbol_type FROM c WHERE change_type = 'added' AND symbol_type <> 'variable'),
          m AS (SELECT a.file, a.symbol, a.symbol_type, string_agg(DISTINCT CASE WHEN d.file IS NULL THEN used END, ', ' ORDER BY CASE WHEN d.file IS NULL THEN used END) AS old, string_agg(DISTINCT CASE WHEN d.file IS NOT NULL THEN used END, ', ' ORDER BY CASE WHEN d.file IS NOT NULL THEN used END) AS new
            FROM a JOIN u ON u.changed_file = a.file AND (a.symbol_type = 'file' OR u.symbol = a.symbol) LEFT JOIN added d ON d.file = used WHERE used NOT IN ('', a.file) GROUP BY 1, 2, 3)
          SELECT c.*, CASE WHEN change_type = 'added' AND c.symbol_type <> 'variable' THEN CASE WHEN old IS NOT NULL THEN 'related' ELSE 'unclear' END END AS repository_relevance,
            CASE WHEN change_type = 'added' AND c.symbol_type <> 'variable' THEN CASE WHEN old IS NOT NULL THEN 'used in: ' || old WHEN new IS NOT NULL THEN 'used only in added files: ' || new ELSE 'no use found' END END AS relevance_reason
          FROM c LEFT JOIN m ON m.file = c.file AND m.symbol IS NOT DISTINCT FROM c.symbol AND m.symbol_type = c.symbol_type""",
        "ref_evidence_lines": f"SELECT symbol, changed_file, string_agg(DISTINCT path, ',' ORDER BY path) AS files, coalesce(string_agg(DISTINCT path || ':' || line, ',' ORDER BY path || ':' || line), '') AS lines FROM ({Q.check(Q.REFERENCES)}) GROUP BY 1, 2",
        "ref_evidence_upsert": f"""WITH {_with(Q.REFERENCES, 'r')}, {_with(Q.OLD_IMPACTS, 'i')}, e AS (SELECT symbol, changed_file, min(symbol_type) AS symbol_type, list_distinct(list(path)) AS files, list_distinct(list(path || ':' || line) FILTER (WHERE line IS NOT NULL)) AS ls FROM r GROUP BY 1, 2),
          x AS (SELECT *, list_filter(files, lambda f: f <> changed_file) AS ext, (SELECT min(ord) FROM i WHERE i.symbol = e.symbol AND (i.changed_file = e.changed_file OR i.changed_file = '' OR e.changed_file = '')) AS ord FROM e),
          g AS (SELECT ord, flatten(list(files)) AS files, flatten(list(ls)) AS ls, list_distinct(flatten(list(ext))) AS ext, bool_or(symbol_type = 'function') AS r FROM x WHERE ord IS NOT NULL GROUP BY 1),
          o AS (SELECT i.symbol, i.symbol_type, i.changed_file, list_append(coalesce(g.files, []), i.file) AS files, list_append(coalesce(g.ls, []), i.evidence) AS ls, coalesce(ext, []) AS ext, r, false AS made FROM i LEFT JOIN g USING (ord)
            UNION ALL SELECT symbol, symbol_type, changed_file, files, ls, ext, symbol_type = 'function', true FROM x WHERE ord IS NULL AND (len(ext) > 0 OR symbol_type = 'function'))
          SELECT symbol, symbol_type, changed_file, array_to_string(list_sort(list_distinct(files)), ',') AS files, array_to_string(list_sort(list_distinct(ls)), ',') AS evidence, array_to_string(list_sort(ext), ',') AS external, CASE WHEN r THEN CASE WHEN len(ext) > 0 THEN 'critical' ELSE 'high' END END AS severity_hint, made FROM o""",
        "ref_report_lookup": f"""WITH {_with(Q.FINDINGS, 'f')}, {_with(Q.SHOWN_IMPACTS, 'i')}, {_with(Q.SHOWN_CHANGES, 'c')},
          m AS (SELECT finding, i.ord, i.symbol, i.symbol IS NOT DISTINCT FROM f.symbol OR contains(message, i.symbol) AS fits FROM f JOIN i ON changed_file = file),
          b AS (SELECT finding, coalesce(min(ord) FILTER (WHERE fits), CASE WHEN count(*) = 1 THEN min(ord) END) AS impact FROM m GROUP BY 1)
          SELECT finding, impact, (SELECT min(c.ord) FROM c WHERE c.file = f.file AND c.symbol = CASE WHEN impact IS NULL THEN f.symbol ELSE i.symbol END) AS change FROM f LEFT JOIN b USING (finding) LEFT JOIN i ON i.ord = impact""",
        "ref_prefetch": "SELECT user_id, event_id AS ord FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) QUALIFY row_number() OVER w <= 40 AND sum(length(event_type || props)) OVER w <= 300",
        "ref_model_errors": rf"""WITH {_with(Q.MESSAGES, 'm')}, s AS (SELECT *, trim(regexp_replace(message, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS c, CASE k WHEN 0 THEN 2.5 WHEN 1 THEN CAST(turn AS DOUBLE) END AS delay FROM m WHERE k < 3)
          SELECT conv_id, turn, delay, CASE k WHEN 0 THEN '5' WHEN 1 THEN '4' ELSE 'unknown' END AS status, sha256(CASE WHEN length(c) > 100 THEN substr(c, 1, 100) || '...' ELSE c END) AS compact, coalesce(delay, 2.0 * pow(2, k)) AS wait FROM s""",
        "ref_bounded": "SELECT conv_id, turn, length(t) > 200 AS truncated, least(length(t), 200) AS n FROM (SELECT conv_id, turn, concat_ws(':', role, text) AS t FROM conversations)",
        "ref_json_objects": f"SELECT event_id, CASE WHEN k NOT IN (3, 4) THEN o END AS object, CASE WHEN k IN (3, 4) THEN '' ELSE array_to_string(list_sort(string_split(p, ',')), ',') END AS paths FROM (SELECT *, '{{\"b\": [{{\"path\": \"' || split_part(p, ',', 1) || '\"}}], \"path\": \"' || split_part(p, ',', 2) || '\"}}' AS o FROM ({Q.JSON_TEXTS.replace('events_', 'events')}))",
        "ref_python_findings": f"SELECT path, k // 2 + 2 AS line, 'critical' AS severity, 'syntax_error' AS category, 'python_syntax' AS rule FROM ({Q.check(Q.PYTHON_FILES)}) WHERE k IN (1, 3) AND g <> 0",
        "ref_review_filter": f"SELECT doc_id, odd FROM ({Q.check(Q.PAYLOADS)}) WHERE NOT is_binary AND regexp_matches(lower(odd), '\\.(py|sql|go)$') AND odd NOT LIKE 'vendor/%'",
        "ref_paths": f"""SELECT doc_id, CASE lower(split_part(odd, '.', -1)) WHEN 'py' THEN 'python' WHEN 'sql' THEN 'sql' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'h' THEN 'c/c++' WHEN 'swift' THEN 'swift' ELSE 'unknown' END AS language, regexp_matches(odd, '\\.(md|markdown)$') AS markdown, kind AS change_type, CASE WHEN kind IN ('added', 'deleted') THEN kind ELSE 'modified' END AS plain
          FROM (SELECT *, CASE WHEN is_binary THEN 'binary' WHEN removed THEN 'deleted' WHEN added THEN 'added' WHEN renamed THEN 'renamed' ELSE 'modified' END AS kind FROM ({Q.check(Q.PAYLOADS)}))""",
        "ref_unit_ids": lines + _facts() + " SELECT path, risk, 'full-scan-unit-' || row_number() OVER (ORDER BY risk DESC, path) AS unit_id FROM facts",
        "ref_counterparts": "SELECT name, spark, true AS found FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.COUNTERPARTS.items() if v) + ") v(name, spark)",
        "ref_diff_lines": lines + places + """ SELECT path AS diff_id, path, CASE WHEN doc_id % 5 = 0 THEN '/dev/null' ELSE 'a/' || path END AS source_file, CASE WHEN doc_id % 5 = 0 THEN 'added' ELSE 'modified' END AS change_type, h + 1 AS hunk, 'h' || (h + 1) AS section, sl AS source_length, tl AS target_length,
            p + 1 AS line, kind, CASE WHEN kind <> 'added' THEN s END AS source_line, CASE WHEN kind <> 'removed' THEN t END AS target_line, n FROM hunks
          UNION ALL SELECT path, path, CASE WHEN doc_id % 5 = 0 THEN '/dev/null' ELSE 'a/' || path END, CASE WHEN doc_id % 5 = 0 THEN 'added' ELSE 'modified' END, h + 1, 'h' || (h + 1), sl, tl, p + 2, 'metadata', NULL, NULL, length(' No newline at end of file') FROM hunks WHERE line = last
          UNION ALL SELECT path, path, 'a/old/' || path, 'renamed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cut WHERE doc_id % 7 = 0 OR len(ls) = 0""",
        "ref_diff_files": lines + places + """ SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'added' ELSE 'modified' END AS change_type, count(*) FILTER (WHERE line <= 50 AND kind = 'added') AS added_lines, count(*) FILTER (WHERE line <= 50 AND kind = 'removed') AS deleted_lines, count(*) FILTER (WHERE line <= 50) AS review_lines,
            count(DISTINCT h) AS n_hunks, max(line) + 1 > 50 AS truncated FROM hunks GROUP BY path, doc_id
          UNION ALL SELECT path, 'renamed', 0, 0, 0, 0, false FROM cut WHERE doc_id % 7 = 0 OR len(ls) = 0""",
    }


def _facts() -> str:
    from quarry.plans.registry import FACTS

    return FACTS


