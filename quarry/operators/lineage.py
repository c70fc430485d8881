"""SQL lineage: definitions, sources, columns, wildcards and routines of SQL text, each with its scope and a confidence.

The text is cut into tokens by one pattern. A scope is a query: a statement, the body of a common table expression, or a
parenthesis that begins with SELECT or WITH. A scope's own tokens are walked once; queries inside become scopes of their
own, which see the sources around them, except in bodies of common table expressions. Files are analysed in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.operators.packing import spread

TOKEN = re.compile(
    r"(?P<skip>\s+|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>[rRbB]{0,2}(?:'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'(?:[^'\\]|\\.|'')*'?|\"(?:[^\"\\]|\\.|\"\")*\"?))"
    r"|(?P<quoted>`[^`]*`)|(?P<param>@{1,2}\w+)|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*)|(?P<symbol>.)",
    re.S,
)
#: Words that are no alias, no column and no function; words of types; functions that Spark names otherwise.
RESERVED = frozenset(
    """ALL AND ANY ARRAY AS ASC ASSERT_ROWS_MODIFIED AT BETWEEN BY CASE CAST CLUSTER COLLATE CONTAINS CREATE CROSS CUBE CURRENT DEFAULT DEFINE DELETE DESC DISTINCT ELSE END
    ENUM ESCAPE EXCEPT EXCLUDE EXISTS EXTRACT FALSE FETCH FOLLOWING FOR FROM FULL GROUP GROUPING GROUPS HASH HAVING IF IGNORE IN INNER INSERT INTERSECT INTERVAL INTO IS
    JOIN LATERAL LEFT LIKE LIMIT LOOKUP MERGE NATURAL NEW NO NOT NULL NULLS OF OFFSET ON OR ORDER OUTER OVER PARTITION PRECEDING PROTO QUALIFY RANGE RECURSIVE REPLACE
    RESPECT RIGHT ROLLUP ROWS SELECT SET SOME STRUCT TABLESAMPLE THEN TO TREAT TRUE UNBOUNDED UNION UNNEST UPDATE USING VALUES WHEN WHERE WINDOW WITH WITHIN""".split()
)
TYPES = frozenset("ARRAY BIGNUMERIC BOOL BYTES DATE DATETIME FLOAT64 GEOGRAPHY INT64 INTERVAL JSON NUMERIC RANGE STRING STRUCT TIME TIMESTAMP".split())
#: The function of Spark for each; empty where there is none.
COUNTERPARTS = {
    "APPROX_QUANTILES": "approx_percentile", "APPROX_TOP_COUNT": "approx_top_k", "APPROX_TOP_SUM": "", "COUNTIF": "count_if", "LOGICAL_AND": "bool_and", "LOGICAL_OR": "bool_or",
    "ARRAY_CONCAT": "concat", "ARRAY_LENGTH": "size", "ARRAY_REVERSE": "reverse", "ARRAY_TO_STRING": "array_join", "GENERATE_ARRAY": "sequence", "GENERATE_DATE_ARRAY": "sequence",
    "GENERATE_TIMESTAMP_ARRAY": "sequence", "UNNEST": "explode", "BYTE_LENGTH": "octet_length", "UNICODE": "ascii", "TO_CODE_POINTS": "", "CODE_POINTS_TO_STRING": "",
    "CODE_POINTS_TO_BYTES": "", "CONTAINS_SUBSTR": "contains", "STRPOS": "locate", "STARTS_WITH": "startswith", "ENDS_WITH": "endswith", "NORMALIZE": "", "NORMALIZE_AND_CASEFOLD": "",
    "REGEXP_CONTAINS": "regexp", "FORMAT": "format_string", "FORMAT_DATE": "date_format", "FORMAT_DATETIME": "date_format", "FORMAT_TIMESTAMP": "date_format", "FORMAT_TIME": "",
    "PARSE_DATE": "to_date", "PARSE_DATETIME": "to_timestamp_ntz", "PARSE_TIMESTAMP": "to_timestamp", "PARSE_NUMERIC": "to_number", "PARSE_TIME": "", "TIME_ADD": "", "TIME_SUB": "",
    "CURRENT_DATETIME": "localtimestamp", "DATETIME": "to_timestamp_ntz", "DATETIME_ADD": "timestampadd", "DATETIME_SUB": "timestampadd", "DATETIME_DIFF": "timestampdiff",
    "DATETIME_TRUNC": "date_trunc", "TIMESTAMP_ADD": "timestampadd", "TIMESTAMP_SUB": "timestampadd", "TIMESTAMP_DIFF": "timestampdiff", "TIMESTAMP_TRUNC": "date_trunc", "SAFE_CAST": "try_cast",
    "ERROR": "raise_error", "IEEE_DIVIDE": "", "IS_NAN": "isnan", "IS_INF": "", "SHA256": "sha2", "SHA512": "sha2", "FARM_FINGERPRINT": "", "TO_HEX": "hex", "TO_BASE64": "base64",
    "FROM_BASE64": "unbase64", "TO_BASE32": "", "FROM_BASE32": "", "JSON_VALUE": "get_json_object", "JSON_EXTRACT_SCALAR": "get_json_object", "JSON_EXTRACT": "get_json_object",
    "JSON_QUERY": "get_json_object", "JSON_VALUE_ARRAY": "from_json", "JSON_EXTRACT_ARRAY": "from_json", "JSON_QUERY_ARRAY": "from_json", "TO_JSON_STRING": "to_json", "NET_HOST": "parse_url",
    "NET_IP_FROM_STRING": "", "NET_IP_TO_STRING": "", "NET_PUBLIC_SUFFIX": "", "NET_REG_DOMAIN": "",
}
CLAUSES = {"SELECT", "FROM", "JOIN", "ON", "USING", "WHERE", "GROUP", "HAVING", "QUALIFY", "ORDER", "WINDOW", "LIMIT", "SET", "VALUES"}
CONSTRAINTS = frozenset("CHECK CLUSTER CONSTRAINT FOREIGN OPTIONS PARTITION PRIMARY UNIQUE".split())
FIELDS = ["record", "statement", "scope", "name", "kind", "confidence", "alias", "column", "clause", "line"]
SCHEMA = "path string, record string, statement int, scope string, name string, kind string, confidence string, alias string, `column` string, clause string, line int"


class Tok:
    __slots__ = ("text", "up", "kind", "line", "at")

    def __init__(self, text: str, kind: str, line: int, at: int = 0):
        self.text, self.kind, self.line, self.at = text, kind, line, at
        self.up = text.upper() if kind == "word" else text

    @property
    def name(self) -> bool:
        return self.kind == "quoted" or self.kind == "word" and self.up not in RESERVED


def tokens(sql: str) -> list[Tok]:
    out, line = [], 1
    for m in TOKEN.finditer(sql):
        if m.lastgroup not in ("skip",):
            out.append(Tok(m[0], m.lastgroup, line, m.start()))
        line += m[0].count("\n")
    return out


def statements(toks: list[Tok]) -> Iterator[list[Tok]]:
    depth, now = 0, []
    for t in toks:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == ";" and t.kind == "symbol" and depth <= 0:
            if now:
                yield now
            now, depth = [], 0
        else:
            now.append(t)
    if now:
        yield now


def close(toks: list[Tok], i: int) -> int:
    """The place of the parenthesis that closes the one at i; the end where none does."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j].text == "(") - (toks[j].text == ")")
        if not depth:
            return j
    return len(toks)


def dashed(toks: list[Tok], i: int) -> tuple[list[str], int]:
    """The parts of a name whose project has dashes, and no space, up to the project or all that a number holds, and the
    place after them; none where there is no such project at i."""
    j = i
    while j + 2 < len(toks) and toks[j + 1].text == "-" and toks[j].at + len(toks[j].text) == toks[j + 1].at and toks[j + 2].at == toks[j + 1].at + 1 and toks[j + 2].kind in ("word", "number"):
        j += 2
    text = "".join(t.text for t in toks[i : j + 1])
    if j > i and "." in text:  # a number takes the dots behind it
        return text.split("."), j + 1
    if j > i and j + 1 < len(toks) and toks[j + 1].text == ".":
        return [text], j + 2
    return [], i


def path_at(toks: list[Tok], i: int, table: bool = False) -> tuple[list[str], int]:
    """Parts of a dotted name at i, and the place after it. A table's name may begin with a project that has dashes."""
    parts: list[str] = []
    if table and i < len(toks) and toks[i].kind == "word":
        parts, i = dashed(toks, i)
        if len(parts) > 1:
            return parts, i
    while i < len(toks) and (toks[i].name or parts and toks[i].kind == "word"):
        parts += toks[i].text.strip("`").split(".") if toks[i].kind == "quoted" else [toks[i].text]
        i += 1
        if i + 1 < len(toks) and toks[i].text == "." and (toks[i + 1].kind in ("word", "quoted")):
            i += 1
        else:
            break
    return parts, i


class Analysis:
    def __init__(self, builtins: frozenset[str]):
        self.builtins = builtins if builtins >= TYPES else builtins | TYPES
        self.rows: list[tuple] = []

    def put(self, record: str, n: int, scope: str, name: str | None, kind: str | None, confidence: str | None, line: int, alias=None, column=None, clause=None) -> None:
        self.rows.append((record, n, scope, name, kind, confidence, alias, column, clause, line))

    def statement(self, toks: list[Tok], n: int) -> None:
        scope = f"statement:{n}"
        skip = self.definition(toks, n, scope)
        if skip < len(toks):
            self.scope(toks[skip:], n, scope, {}, {})

    def definition(self, toks: list[Tok], n: int, scope: str) -> int:
        """Rows of CREATE, ALTER and DROP; the place from which the rest is read as a query."""
        up = [t.up for t in toks]
        if not up or up[0] not in ("CREATE", "ALTER", "DROP"):
            return 0
        i = 1
        while i < len(up) and up[i] in ("OR", "REPLACE", "TEMP", "TEMPORARY", "MATERIALIZED", "EXTERNAL"):
            i += 1
        kind = up[i].lower() if i < len(up) else ""
        if up[i : i + 2] == ["TABLE", "FUNCTION"]:
            kind, i = "table_function", i + 1
        if kind not in ("table", "view", "function", "table_function", "procedure", "schema"):
            return len(toks)
        i += 1
        while i < len(up) and up[i] in ("IF", "NOT", "EXISTS"):
            i += 1
        parts, j = path_at(toks, i, table=True)
        if not parts:
            self.put("error", n, scope, None, kind, None, toks[0].line)
            return len(toks)
        name = ".".join(parts)
        self.put({"CREATE": "definition"}.get(up[0], "mutation"), n, scope, name, kind if up[0] == "CREATE" else f"{up[0].lower()}_{kind}", "confirmed", toks[0].line)
        if up[0] == "CREATE" and j < len(toks) and toks[j].text == "(":
            end = close(toks, j)
            k = j + 1
            while k < end:
                if (toks[k].kind in ("word", "quoted")) and toks[k].up not in CONSTRAINTS:
                    self.put("definition_column" if kind in ("table", "view") else "parameter", n, scope, name, kind, "confirmed", toks[k].line, column=toks[k].text.strip("`"))
                depth = 0
                while k < end and (depth or toks[k].text != ","):
                    depth += (toks[k].text in "(<") - (toks[k].text in ")>")
                    k += 1
                k += 1
            j = end + 1
        if up[0] == "ALTER":
            while j < len(up):
                if up[j] in ("ADD", "DROP", "RENAME") and "COLUMN" in up[j : j + 2]:
                    k = j + 2
                    while k < len(up) and up[k] in ("IF", "NOT", "EXISTS"):
                        k += 1
                    if k < len(toks):
                        to = toks[k + 2].text.strip("`") if up[j] == "RENAME" and k + 2 < len(toks) and up[k + 1] == "TO" else None
                        self.put("column_mutation", n, scope, name, up[j].lower(), "confirmed", toks[k].line, alias=to, column=toks[k].text.strip("`"))
                j += 1
            return len(toks)
        if up[0] == "DROP":
            return len(toks)
        while j < len(up) and up[j] not in ("AS", "BEGIN"):
            j += 1
        return j + 1

    def scope(self, toks: list[Tok], n: int, scope: str, ctes: dict[str, str], outer: dict[str, tuple]) -> None:
        ctes, i = dict(ctes), 0
        if toks and toks[0].up == "WITH":
            i = 1 + (len(toks) > 1 and toks[1].up == "RECURSIVE")
            again = i == 2
            while i < len(toks) and toks[i].name:
                name, i = toks[i].text.strip("`"), i + 1
                if i < len(toks) and toks[i].text == "(":
                    i = close(toks, i) + 1
                i += i < len(toks) and toks[i].up == "AS"
                if i >= len(toks) or toks[i].text != "(":
                    break
                end = close(toks, i)
                self.put("cte", n, scope, name, "cte", "ignored", toks[i].line)
                self.scope(toks[i + 1 : end], n, f"{scope}/cte:{name}", ctes | ({name.lower(): name} if again else {}), {})
                ctes[name.lower()] = name
                i = end + 1
                if i < len(toks) and toks[i].text == ",":
                    i += 1
                else:
                    break
        self.query(toks[i:], n, scope, ctes, outer)

    def query(self, toks: list[Tok], n: int, scope: str, ctes: dict[str, str], outer: dict[str, tuple]) -> None:
        sources: dict[str, tuple] = {}  # by alias: (name, kind, confidence)
        inner: list[tuple[str, list[Tok]]] = []
        taken: set[int] = set()
        clause_at, clause, depth, waits = [], "", 0, []
        i = 0
        while i < len(toks):  # sources, clauses and inner queries
            t = toks[i]
            if t.text == "(":
                waits.append(clause)
            elif t.text == ")" and waits:
                clause = waits.pop()
            if t.text == "(" and i + 1 < len(toks) and toks[i + 1].up in ("SELECT", "WITH"):
                end = close(toks, i)
                inner.append((f"subquery:{len(inner)}", toks[i + 1 : end]))
                taken |= set(range(i, end + 1))
                clause_at += [clause] * (min(end + 1, len(toks)) - i)
                clause = waits.pop()
                i = end + 1
                if i < len(toks):
                    alias, j = self.alias(toks, i)
                    if alias and clause in ("FROM", "JOIN", "USING"):
                        sources[alias.lower()] = (alias, "subquery", "ignored")
                        taken |= set(range(i, j))
                        clause_at += [clause] * (j - i)
                        i = j
                continue
            odd = t.up == "FROM" and (self.inside(toks, i, ("EXTRACT", "TRIM", "SUBSTRING")) or i and toks[i - 1].up == "DISTINCT" and i > 1 and toks[i - 2].up in ("IS", "NOT"))
            if t.kind == "word" and t.up in CLAUSES and not odd:
                clause = t.up
            clause_at.append(clause)
            begins = not odd and (t.up in ("FROM", "JOIN", "UPDATE", "INTO") or t.up == "USING" and i + 1 < len(toks) and toks[i + 1].text != "(" or t.up in ("INSERT", "MERGE") and i + 1 < len(toks) and toks[i + 1].name)
            begins = begins or t.up == "TABLE" and i > 0 and toks[i - 1].up == "TRUNCATE"
            begins = begins or t.text == "," and clause in ("FROM", "JOIN", "ON", "USING") and not waits
            i += 1
            if begins:
                j = self.source(toks, i, n, scope, ctes, sources)
                taken |= set(range(i, j))
                clause_at += [clause] * (j - i)
                i = j
        for at, body in inner:
            self.scope(body, n, f"{scope}/{at}", ctes, outer | sources)
        self.uses(toks, taken, clause_at, n, scope, sources, outer)

    @staticmethod
    def inside(toks: list[Tok], i: int, names: Iterable[str]) -> bool:
        depth = 0
        for j in range(i - 1, -1, -1):
            depth += (toks[j].text == ")") - (toks[j].text == "(")
            if depth < 0:
                return j > 0 and toks[j - 1].up in names
        return False

    @staticmethod
    def alias(toks: list[Tok], i: int) -> tuple[str | None, int]:
        if i < len(toks) and toks[i].up == "AS" and i + 1 < len(toks) and toks[i + 1].kind in ("word", "quoted"):
            return toks[i + 1].text.strip("`"), i + 2
        if i < len(toks) and toks[i].name and toks[i].up not in CLAUSES:
            return toks[i].text.strip("`"), i + 1
        return None, i

    def source(self, toks: list[Tok], i: int, n: int, scope: str, ctes: dict[str, str], sources: dict[str, tuple]) -> int:
        if i >= len(toks) or toks[i].text == "(":
            return i
        line = toks[i].line
        if toks[i].up == "UNNEST":
            end = close(toks, i + 1)
            alias, j = self.alias(toks, end + 1)
            if alias:
                sources[alias.lower()] = (alias, "unnest", "possible")
            self.put("source", n, scope, alias, "unnest", "ignored", line, alias=alias)
            return min(max(j, end + 1), len(toks))
        parts, j = path_at(toks, i, table=True)
        if not parts:
            return i
        name, kind = ".".join(parts[-3:]), "table"
        confidence = "confirmed" if len(parts) > 1 else "possible"
        if j < len(toks) and toks[j].text == "(" and toks[i - 1].up not in ("INTO", "INSERT"):
            kind = "table_function"
            self.put("routine", n, scope, name, kind, confidence, line, clause="FROM")
            j = min(close(toks, j) + 1, len(toks))
        elif len(parts) == 1 and parts[0].lower() in ctes:
            kind, confidence = "cte", "ignored"
        alias, j = self.alias(toks, j)
        self.put("source", n, scope, name, kind, confidence, line, alias=alias)
        sources[(alias or parts[-1]).lower()] = (name, kind, confidence)
        return j

    def uses(self, toks: list[Tok], taken: set[int], clause_at: list[str], n: int, scope: str, sources: dict[str, tuple], outer: dict[str, tuple]) -> None:
        real = [s for s in sources.values() if s[1] == "table"]
        made = {toks[k + 1].text.strip("`").lower() for k in range(len(toks) - 1) if toks[k].up == "AS" and toks[k + 1].kind in ("word", "quoted")}
        i = 0
        while i < len(toks):
            t, clause = toks[i], clause_at[i].lower() if i < len(clause_at) else ""
            if i in taken:
                i += 1
                continue
            before = toks[i - 1] if i else None
            if t.text == "*" and clause == "select" and before is not None and (before.up in ("SELECT", ",", "ALL", "DISTINCT") or before.text == "."):
                owner = sources.get(toks[i - 2].text.strip("`").lower()) if before.text == "." and i > 1 else None
                changed: dict[str, list[str]] = {"EXCEPT": [], "REPLACE": []}
                j = i + 1
                while j + 1 < len(toks) and toks[j].up in changed and toks[j + 1].text == "(":
                    end = close(toks, j + 1)
                    what = toks[j].up
                    changed[what] += [toks[k].text.strip("`") for k in range(j + 2, end) if toks[k].kind in ("word", "quoted") and (what == "EXCEPT" or toks[k - 1].up == "AS")]
                    j = end + 1
                for s in [owner] if owner else real if before.text != "." else []:
                    if s[1] == "table":
                        self.put("wildcard", n, scope, s[0], "table", s[2], t.line, alias=",".join(sorted(changed["REPLACE"])), column=",".join(sorted(changed["EXCEPT"])), clause=clause)
                i = j
                continue
            if t.up == "USING" and i + 1 < len(toks) and toks[i + 1].text == "(":
                end = close(toks, i + 1)
                for k in range(i + 2, end):
                    if toks[k].name:
                        for s in real:
                            self.put("column", n, scope, s[0], "table", s[2], toks[k].line, column=toks[k].text.strip("`"), clause="using")
                i = end + 1
                continue
            if not t.name or before is not None and (before.up == "AS" or before.text == "."):
                i += 1
                continue
            parts, j = path_at(toks, i)
            if j + 0 < len(toks) and toks[j].text == "." and j + 1 < len(toks) and toks[j + 1].text == "*":
                i = j + 1
                continue
            if j < len(toks) and toks[j].text == "(":
                called = before is not None and before.up == "CALL"
                if called or len(parts) > 1 or parts[0].upper() not in self.builtins:
                    self.put("routine", n, scope, ".".join(parts[-3:]), "procedure" if called else "function", "confirmed" if len(parts) > 1 else "possible", t.line, clause=clause)
                i = j
                continue
            if j < len(toks) and toks[j].up == "FROM" and self.inside(toks, j, ("EXTRACT",)):
                i = j
                continue
            if t.up in TYPES or t.up in ("CALL", "BEGIN", "VIEW", "TABLE") or clause == "":
                i = j
                continue
            head = parts[0].lower()
            owner = sources.get(head) or outer.get(head)
            if len(parts) > 1 and owner:
                if owner[1] in ("table", "unnest"):
                    self.put("column", n, scope, owner[0], owner[1], owner[2], t.line, alias=parts[0], column=".".join(parts[1:]), clause=clause)
            elif len(parts) == 1 and head in made and clause in ("group", "order", "having", "qualify"):
                pass
            elif len(parts) == 1 and owner:
                pass
            else:
                for s in real:
                    tail = s[0].lower().split(".")
                    low = [p.lower() for p in parts]
                    k = next((k for k in range(len(tail), 0, -1) if len(low) > k and low[:k] == tail[-k:]), 0)
                    if k:
                        self.put("column", n, scope, s[0], "table", s[2], t.line, column=".".join(parts[k:]), clause=clause)
                        break
                else:
                    for s in real:
                        self.put("column", n, scope, s[0], "table", s[2] if len(real) == 1 and len(sources) == 1 else "possible", t.line, column=".".join(parts), clause=clause)
            i = j


def analyze(sql: str | None, builtins: frozenset[str] = frozenset()) -> list[tuple]:
    """Rows of FIELDS. A statement that cannot be read gives an error row; the others go on."""
    out: list[tuple] = []
    for n, toks in enumerate(statements(tokens(sql or "")), 1):
        a = Analysis(builtins)
        try:
            a.statement(toks, n)
        except (IndexError, RecursionError) as e:
            a.rows = [("error", n, f"statement:{n}", type(e).__name__, None, None, None, None, None, toks[0].line)]
        out += a.rows
    return out


def analysed(batches: Iterator[pa.RecordBatch], builtins: frozenset[str], held: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of SCHEMA for batches of (path, content): a batch ends with the file that brings it to ``held`` rows."""
    kinds = [pa.int32() if f in ("statement", "line") else pa.string() for f in ["path", *FIELDS]]
    rows: list[tuple] = []

    def full() -> pa.RecordBatch:
        nonlocal rows
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", *FIELDS])

    for b in batches:
        for p, c in zip(b.column(0), b.column(1), strict=True):
            path = p.as_py()
            rows += [(path, *r) for r in analyze(c.as_py(), builtins)]
            if len(rows) >= held:
                yield full()
    if rows:
        yield full()


def lineage(files: DataFrame) -> DataFrame:
    """The rows of all files (path, content), by statement. Spark's own function names count as built in.

    The texts are small and their analysis is not, so that the files are dealt to all tasks first.
    """
    spark = files.sparkSession
    names = frozenset(r[0].upper() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()) | frozenset(COUNTERPARTS) | TYPES
    return spread(files.select("path", "content"), "path").mapInArrow(lambda batches: analysed(batches, names), SCHEMA)
