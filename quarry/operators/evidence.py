"""Joins of findings, changes, impacts and evidence, and what reports make of them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarry.functions import text as T

#: Kinds of symbols whose relevance is asked for.
RELEVANT = ("file", "function", "method", "class", "struct", "table", "query", "column")
ROUTINE = ("function", "method")


def batch_impacts(files: DataFrame, symbols: DataFrame, impacts: DataFrame) -> DataFrame:
    """(batch, impact): impacts whose file is among a batch's files (batch, path), or whose symbol among its symbols (batch, symbol).

    A file's and a symbol's batches are gathered once each, so that an impact meets two rows and not one for each time that
    its file or symbol is named. Only what an impact of several files or symbols gives has to be made distinct.
    """
    kind = files.select("batch").union(symbols.select("batch")).schema["batch"].dataType
    none = F.array().cast(ArrayType(kind))

    def gathered(rows: DataFrame, by: str, to: str, name: str) -> DataFrame:
        batch = F.col("batch").cast(kind)
        null = F.when(F.bool_or(batch.isNull()), F.array(F.lit(None).cast(kind))).otherwise(none)
        return rows.groupBy(F.col(by).alias(to)).agg(F.concat(F.collect_set(batch), null).alias(name))

    one = impacts.select("impact", "changed_file", "symbol").distinct().withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("impact")))
    met = one.join(gathered(files, "path", "changed_file", "_f"), "changed_file", "left").join(gathered(symbols, "symbol", "symbol", "_s"), "symbol", "left")
    of = lambda rows: rows.select(F.explode(F.array_union(F.coalesce("_f", none), F.coalesce("_s", none))).alias("batch"), "impact")
    return of(met.where("_n = 1")).union(of(met.where("_n > 1")).distinct())


def batch_context(files: DataFrame, context: DataFrame) -> DataFrame:
    """Context rows (path, ...) of a batch's files, with the batch."""
    return context.join(files.select("batch", "path").distinct(), "path")


def usage_files(*lists: Column, own: Column) -> Column:
    """Files of all lists in order, once each, without empty names and the own one."""
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))
    return F.array_sort(F.filter(every, lambda f: f.isNotNull() & (f != "") & ~F.equal_null(f, own)))


def reviewed_files(*rows: tuple[DataFrame, str]) -> DataFrame:
    """(n): the different files that any of the tables names in its column."""
    out = None
    for df, c in rows:
        one = df.select(F.col(c).alias("path"))
        out = one if out is None else out.unionByName(one)
    return out.where("coalesce(path, '') <> ''").agg(F.count_distinct("path").alias("n"))


def relevance(changes: DataFrame, impacts: DataFrame) -> DataFrame:
    """changes (file, symbol, symbol_type, change_type) with repository_relevance and reason; both null where none is asked for.

    An added symbol of a relevant kind is related where an impact on it (for a file: on the file) is referred to by a file
    that was there before; unclear where only files that are added refer to it, or none. impacts: changed_file, symbol, files.
    """
    asked = changes.where((F.col("change_type") == "added") & F.col("symbol_type").isin(*RELEVANT)).select("file", "symbol", "symbol_type").distinct()
    added = changes.where("change_type = 'added' and symbol_type = 'file' and coalesce(file, '') <> ''").select(F.col("file").alias("used")).distinct().withColumn("_new", F.lit(True))
    uses = impacts.select(F.col("changed_file").alias("file"), F.col("symbol").alias("_s"), F.explode("files").alias("used")).where("coalesce(used, '') <> '' and used <> file")
    met = asked.join(uses, "file").where(F.col("symbol_type").isin("file") | F.equal_null(F.col("symbol"), F.col("_s")))
    met = met.select("file", "symbol", "symbol_type", "used").distinct().join(added, "used", "left")
    side = lambda new: F.array_sort(F.collect_set(F.when(F.col("_new").isNotNull() if new else F.col("_new").isNull(), F.col("used"))))
    sums = met.groupBy("file", "symbol", "symbol_type").agg(side(False).alias("_old"), side(True).alias("_added"))
    same = F.equal_null(F.col("symbol"), F.col("_symbol")) & (F.col("file") == F.col("_file")) & (F.col("symbol_type") == F.col("_type"))
    out = changes.join(sums.toDF("_file", "_symbol", "_type", "_old", "_added"), same, "left")
    is_asked = (F.col("change_type") == "added") & F.col("symbol_type").isin(*RELEVANT)
    old, new = F.size("_old") > 0, F.size("_added") > 0
    reason = F.when(old, F.concat(F.lit("used in: "), F.array_join("_old", ", "))).when(new, F.concat(F.lit("used only in added files: "), F.array_join("_added", ", "))).otherwise("no use found")
    return out.select(*changes.columns, F.when(is_asked, F.when(old, "related").otherwise("unclear")).alias("repository_relevance"), F.when(is_asked, reason).alias("relevance_reason"))


def evidence_lines(references: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, files, lines): the files of references (path, line), and their places as path:line, each in order and once."""
    place = F.when(F.col("path").isNotNull() & F.col("line").isNotNull(), F.concat("path", F.lit(":"), F.col("line").cast("string")))
    return references.groupBy(*by).agg(F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.collect_set(place)).alias("lines"))


def with_evidence(impacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Impacts (ord, symbol, symbol_type, changed_file, files, evidence) with the evidence (symbol, symbol_type, changed_file,
    files, lines) that was found for them, and an impact for evidence that has none.

    Evidence goes to the first impact of its symbol whose file is the same, or where one of the two has none. Without such
    an impact it makes one, if other files use the symbol or it is a routine. Evidence of one symbol and file is put together.
    """
    one = evidence.groupBy("symbol", F.coalesce("changed_file", F.lit("")).alias("changed_file")).agg(
        F.min("symbol_type").alias("symbol_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines")
    )
    one = one.withColumn("external", F.filter("files", lambda f: f != F.col("changed_file")))
    mine = impacts.select("ord", F.col("symbol").alias("_s"), F.coalesce("changed_file", F.lit("")).alias("_f"))
    near = (F.col("symbol") == F.col("_s")) & ((F.col("changed_file") == F.col("_f")) | (F.col("changed_file") == "") | (F.col("_f") == ""))
    hit = one.join(mine, near).groupBy("symbol", "changed_file").agg(F.min("ord").alias("ord"))
    tied = one.join(hit, ["symbol", "changed_file"], "left")
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = tied.where("ord is not null").groupBy("ord").agg(flat("files").alias("_files"), flat("lines").alias("_lines"), flat("external").alias("external"), F.max(F.col("symbol_type").isin(*ROUTINE)).alias("_r"))
    none = F.array().cast("array<string>")
    union = lambda a, b: F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    hint = lambda r: F.when(r, F.when(F.size("external") > 0, "critical").otherwise("high"))
    old = impacts.join(found, "ord", "left").select(
        "symbol", "symbol_type", "changed_file", union(F.col("files"), F.col("_files")).alias("files"), union(F.col("evidence"), F.col("_lines")).alias("evidence"), F.coalesce("external", none).alias("external"), hint(F.col("_r")).alias("severity_hint"), F.lit(False).alias("made")
    )
    new = tied.where(F.col("ord").isNull() & ((F.size("external") > 0) | F.col("symbol_type").isin(*ROUTINE)))
    return old.union(new.select("symbol", "symbol_type", "changed_file", "files", F.col("lines"), "external", hint(F.col("symbol_type").isin(*ROUTINE)), F.lit(True)))


def report_rows(findings: DataFrame, impacts: DataFrame, changes: DataFrame) -> DataFrame:
    """findings (finding, file, symbol, message) with the impact and the change that a report shows beside each.

    The impact is the file's first one (by ord) whose symbol is the finding's or stands in its message, else the file's
    only one; the change is the first of the impact's file and symbol, without an impact of the finding's. A file's
    impacts are one row, with the first of each symbol, so that a finding meets no row for each impact.
    """
    i = impacts.groupBy(F.col("changed_file").alias("_f"), F.col("symbol").alias("_s")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("_n"))
    i = i.groupBy("_f").agg(F.sort_array(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "_s")))).alias("_all"), F.sum("_n").alias("_n"))
    met = findings.select("finding", "file", F.col("symbol").alias("_own"), "message").join(i, F.col("file") == F.col("_f"))
    fits = lambda x: (F.coalesce(x["_s"], F.lit("")) != "") & (F.equal_null(x["_s"], F.col("_own")) | F.contains(F.coalesce("message", F.lit("")), x["_s"]))
    met = met.select("finding", F.get(F.filter("_all", fits), F.lit(0)).alias("_b"), "_n", F.get("_all", F.lit(0)).alias("_o"))
    best = met.groupBy("finding").agg(F.min("_b").alias("_b"), F.sum("_n").alias("_n"), F.min("_o").alias("_o"))
    best = best.select("finding", F.coalesce("_b", F.when(F.col("_n") == 1, F.col("_o"))).alias("_i")).where("_i is not null")
    out = findings.join(best, "finding", "left").withColumns({"impact": F.col("_i.ord"), "_want": F.when(F.col("_i").isNotNull(), F.col("_i._s")).otherwise(F.col("symbol"))})
    c = changes.groupBy(F.col("file").alias("_cf"), F.col("symbol").alias("_cs")).agg(F.min("ord").alias("change"))
    return out.join(c, (F.col("file") == F.col("_cf")) & F.equal_null(F.col("_want"), F.col("_cs")), "left").select("finding", "impact", "change")


def prefetched(items: DataFrame, by: str, size: Column, most_items: int = 50, most_chars: int = 80_000) -> DataFrame:
    """The first items (by, ord) of a group, until their sizes together pass the cap; that one is the first to go."""
    order = W.partitionBy(by).orderBy("ord")
    ranked = items.withColumns({"_n": F.row_number().over(order), "_sum": F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))})
    return ranked.where((F.col("_n") <= most_items) & (F.col("_sum") <= most_chars)).drop("_n", "_sum")


class SourceBudget:
    """The different source files that a conversation has seen; a result that would pass the cap is refused and changes nothing."""

    def __init__(self, most: int = 30):
        self.most, self.seen = most, set()

    def add(self, paths: Sequence[str]) -> None:
        if len(self.seen | set(paths)) > self.most:
            raise ValueError("too many source files; ask for less")
        self.seen |= set(paths)


def _paths(x: object) -> Iterator[str]:
    stack = [x]
    while stack:
        now = stack.pop()
        if isinstance(now, dict):
            for k, v in now.items():
                if k == "path" and isinstance(v, str):
                    yield v
                else:
                    stack.append(v)
        elif isinstance(now, list):
            stack += now


def first_object(text: str | None) -> str | None:
    """The JSON object that a text is, is fenced in, or holds first; null where there is none."""
    s = (text or "").strip()
    rows = s.splitlines()
    if s.startswith("```"):
        rows = rows[1:] if rows[0].strip().lower() in ("```", "```json") else rows
        rows = rows[:-1] if rows and rows[-1].strip() == "```" else rows
        s = "\n".join(rows).strip()
    try:
        whole = json.loads(s)
        return json.dumps(whole, sort_keys=True) if isinstance(whole, dict) else None
    except ValueError:
        pass
    read, at = json.JSONDecoder(), s.find("{")
    while at >= 0:
        try:
            return json.dumps(read.raw_decode(s, at)[0], sort_keys=True)
        except ValueError:
            at = s.find("{", at + 1)
    return None


def json_objects(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, object, paths): the first JSON object of each text, keys in order, and all values of its keys ``path`` in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [first_object(x) for x in b.column(1).to_pylist()]
            paths = [sorted(set(_paths(json.loads(x)))) if x else [] for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string()), pa.array(paths, pa.list_(pa.string()))], [key, "object", "paths"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, object string, paths array<string>")


def python_findings(files: DataFrame) -> DataFrame:
    """(path, line, severity, category, rule): one finding for a Python file that the running Python cannot parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast
        import warnings

        warnings.simplefilter("ignore")
        for b in batches:
            paths, lines = [], []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    ast.parse(c or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    paths.append(p)
                    lines.append(getattr(e, "lineno", None) or 1)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.int32())], ["path", "line"])

    found = files.where(T.suffix(F.col("path")) == "py").select("path", "content").mapInArrow(run, "path string, line int")
    return found.select("path", "line", F.lit("critical").alias("severity"), F.lit("syntax_error").alias("category"), F.lit("python_syntax").alias("rule"))
