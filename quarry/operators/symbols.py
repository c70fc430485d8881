"""Changed symbols of diffs. Input is the lines of diffs as ``quarry.sources.diffs`` gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import corpus as C

KEY = ("path", "symbol", "symbol_type")


def changed(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("kind").isin("added", "removed"))


def declaration_events(lines: DataFrame) -> DataFrame:
    """Events of Python and Go files (path, symbol, symbol_type, kinds, source_lines, target_lines, detected_from).

    A changed line that declares a symbol is one. So is a hunk's header that names a symbol, where that symbol is among
    the hunk's changed declarations, or where none is and its changed lines hold more than comments and blanks.
    """
    rows = changed(lines).where(T.suffix(F.col("path")).isin("py", "go")).withColumn("_s", T.symbol(F.col("path"), F.col("content")))
    listed = lambda c: F.array_compact(F.array(F.col(c)))
    by_line = rows.where("_s is not null").select(
        "path", F.col("_s.name").alias("symbol"), F.col("_s.kind").alias("symbol_type"), F.array("kind").alias("kinds"), listed("source_line").alias("source_lines"),
        listed("target_line").alias("target_lines"), F.lit("changed_declaration").alias("detected_from"),
    )
    body = F.bool_or(F.col("_s").isNull() & ~T.comment_or_blank(F.col("path"), F.col("content")))
    hunks = rows.groupBy("path", "hunk", "section", "source_start", "target_start").agg(F.collect_set("_s").alias("_all"), body.alias("_body"))
    hunks = hunks.withColumn("_h", T.symbol(F.col("path"), F.col("section"))).where("_h is not null")
    hunks = hunks.where(F.array_contains("_all", F.col("_h")) | ((F.size("_all") == 0) & F.col("_body")))
    by_header = hunks.select(
        "path", "_h.name", "_h.kind", F.array(F.lit("added"), F.lit("removed")), listed("source_start"), listed("target_start"), F.lit("hunk_header")
    )
    return by_line.union(by_header)


def fold(events: DataFrame) -> DataFrame:
    """One row a symbol: the kinds seen decide between added, deleted and modified; lines and origins in order, once each."""
    one = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = events.groupBy(*KEY).agg(one("kinds").alias("_k"), one("source_lines").alias("source_lines"), one("target_lines").alias("target_lines"), F.array_sort(F.collect_set("detected_from")).alias("detected_from"))
    kind = F.when(F.col("_k") == F.array(F.lit("added")), "added").when(F.col("_k") == F.array(F.lit("removed")), "deleted").otherwise("modified")
    return out.withColumn("change_type", kind).drop("_k")


def fragments(lines: DataFrame) -> DataFrame:
    """(path, hunk, side, n, actual_line, changed, content): the SQL of each side of each hunk, line by line from 1.

    The base side has context and removed lines, the head side context and added ones. A header that declares a symbol
    stands first, unless a line of the hunk says the same.
    """
    rows = lines.where((T.suffix(F.col("path")) == "sql") & F.col("hunk").isNotNull() & (F.col("kind") != "truncated"))
    said = rows.groupBy("path", "hunk", "section", "source_start", "target_start").agg(F.collect_set(T.strip(F.col("content"))).alias("_t"))
    heads = said.where(T.symbol(F.col("path"), F.col("section")).isNotNull() & ~F.array_contains("_t", T.strip(F.col("section"))))

    def side(name: str, away: str, kind: str, number: str, start: str) -> DataFrame:
        own = rows.where(F.col("kind") != away).select("path", "hunk", F.lit(name).alias("side"), F.col("line").alias("_o"), F.col(number).alias("actual_line"), (F.col("kind") == kind).alias("changed"), "content")
        return own.union(heads.select("path", "hunk", F.lit(name), F.lit(0), start, F.lit(False), "section"))

    both = side("base", "added", "removed", "source_line", "source_start").union(side("head", "removed", "added", "target_line", "target_start"))
    n = F.row_number().over(W.partitionBy("path", "hunk", "side").orderBy("_o"))
    return both.select("path", "hunk", "side", n.alias("n"), "actual_line", "changed", "content")


def fragment_texts(parts: DataFrame) -> DataFrame:
    """(path, hunk, side, content): a hunk is as long as a diff makes it, and one text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), "\n")
    return parts.groupBy("path", "hunk", "side").agg(text.alias("content"))


def effects(analysis: DataFrame) -> DataFrame:
    """analysis rows with their effects on symbols: (..., symbol, symbol_type, effect)."""
    record, kind = F.col("record"), F.col("kind")
    kind_of = lambda k: F.when(k.isin("table", "view"), "table").when(k.isin("function", "table_function", "procedure"), "function")
    one = lambda s, t, e: F.struct(s.alias("symbol"), t.alias("symbol_type"), F.lit(e).alias("effect"))
    name, table = F.col("name"), F.lit("table")
    column = F.concat_ws(".", "name", "column")
    changes = F.regexp_extract(kind, "^[a-z]+_(.*)$", 1)
    none = F.array().cast("array<struct<symbol:string,symbol_type:string,effect:string>>")
    made = (
        F.when(record == "definition", F.array(one(name, kind_of(kind), "present")))
        .when(record == "definition_column", F.array(one(column, F.lit("column"), "present"), one(name, table, "modified")))
        .when((record == "mutation") & kind.startswith("alter_"), F.array(one(name, kind_of(changes), "modified")))
        .when((record == "mutation") & kind.startswith("drop_"), F.array(one(name, kind_of(changes), "absent")))
        .when((record == "column_mutation") & (kind == "add"), F.array(one(name, table, "modified"), one(column, F.lit("column"), "present")))
        .when((record == "column_mutation") & (kind == "drop"), F.array(one(name, table, "modified"), one(column, F.lit("column"), "absent")))
        .when((record == "column_mutation") & (kind == "rename"), F.array(one(name, table, "modified"), one(column, F.lit("column"), "absent"), one(F.concat_ws(".", "name", "alias"), F.lit("column"), "present")))
        .otherwise(none)
    )
    out = analysis.select("*", F.explode(made).alias("_e")).select(*analysis.columns, "_e.*")
    return out.where("symbol is not null and symbol_type is not null")


def side_events(parts: DataFrame, analysis: DataFrame) -> DataFrame:
    """Events of SQL hunks from the analysis of their fragments, whose path is ``fragment_key``: only what changed lines say.

    The states of the two sides of a hunk are compared symbol by symbol.
    """
    said = effects(analysis).select(F.col("path").alias("_k"), F.col("line").alias("n"), "symbol", "symbol_type", "effect")
    keyed = parts.where("changed").withColumn("_k", fragment_key()).select("_k", "n", "path", "hunk", "side", "actual_line")
    rows = keyed.join(said, ["_k", "n"])
    at = lambda s: F.array_compact(F.collect_set(F.when(F.col("side") == s, F.col("actual_line"))))
    effect = lambda s: C.effect(F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("effect")))))
    both = rows.groupBy("path", "hunk", "symbol", "symbol_type").agg(effect("base").alias("base"), effect("head").alias("head"), at("base").alias("source_lines"), at("head").alias("target_lines"))
    both = both.withColumn("_c", C.transition(F.col("base"), F.col("head"))).where("_c is not null")
    return both.select("path", "symbol", "symbol_type", kinds_of(F.col("_c")).alias("kinds"), "source_lines", "target_lines", F.lit("side_states").alias("detected_from"))


def fragment_key() -> Column:
    return F.concat_ws("#", "path", F.col("hunk").cast("string"), "side")


def kinds_of(change: Column) -> Column:
    return F.when(change == "added", F.array(F.lit("added"))).when(change == "deleted", F.array(F.lit("removed"))).otherwise(F.array(F.lit("added"), F.lit("removed")))


def owners(analysis: DataFrame, by: list[str]) -> DataFrame:
    """(by, symbol, symbol_type): the one view or routine that a file defines; files that define several have none."""
    made = analysis.where((F.col("record") == "definition") & F.col("kind").isin("view", "function", "table_function", "procedure"))
    kind = F.when(F.col("kind") == "view", "table").otherwise("function")
    out = made.groupBy(*by).agg(F.collect_set(F.struct(F.col("name").alias("symbol"), kind.alias("symbol_type"))).alias("_o"))
    return out.where(F.size("_o") == 1).select(*by, F.col("_o")[0]["symbol"].alias("symbol"), F.col("_o")[0]["symbol_type"].alias("symbol_type"))


def owner_events(lines: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """Events of SQL files whose changed lines are more than comments and blanks: the owner (path, symbol, symbol_type) of
    the file at base and at head is modified where it is the same, else deleted and added."""
    rows = changed(lines).where((T.suffix(F.col("path")) == "sql") & ~T.comment_or_blank(F.col("path"), F.col("content")))
    at = lambda kind, number: F.array_compact(F.collect_set(F.when(F.col("kind") == kind, F.col(number))))
    files = rows.groupBy("path").agg(at("removed", "source_line").alias("_s"), at("added", "target_line").alias("_t"))
    sides = base.withColumn("_b", F.lit(True)).join(head.withColumn("_h", F.lit(True)), list(KEY), "full_outer")
    change = F.when(F.col("_b") & F.col("_h"), "modified").when(F.col("_b"), "deleted").otherwise("added")
    out = files.join(sides.withColumn("_c", change), "path")
    none = F.array().cast("array<int>")
    return out.select("path", "symbol", "symbol_type", kinds_of(F.col("_c")).alias("kinds"), F.when(F.col("_c") == "added", none).otherwise(F.col("_s")).alias("source_lines"), F.when(F.col("_c") == "deleted", none).otherwise(F.col("_t")).alias("target_lines"), F.lit("repository_definition").alias("detected_from"))


def meaningful(lines: DataFrame) -> DataFrame:
    """(path, change_type) of SQL files whose changed lines hold more than comments and white space; block comments run on
    from line to line."""
    rows = changed(lines).where(T.suffix(F.col("path")) == "sql")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "line", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("path", "change_type").agg(text.alias("_t")).where(T.meaningful_sql(F.col("_t"))).select("path", "change_type")


def completed_changes(changes: DataFrame, symbols: DataFrame, files: DataFrame, meaning: DataFrame) -> DataFrame:
    """(path, symbol, symbol_type, change_type, origin): given changes, and what a SQL change must name besides.

    A new file is named; a file whose symbols none knows, but whose diff has a meaning, counts as a query under its name
    without suffix; and each known table, column or routine. Of the same path, symbol and change the first stays, in this order.
    """
    is_sql = T.suffix(F.col("path")) == "sql"
    known = symbols.where(is_sql & F.col("symbol_type").isin("table", "column", "function") & (F.col("symbol") != ""))
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    row = lambda df, symbol, kind, change, n: df.select("path", symbol.alias("symbol"), kind.alias("symbol_type"), change.alias("change_type"), F.lit(n).alias("origin"))
    new = row(files.where(is_sql & (F.col("change_type") == "added")), F.lit("entire file"), F.lit("file"), F.lit("added"), 1)
    queries = row(meaning.join(known, "path", "left_anti"), stem, F.lit("query"), T.plain_change(F.col("change_type")), 2)
    named = row(known, F.col("symbol"), F.col("symbol_type"), T.plain_change(F.col("change_type")), 3)
    given = row(changes, F.col("symbol"), F.col("symbol_type"), F.col("change_type"), 0)
    return C.first_of(given.union(new).union(queries).union(named), ["path", "symbol", "change_type"], [F.col("origin"), F.col("symbol_type")])
