"""Search for references to SQL objects in analysed files, and on through the views and routines that hold them.

Input is the rows of ``quarry.operators.lineage``. Names match by their last parts; see ``object_match``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROUTINES = ("function", "table_function", "procedure")


def parts(name: Column) -> Column:
    """Lower-cased parts of a dotted name."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "`", "")), r"\."), lambda p: p != "")


def tail(p: Column, n: int) -> Column:
    return F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), n)


def object_match(target: Column, candidate: Column) -> Column:
    """confirmed, possible or null. Three parts of a target must all be equal; of two, both, or the object alone where the
    candidate has no more; one part is always possible."""
    n, m = F.size(target), F.size(candidate)
    same = lambda k: tail(target, k) == tail(candidate, k)
    return (
        F.when((n == 0) | (m == 0), None)
        .when(n >= 3, F.when((m >= 3) & same(3), "confirmed"))
        .when(n == 2, F.when((m >= 2) & same(2), "confirmed").when((m == 1) & same(1), "possible"))
        .otherwise(F.when(same(1), "possible"))
    )


def column_split(target: Column, candidate: Column) -> Column:
    """How many leading parts of a target column name the candidate's object: 3, 2 or 1, the first that match, else 0."""
    out = F.lit(0)
    for k in (1, 2, 3):
        out = F.when((F.size(target) > k) & object_match(F.slice(target, 1, k), candidate).isNotNull(), k).otherwise(out)
    return out


def capped(match: Column, confidence: Column) -> Column:
    """A candidate that is not sure of itself makes a match possible."""
    return F.when(match.isNotNull(), F.when(confidence == "confirmed", match).otherwise("possible"))


def candidates(analysis: DataFrame) -> DataFrame:
    """Rows that may refer to something, with ``what`` (object, routine, column, wildcard) and their parts; ignored ones too."""
    what = (
        F.when((F.col("record") == "source") & (F.col("kind") == "table"), "object")
        .when(F.col("record") == "routine", "routine")
        .when(F.col("record") == "column", "column")
        .when(F.col("record") == "wildcard", "wildcard")
    )
    rows = analysis.withColumn("what", what).where("what is not null").withColumn("_p", parts(F.col("name")))
    return rows.withColumns({"_c": F.when(F.col("what") == "column", parts(F.col("column"))), "_last": F.element_at(F.col("_p"), -1)})


def match(found: DataFrame, targets: DataFrame) -> DataFrame:
    """candidates joined with the targets (target, symbol_type) that they refer to, and how sure that is (``sure``).

    Objects and routines meet targets by the last part, columns by the last part of the column, wildcards by the object's
    last part; a target of one part may be any column, and so meets all wildcards. What is ignored refers to nothing.
    """
    kind = F.when(F.lower("symbol_type") == "column", "column").when(F.lower("symbol_type") == "function", "routine").otherwise("object")
    t = targets.select("target", "symbol_type").distinct().withColumns({"_t": parts(F.col("target")), "_w": kind})
    free = found.where("confidence <> 'ignored'")
    p, q, c = F.col("_p"), F.col("_t"), F.col("_c")

    plain = free.where(F.col("what").isin("object", "routine")).join(t.withColumn("_k", F.element_at("_t", -1)), (F.col("_last") == F.col("_k")) & (F.col("what") == F.col("_w")))
    plain = plain.withColumn("sure", capped(object_match(q, p), F.col("confidence"))).drop("_k")

    columns = t.where("_w = 'column'").withColumn("_k", F.element_at("_t", -1))
    named = free.where("what = 'column'").withColumn("_l", F.element_at("_c", -1)).join(columns, F.col("_l") == F.col("_k")).withColumn("_n", column_split(q, p))
    rest = F.slice(q, F.col("_n") + 1, F.size(q))
    of_object = capped(object_match(F.slice(q, 1, F.col("_n")), p), F.col("confidence"))
    named = named.withColumn("sure", F.when(rest == c, F.when(F.col("_n") == 0, "possible").otherwise(of_object))).drop("_k", "_l", "_n")

    keys = F.array_distinct(F.transform(F.slice(q, 1, F.least(F.size(q) - 1, F.lit(3))), lambda x: x))
    by_object = columns.withColumn("_k", F.explode(F.when(F.size(q) > 1, keys).otherwise(F.array(F.lit("*")))))
    stars = free.where("what = 'wildcard'").withColumn("_o", F.explode(F.array("_last", F.lit("*")))).join(by_object, F.col("_o") == F.col("_k")).withColumn("_n", column_split(q, p))
    away = F.array_union(F.split(F.lower(F.coalesce("column", F.lit(""))), ","), F.split(F.lower(F.coalesce("alias", F.lit(""))), ","))
    one = F.size(q) - F.col("_n") == 1
    stars = stars.withColumn("sure", F.when(one & ~F.array_contains(away, F.element_at(q, -1)), F.when(F.col("_n") == 0, "possible").otherwise(of_object))).drop("_k", "_o", "_n")
    return plain.unionByName(named).unionByName(stars.distinct()).where("sure is not null")


def owners(analysis: DataFrame) -> DataFrame:
    """(path, statement, owner, owner_kind) of the views and routines that are created."""
    made = analysis.where((F.col("record") == "definition") & F.col("kind").isin("view", *ROUTINES))
    return made.select("path", "statement", F.col("name").alias("owner"), F.col("kind").alias("owner_kind"))


def sole_owners(analysis: DataFrame) -> DataFrame:
    """The owners of statements that have one only."""
    n = F.count(F.lit(1)).over(W.partitionBy("path", "statement"))
    return owners(analysis).withColumn("_n", n).where("_n = 1").drop("_n")


def consumers(analysis: DataFrame) -> DataFrame:
    """Edges: each owner with the rows that refer to it (columns of ``candidates``, ``sure``) and the owners of those."""
    known = owners(analysis).select("owner", "owner_kind").distinct()
    targets = known.select(F.col("owner").alias("target"), F.when(F.col("owner_kind") == "view", "table").otherwise("function").alias("symbol_type"))
    edges = match(candidates(analysis), targets)
    kinds = known.withColumn("symbol_type", F.when(F.col("owner_kind") == "view", "table").otherwise("function")).withColumnsRenamed({"owner": "target"})
    edges = edges.join(kinds, ["target", "symbol_type"]).withColumnsRenamed({"target": "via", "owner_kind": "via_kind"})
    return edges.join(sole_owners(analysis), ["path", "statement"], "left")


ROW = ("path", "line", "statement", "scope", "name", "column", "kind", "clause", "what")


def search(analysis: DataFrame, lines: DataFrame, targets: DataFrame, cut: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """All references to targets (target, symbol_type), direct ones and those through views and routines.

    Rows: target, confidence, dependency_kind, dependency_depth, dependency_path, via, path, line, content and the
    candidate's columns. A reference inside a view or routine makes that an object whose references follow, a step deeper;
    a way is confirmed only where every step is. An owner is passed on again only where it is reached more surely than
    before, which ends cycles; of ways of one length the first by path counts. ``cut`` breaks the lineage of each round.
    One row stays for each place, name and column, direct before transitive, then the shortest; ``most`` keeps the first of
    a target, confirmed ones before possible ones.
    """
    key = F.struct(F.lower("owner_kind").alias("k"), F.lower("owner").alias("o"))
    direct = match(candidates(analysis), targets).join(sole_owners(analysis), ["path", "statement"], "left")
    item = lambda df, kind: df.select("target", F.col("sure").alias("confidence"), F.lit(kind).alias("dependency_kind"), "_depth", "_way", "via", *ROW, "owner", "owner_kind")
    direct = direct.withColumns({"_depth": F.lit(0), "_way": F.array("target"), "via": F.lit(None).cast("string")})
    found = cut(item(direct, "direct"))
    edges = cut(consumers(analysis))

    def reached(rows: DataFrame) -> DataFrame:
        at = rows.where("owner is not null").withColumns({"_key": key, "_s": F.when(F.col("confidence") == "confirmed", 0).otherwise(1)})
        way = F.when(F.col("_depth") == 0, F.concat("_way", F.array("owner"))).otherwise(F.col("_way"))
        return at.groupBy("target", "_key").agg(F.min(F.struct("_s", way.alias("_way"), "owner", "owner_kind")).alias("b")).select("target", "_key", "b.*")

    front = cut(reached(found))
    seen = front.select("target", "_key", "_s")
    for depth in itertools.count(1):
        if front.isEmpty():
            break
        at = front.select("target", F.col("owner").alias("via"), F.col("owner_kind").alias("via_kind"), F.col("_s"), "_way")
        step = at.join(edges, ["via", "via_kind"])
        sure = F.when((F.col("_s") == 0) & (F.col("sure") == "confirmed"), "confirmed").otherwise("possible")
        step = step.withColumns({"sure": sure, "_depth": F.lit(depth), "_way": F.concat("_way", F.array(F.coalesce("owner", "path")))})
        step = cut(item(step, "transitive"))
        found = found.union(step)
        known = seen.groupBy("target", "_key").agg(F.min("_s").alias("_k"))
        front = cut(reached(step).join(known, ["target", "_key"], "left").where(F.col("_k").isNull() | (F.col("_s") < F.col("_k"))).drop("_k"))
        seen = cut(seen.union(front.select("target", "_key", "_s")))
    place = W.partitionBy("target", "confidence", "path", "line", "what", "name", "column").orderBy(F.col("dependency_kind"), "_depth", "_way", "scope", "clause")
    out = found.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n", "owner", "owner_kind")
    if most:
        order = W.partitionBy("target").orderBy(F.col("confidence"), "path", "line", "name", "column")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    out = out.join(lines.select("path", "line", "content"), ["path", "line"], "left")
    return out.withColumnsRenamed({"_depth": "dependency_depth", "_way": "dependency_path"})


def counts(found: DataFrame) -> DataFrame:
    """By target: direct and transitive references, and those that are confirmed."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return found.groupBy("target").agg(n("dependency_kind", "direct").alias("direct"), n("dependency_kind", "transitive").alias("transitive"), n("confidence", "confirmed").alias("confirmed"), F.count(F.lit(1)).alias("n"))
