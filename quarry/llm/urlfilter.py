"""URL filters: a blocked Bloom filter of the listed canonical URLs, then an exact hash join for what passes it.

A listed URL is a host with a path prefix. A page's keys are its host and every parent domain, each with every prefix of
its path whose length some listed path has. The filter has one block of 4 times 64 bits for each key's hash; a key sets
and tests eight bits of its block. Only keys that pass go to the exact join, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Listed URLs to a block: at 8 bits each in 256 bits, about one key in 500 passes by chance.
PER_BLOCK = 12
#: Blocks that are broadcast (40 bytes each); a larger filter is joined by block number.
BROADCAST_BLOCKS = 100_000

RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the block's four words."""
    h = F.xxhash64(key, F.lit(2))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom(listed: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3) of the blocks in use, and the number of blocks."""
    blocks = max(1, -(-n // PER_BLOCK))
    words = {f"w{i}": m for i, m in enumerate(_masks(F.col(key)))}
    rows = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(w) for w, m in words.items()])
    return rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]), blocks


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of pages.

    rules: (action, host, path). A rule fits its host and all subdomains where the path starts with the rule's; the
    longest of them (host, then path, by characters in all) decides, and of rules alike in host and path the action that
    sorts last, so that block beats allow. rule is null and the verdict ``default`` where none fits: a URL that is not
    listed, a null URL, one without ``://``. Every row is kept, repeated rows too. An empty list gives every page the
    default. Columns of these names in the input are replaced; others may have any names. Only the number of rules and the
    different lengths of their paths come to the driver; these are no more than characters in the longest path.
    """
    added = ("host", "path", "rule", "verdict")
    listed = rules.select(F.concat(lower_ascii(F.col("host")), F.col("path")).alias("_key"), "action").where("_key is not null")
    listed = listed.groupBy("_key").agg(F.max("action").alias("_action"))
    facts = rules.where("host is not null and path is not null").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = host_and_path(F.col(f"__own_{pages.columns.index(url)}"))
    shielded, own = common.shielded(pages)
    judged = shielded.withColumn("host", host).withColumn("path", path)
    keep = [F.col(n).alias(c) for c, n in own.items() if c not in added]
    if not facts["n"]:
        return judged.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # What decides is host and path alone: each pair is looked up once, so that a host with a third of all pages is not
    # a hot key, and goes back by a join that can be split.
    hosts = judged.select("host", "path").distinct()
    lengths = F.array(*[F.lit(x) for x in facts["lengths"]])
    heads = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(heads, lambda p: F.concat(h, p))))
    asked = hosts.select("host", "path", F.explode(keys).alias("_key"))
    filt, blocks = bloom(listed, "_key", facts["n"])
    filt = F.broadcast(filt) if blocks <= BROADCAST_BLOCKS else filt
    masks = _masks(F.col("_key"))
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    passed = asked.withColumn("_b", _block(F.col("_key"), blocks)).join(filt, (F.col("_b") == F.col("block")) & hit).select("host", "path", "_key")
    exact = passed.join(common.small(listed, facts["n"]), "_key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("_key").alias("l"), "_key", "_action")).alias("_best"))
    out = judged.join(best, ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("_best._key").alias("rule"), F.coalesce("_best._action", F.lit(default)).alias("verdict"))
