"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits; the vector of the segments' bit counts moves by at most one unit
of Manhattan distance for each bit that differs, so that Manhattan distance is a lower bound of Hamming distance. Of two
fingerprints within ``radius`` bits, one half's vectors lie within radius // 2, and then some grid point lies within
half of that of both. Every fingerprint is put on the grid points of each half within that reach; fingerprints that
share a point are compared exactly. Copies are one fingerprint throughout, and a point gives a forest of its links, not
all pairs.

Texts of a Jaccard similarity have longer fingerprints, as their bits differ more. Points are then the popcounts of a
few segments, many times over, and what lies near by Hamming distance is decided on the texts' whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints of one grid point that are compared in one task; more are dealt to blocks.
POINT_BLOCK = 4096
#: Points of up to so many fingerprints are compared pair by pair, many points at once.
SMALL_POINT = 8


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, A-Z lower-cased; fewer words than a shingle are one."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = max(1, len(parts) - words + 1) if parts else 0
    joined = b" ".join(parts)
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] * n, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Signed word of the bits that are set in over half of h."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        count += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit SimHash of a whole text's word shingles; zero where there is no word."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, _fp long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["_k", "_fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"_k {kind}, _fp long")


def grid_points(fp: np.ndarray, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, point) for all points of both halves within ``reach`` (0 or 1) of each fingerprint's vector."""
    fp = fp.view(np.uint64)
    pairs = (fp & np.uint64(0x5555555555555555)) + ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    index, points = [], []
    for half in range(2):
        part = (pairs >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        me = np.arange(len(fp))
        index.append(me)
        points.append(part << np.uint64(1) | np.uint64(half))
        for s in range(16 if reach else 0):
            digit = (part >> np.uint64(2 * s)) & np.uint64(3)
            one = np.uint64(1 << (2 * s))
            for ok, moved in ((digit < 2, part + one), (digit > 0, part - one)):
                index.append(me[ok])
                points.append(moved[ok] << np.uint64(1) | np.uint64(half))
    return np.concatenate(index), np.concatenate(points).astype(np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, of fingerprints as rows of unsigned words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., w] ^ b[..., w])
    return out


def forest(fp: np.ndarray, radius: int, side: np.ndarray | None = None, until: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join what is connected within ``radius`` bits, one less than members; with side, only across sides.

    With until (ascending), fingerprint i need not be compared with those from until[i] on.
    """
    label = np.arange(len(fp))
    step = max(1, min(len(fp), (1 << 18) // len(fp)))
    for s in range(0, len(fp), step):
        end = len(fp) if until is None else int(until[min(s + step, len(fp)) - 1])
        near = apart(fp[s : s + step, None, :], fp[None, s:end, :]) <= radius
        if side is not None:
            near &= side[s : s + step, None] != side[None, s:end]
        i, j = np.nonzero(near)
        label = united(label, i[j > i] + s, j[j > i] + s)
    child = np.flatnonzero(label != np.arange(len(fp)))
    return label[child], child


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least members of the sets with these least members, after those of i and j are joined."""
    while len(i):
        low = np.minimum(label[i], label[j])
        top = np.maximum(label[i], label[j])
        if (low == top).all():
            break
        np.minimum.at(label, top, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, block: int = POINT_BLOCK) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most ``radius`` bits (up to 5); component_id is the smallest
    key reachable. Texts that are null or hold no word have fingerprint zero and link like others. Rows with a null key
    keep a row and take part through their fingerprint, but are no component_id unless nothing else is reachable, and
    then it is null. Repeated rows are repeated in the result. An empty table gives an empty result. Texts of any length
    are taken whole. Other columns are left out and may have any names; a key named like a result column raises ValueError.
    """
    if key in ("fingerprint", "component_id"):
        raise ValueError(f"the key is named like a result column: {key}")
    if not 0 <= radius <= 5:
        raise ValueError("radius from 0 to 5")
    prints = common.cut(fingerprints(docs, key, text, words))
    groups = common.cut(prints.groupBy("_fp").agg(F.min("_k").alias("_rep"), F.count(F.lit(1)).alias("_m")))
    hexed = F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint")
    return _named(prints, groups, _links(groups, radius, block), key, [hexed])


def _links(groups: DataFrame, radius: int, block: int) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(k, 4096).to_numpy(zero_copy_only=False)
                i, point = grid_points(fp)
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(fp[i])], ["p", "id"])

    return _compare(groups.select("_fp").mapInArrow(spread, "p long, id long"), [], radius, block)


def _compare(points: DataFrame, lanes: list[str], radius: int, block: int) -> DataFrame:
    """(a, b): links of ids that share a point p and whose fingerprints (the lanes, or else the id) are within radius."""
    n = common.partitions(points.sparkSession)
    # Points with too many fingerprints for one task: pairs of blocks, each with the rows of two.
    hot = common.cut(points.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block))
    if hot.isEmpty():
        points = points.withColumns({c: F.lit(0) for c in ("x", "y", "mine")})
    else:
        hot = hot.select("p", F.ceil(F.col("c") / block).cast("int").alias("m"))
        points = points.join(hot, "p", "left").withColumn("m", F.coalesce("m", F.lit(1)))
        points = points.withColumn("mine", F.pmod(F.xxhash64("id"), "m").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        points = points.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    dealt = points.select("p", "x", "y", "mine", "id", *lanes).repartition(n, "p", "x", "y").sortWithinPartitions("p", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                now = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
            p, x, y = now[:3]
            new = np.flatnonzero((p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            cuts = [0, *new.tolist()]
            held = [c[cuts[-1] :] for c in now]
            if len(cuts) > 1:
                yield from point_links(cuts, *now[1:])
        if held is not None:
            yield from point_links([0, len(held[0])], *held[1:])

    def point_links(cuts: list[int], x, y, mine, ids, *words) -> Iterator[pa.RecordBatch]:
        cuts = np.array(cuts)
        size = np.diff(cuts)
        f = np.stack(words or [ids], axis=1).view(np.uint64)
        out = [(ids[:0], ids[:0])]
        group = np.repeat(np.arange(len(size)), size)
        small = size[group] <= SMALL_POINT
        for lag in range(1, SMALL_POINT):  # small points all at once
            i = np.flatnonzero(small[: len(group) - lag] & (group[lag:] == group[: len(group) - lag])) if len(group) > lag else cuts[:0]
            if not len(i):
                break
            i = i[apart(f[i], f[i + lag]) <= radius]
            out.append((ids[i], ids[i + lag]))
        for g in np.flatnonzero(size > SMALL_POINT).tolist():
            s, e = cuts[g], cuts[g + 1]
            i, j = forest(f[s:e], radius, mine[s:e] if x[s] != y[s] else None)
            out.append((ids[s + i], ids[s + j]))
        a, b = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


#: Sets of one key that meet in a task, and about as many shingles; more are dealt to blocks.
SETS_BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Words of a long fingerprint: those that are cut into segments for the tables, then those of the Hamming check.
TABLE_WORDS, CHECK_WORDS = 16, 2
SALTS = np.random.default_rng(19).integers(0, 1 << 63, TABLE_WORDS + CHECK_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Tables of the near-copy search and segments in the point of each; small sets, whose bits differ more, have fewer.
TABLES, SEGMENTS, SMALL_SEGMENTS = 200, 9, 6
#: Tables that are met first; in the others a set goes by the name of what these join, and only links of unlike names are left.
FIRST_TABLES = 16
#: Sets of up to so many shingles are small; a set up to 1 / similarity times as large meets them too.
SMALL_SET = 16
#: By how much more small sets' bits may differ: 4 shingles of 5 differ in 3 bits of 16, the angle of large sets gives 0.1515.
SMALL_MORE = 0.036
#: Fingerprints of one cell (a table's point) that are compared in one task, and parts of a table at least.
CELL, PARTS = 1 << 15, 8
#: Links that are joined to a forest in one task, about.
FOREST = 1_000_000
#: What a cell is told of a set: point, size on a scale of logarithms, words of the Hamming check.
RECORD = np.dtype([("p", "<u2"), ("s", "<u2"), ("w", "<u8", CHECK_WORDS)])
#: Bit of a record's size where the set goes by another name than its first check word; such names travel beside the records.
RENAMED = np.uint16(1 << 15)


def table_weights(segments: int) -> np.ndarray:
    """Powers of three for the segments of each table; popcounts times these are the points."""
    out, r = np.zeros((TABLE_WORDS * 32, TABLES), np.float32), np.random.default_rng(23)
    for t in range(TABLES):
        out[r.choice(len(out), SEGMENTS, replace=False)[:segments], t] = 3.0 ** np.arange(segments)
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the different word shingles of a whole text."""
    return np.unique(shingle_hashes(text, words))


def set_id(h: np.ndarray) -> int:
    """Signed word for a set of shingles; zero for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)) if len(h) else 0


def long_print(h: np.ndarray) -> np.ndarray:
    """Words of the SimHash of a set of shingles, a bit set in over half of them; the first shingle decides where halves are even."""
    count = np.zeros(64 * len(SALTS), np.int64)
    for k in range(0, len(h), 255):
        x = h[k : k + 255, None] + SALTS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        if not k:
            first = bits[0]
        count += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count + first > len(h), bitorder="little").view(np.uint64)


def differing(similarity: float) -> float:
    """Share of bits that differ between large sets of a similarity, of equal size: where sizes differ, it is less."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def bits_within(share: float) -> int:
    """Radius of the Hamming check for pairs with that share of differing bits: 4.6 standard deviations above the mean."""
    n = 64 * CHECK_WORDS
    return int(n * share + 4.6 * (n * share * (1 - share)) ** 0.5)


def with_points(size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which sets have a small and which a large point; those of a middle size have both."""
    return np.flatnonzero(size <= SMALL_SET / similarity + 1e-9), np.flatnonzero(size > SMALL_SET)


def cells(words: np.ndarray, size: np.ndarray, similarity: float, tables: range = range(TABLES)) -> Iterator[tuple[int, np.ndarray]]:
    """(table, records) of sets with these long fingerprints, the small points before the large ones of ``with_points``."""
    weights = [table_weights(n)[:, tables.start : tables.stop] for n in (SMALL_SEGMENTS, SEGMENTS)]
    is_small, is_large = with_points(size, similarity)
    bits = np.unpackbits(np.ascontiguousarray(words[:, :TABLE_WORDS]).view(np.uint8), axis=1, bitorder="little")
    counts = (bits[:, ::2] + bits[:, 1::2]).astype(np.float32)
    small, large = counts[is_small] @ weights[0] + 3**SEGMENTS, counts[is_large] @ weights[1]
    out = np.zeros(len(small) + len(large), RECORD)
    scale = np.log(np.concatenate([size[is_small], size[is_large]])) / np.log(1.01 / similarity)
    out["s"] = scale.astype(np.uint16)
    out["w"] = np.concatenate([words[is_small], words[is_large]])[:, TABLE_WORDS:]
    for k, t in enumerate(tables):
        out["p"] = np.concatenate([small[:, k], large[:, k]])
        yield t, out


def cell_links(found: np.ndarray, similarity: float, cell: int = CELL, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (first check words where none are given) of fingerprints that are near in a cell, and records of cells of over ``cell``.

    What is connected hangs on its least name: many cells of one group then have few different links.
    """
    order = np.lexsort((found["s"], found["p"]))
    found, names = found[order], (found["w"][:, 0] if names is None else names)[order]
    p, s, w = found["p"], found["s"].astype(np.int16), found["w"]
    cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
    many = np.diff(cuts)
    end, few = cuts[1:].repeat(many), (many <= 32).repeat(many)
    radius = np.where(p >= 3**SEGMENTS, bits_within(differing(similarity) + SMALL_MORE), bits_within(differing(similarity))).astype(np.int16)
    out, i = [(cuts[:0], cuts[:0])], np.flatnonzero(few)
    for lag in range(1, 32):  # small cells all at once; sizes ascend in a cell
        i = i[i + lag < end[i]]
        i = i[s[i + lag] <= s[i] + 1]
        near = i[apart(w[i], w[i + lag]) <= radius[i]]
        out.append((near, near + lag))
    large = (many > 32) & (many <= cell)
    for a, b in zip(cuts[:-1][large].tolist(), cuts[1:][large].tolist(), strict=True):
        i, j = forest(w[a:b], int(radius[a]), until=np.searchsorted(s[a:b], s[a:b] + 1, "right"))
        out.append((a + i, a + j))
    x, y = hung(names, *(np.concatenate(c) for c in zip(*out, strict=True)))
    return x, y, found[(many > max(cell, 32)).repeat(many)]


def hung(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least name of what index pairs connect to its other names."""
    name, at = np.unique(names[np.concatenate([i, j])], return_inverse=True)
    label = united(np.arange(len(name)), at[: len(i)], at[len(i) :])
    child = np.flatnonzero(label != np.arange(len(name)))
    return name[label[child]], name[child]


def _near(groups: DataFrame, similarity: float, cell: int) -> DataFrame:
    """(a, b): first check words of groups whose long fingerprints are near by Hamming distance and share a cell.

    What a chunk of groups has in a part of a table is one row. A group of copies has links in every table, up to one a table
    for each member, so ``FIRST_TABLES`` are met first and what they connect is one name in the others: all cells of all
    tables are compared, but the others give links between different names only. Cells of over ``cell`` records come out as
    they are and are dealt to blocks, of which every two meet.
    """
    spark, n = groups.sparkSession, common.partitions(groups.sparkSession)
    parts = max(PARTS, -(-groups.count() // 200_000))
    chunk = min(8192, 256 * parts)
    least = similarity / (1 - similarity) - 1e-9 if similarity < 1 else float("inf")  # a smaller set is similar to no other

    def spread(batches: Iterator[pa.RecordBatch], tables: range) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, chunk):
                size, prints, name = b.slice(k, chunk).columns
                size, words = size.to_numpy(zero_copy_only=False), np.frombuffer(b"".join(prints.to_pylist()), np.uint64).reshape(len(size), -1)
                who = np.concatenate(with_points(size, similarity))
                renamed = name.is_valid().to_numpy(zero_copy_only=False)[who]
                name = name.fill_null(0).to_numpy(zero_copy_only=False)[who]
                at, blobs, names = [], [], []
                for t, records in cells(words, size, similarity, tables):
                    part = (records["p"].astype(np.int64) * 40503 >> 8) % parts
                    order = np.argsort(part, kind="stable")
                    ends = np.searchsorted(part[order], np.arange(parts + 1))
                    held, new = records[order], renamed[order]
                    held["s"] |= RENAMED * new
                    beside, until = name[order][new], np.r_[0, np.cumsum(new)][ends]
                    some = np.flatnonzero(np.diff(ends))
                    at += (t * parts + some).tolist()
                    blobs += [held[ends[q] : ends[q + 1]].tobytes() for q in some]
                    names += [beside[until[q] : until[q + 1]].tobytes() for q in some]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary()), pa.array(names, pa.binary())], ["at", "records", "names"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            for at, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != last:
                    yield from near(last, held)
                    last, held = at, []
                held.append(blobs)
        yield from near(last, held)

    def near(at: int | None, blobs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        if blobs:
            records, beside = (b"".join(x) for x in zip(*blobs, strict=True))
            records = np.frombuffer(records, RECORD).copy()
            names, renamed = records["w"][:, 0].copy(), records["s"] >= RENAMED
            names[renamed] = np.frombuffer(beside, np.uint64)
            records["s"] &= ~RENAMED
            x, y, crowded = cell_links(records, similarity, cell, names)
            yield batch(x, y, None, None)
            for k in range(0, len(crowded), cell):
                r = crowded[k : k + cell]
                yield batch(r["w"][:, 0], r["w"][:, 1], at // parts * 65536 + r["p"].astype(np.int64), r["s"].astype(np.int32))

    def batch(a: np.ndarray, b: np.ndarray, p: np.ndarray | None, s: np.ndarray | None) -> pa.RecordBatch:
        rest = [pa.nulls(len(a), kind) if x is None else pa.array(x, kind) for x, kind in ((p, pa.int64()), (s, pa.int32()))]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)), *rest], ["a", "b", "p", "s"])

    def met_in(tables: range, named: DataFrame) -> DataFrame:
        rows = named.select("_size", "_print", "_name").mapInArrow(lambda batches: spread(batches, tables), "at int, records binary, names binary")
        dealt = rows.repartition(n, "at").sortWithinPartitions("at")
        return common.cut(dealt.mapInArrow(meet, "a long, b long, p long, s int").distinct())

    groups = groups.where(F.col("_size") >= least)
    first = met_in(range(FIRST_TABLES), groups.withColumn("_name", F.lit(None).cast("long")))
    joined_first = _forests(first.where("p is null").select("a", "b"))
    name = common.components(joined_first).select(F.col("node").alias("_near"), F.col("component").alias("_name"))
    others = met_in(range(FIRST_TABLES, TABLES), groups.join(name, "_near", "left"))
    links = joined_first.union(others.where("p is null").select("a", "b"))
    crowded = first.union(others).where("p is not null")
    blocks = crowded.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / cell).alias("m"))
    crowded = crowded.join(blocks, "p").withColumns({"mine": F.pmod(F.xxhash64("a", "b"), "m"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))})
    crowded = crowded.select("p", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "s", "a", "b")

    def blocks_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            new = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1
            cuts = [0, *new.tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                at = tuple(x[i] for x in c[:3])
                if at != last:
                    yield from joined(held)
                    last, held = at, []
                held.append([x[i:j] for x in c])
        yield from joined(held)

    def joined(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            p, x, y, mine, s, a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            o = np.argsort(s, kind="stable")
            share = differing(similarity) + SMALL_MORE * bool(p[0] % 65536 >= 3**SEGMENTS)
            i, j = forest(np.stack([a, b], 1).view(np.uint64)[o], bits_within(share), mine[o] if x[0] != y[0] else None, np.searchsorted(s[o], s[o] + 1, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in hung(a, o[i], o[j])], ["a", "b"])

    if crowded.isEmpty():
        return _forests(links)
    met = crowded.repartition(n, "p", "x", "y").sortWithinPartitions("p", "x", "y").mapInArrow(blocks_meet, "a long, b long")
    return _forests(links.union(common.cut(met.distinct())))


def _forests(links: DataFrame) -> DataFrame:
    """As many of the links (a, b) as join the same: a forest of each ``FOREST`` of them, so that a group of n has few times n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
        if held:
            names, n = np.concatenate(held, axis=1), sum(x.shape[1] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in hung(names.ravel(), np.arange(n), np.arange(n, 2 * n))], ["a", "b"])

    return common.cut(links.coalesce(-(-links.count() // FOREST) or 1).mapInArrow(run, "a long, b long"))


def similar_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, block: int = SETS_BLOCK, cell: int = CELL) -> DataFrame:
    """(key, component_id) of every row: texts whose sets of word shingles have a Jaccard similarity of ``similarity`` at least.

    The bits of two fingerprints differ with a probability that follows from the similarity, 0.1515 at 0.8, which is more
    than the exact grid of 64 bits allows. So each set has a SimHash of 18 words, and the popcounts of nine 2-bit segments
    are its point in each of ``TABLES`` tables, 9e-5 of the pairs at 0.8 sharing none, whatever the number of rows. Sets of
    up to ``SMALL_SET`` shingles, whose bits differ by up to 0.1875, have points of six segments. Those that share a point
    and are within the radius of ``bits_within`` in two words of their own are near, and every link is decided on the two
    whole sets among what is connected by nearness. Equal sets are one set throughout. The sets of such a group are first
    compared with two of them; where that leaves several components, all sets of the group meet in blocks of ``block``, and
    what comes out is a link for each two components that join, not the pairs.
    Nulls, empty texts, repeated rows and empty tables are as in ``near_duplicates``.
    """
    prints, groups, links = _similar(docs, key, text, words, similarity, block, cell)
    return _named(prints, groups, links, key, [])


def _similar(docs: DataFrame, key: str, text: str, words: int, similarity: float, block: int = SETS_BLOCK, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prints of all rows, one group for each print with its first row (least key, then md5), and links of groups."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity above 0, up to 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingle_set(t.as_py(), words) for t in b.column(1))
            got = [(set_id(h), len(h), long_print(h) if len(h) else none) for h in sets]
            fp, size, long = (list(c) for c in zip(*got, strict=True)) if got else ([], [], [])
            near, long = pa.array([int(x[TABLE_WORDS].view(np.int64)) for x in long], pa.int64()), pa.array([x.tobytes() for x in long], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), near, long], ["_k", "_md5", "_fp", "_size", "_near", "_print"])

    none = np.zeros(len(SALTS), np.uint64)
    kind = docs.schema[key].dataType.simpleString()
    md5 = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    prints = common.cut(docs.select(key, text, md5).mapInArrow(run, f"_k {kind}, _md5 string, _fp long, _size int, _near long, _print binary"))
    first = F.min(F.struct(F.col("_k").isNull().alias("none"), "_k", "_md5"))
    of_set = [F.first(c).alias(c) for c in ("_size", "_near", "_print")]
    groups = common.cut(prints.groupBy("_fp").agg(F.min("_k").alias("_rep"), F.count(F.lit(1)).alias("_m"), first.alias("_first"), *of_set))

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9

    def centres(p: np.ndarray, ids: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
        many = np.diff(cuts)
        out = []
        for order in (ids, (ids.view(np.uint64) * SALTS[0]).view(np.int64)):  # two members of each point to compare with
            at = np.lexsort((order, p))[cuts[:-1]].repeat(many)
            out.append(np.where(fits(size, size[at]), ids[at], ids))
        more = many.repeat(many) > 1
        yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (p, ids, size, *out)], ["p", "id", "size", "n0", "n1"])

    near = common.components(_near(groups, similarity, cell))
    points = groups.where("_size > 0").join(near, groups["_near"] == near["node"], "left")
    points = points.select(F.coalesce("component", "_near").alias("p"), F.col("_fp").alias("id"), F.col("_size").alias("size"))
    n = common.partitions(docs.sparkSession)
    dealt = points.repartition(n, "p").sortWithinPartitions("p")
    points = common.cut(dealt.mapInArrow(lambda batches: (r for g in _by_point(batches) for r in centres(*g)), "p long, id long, size int, n0 long, n1 long"))
    star = points.select("id", F.explode(F.array("n0", "n1")).alias("n")).where("id <> n").select(F.greatest("id", "n").alias("a"), F.least("id", "n").alias("b"))
    star = common.cut(star.distinct())
    texts = _texts(points, docs, groups, key, text)
    found = _alike(star, texts, words, similarity)
    named = _grouped(groups, found).select(F.col("_fp").alias("id"), "_c")
    points = points.select("p", "id", "size").join(named, "id")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    mixed = points.groupBy("p").agg(F.min("_c").alias("x"), F.max("_c").alias("y"), blocks.alias("m"))
    across = points.join(mixed.where("x <> y").select("p", "m"), "p").join(texts.toDF("id", "t"), "id")
    across = across.withColumns({"mine": F.pmod(F.xxhash64("id"), "m"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))})
    across = across.select("p", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "_c", "id", "t")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, rows = None, []
        for b in batches:
            numbers = zip(*(c.to_pylist() for c in b.columns[:6]), strict=True)
            for (p, x, y, *row), t in zip(numbers, b.column(6), strict=True):
                if point != (p, x, y):
                    yield from links(rows)
                    point, rows = (p, x, y), []
                rows.append((*row, shingle_set(t.as_py(), words)))
        yield from links(rows)

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len({r[1] for r in rows}) > 1:
            mine, c, ids, sets = zip(*rows, strict=True)
            i, j = join_sets(sets, np.array(c), similarity, np.array(mine))
            ids = np.array(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], ["a", "b"])

    rest = across.repartition(n, "p", "x", "y").sortWithinPartitions("p", "x", "y").mapInArrow(meet, "a long, b long")
    return prints, groups, found.union(common.cut(rest))


def join_sets(sets: tuple[np.ndarray, ...], label: np.ndarray, similarity: float, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets of the similarity that join what has unlike labels, no more than labels; with two sides, only across them."""
    n, size = len(sets), np.array([len(x) for x in sets], float)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), size.astype(int)), many > 1  # what one set has alone is in no intersection
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    same = np.zeros((n, n))
    width = max(1, min(int(shared.sum()), (1 << 22) // n))
    for s in range(0, int(shared.sum()), width):
        at = slice(*np.searchsorted(column, [s, s + width]))
        has = np.zeros((n, width), np.float32)
        has[row[at], column[at] - s] = 1
        same += has @ has.T
    near = same >= similarity * (size[:, None] + size[None] - same) - 1e-9
    if len(np.unique(side)) > 1:
        near &= side[:, None] != side[None]
    i, j = np.nonzero(np.triu(near, 1))
    label = np.unique(label, return_inverse=True)[1]
    out = [(i[:0], i[:0])]
    while True:
        unlike = label[i] != label[j]
        i, j = i[unlike], j[unlike]
        if not len(i):
            return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        top, first = np.unique(np.maximum(label[i], label[j]), return_index=True)  # each hangs on a smaller one: no circles
        to = np.arange(label.max() + 1)
        to[top] = np.minimum(label[i[first]], label[j[first]])
        while (to[to] != to).any():
            to = to[to]
        out.append((i[first], j[first]))
        label = to[label]


def _by_point(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut so that its equal values stay together."""
    held = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            now = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)]
        at = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        held = [c[at:] for c in now]
        if at:
            yield [c[:at] for c in now]
    if held is not None and len(held[0]):
        yield held


def _texts(points: DataFrame, docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """(_fp, _t) of the groups on points: a text of each, that of its first row."""
    asked = groups.join(points.select(F.col("id").alias("_fp")).distinct(), "_fp")
    asked = common.cut(asked.select("_fp", common.group_key("_first._k").alias("_id"), F.col("_first._md5").alias("_md5")))
    rows = docs.select(common.group_key(key).alias("_id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_md5"), F.col(text).alias("_t"))
    return common.cut(rows.join(common.small(asked, asked.count()), ["_id", "_md5"]).dropDuplicates(["_id", "_md5"]).select("_fp", "_t"))


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of groups whose whole sets of shingles reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            for i, s, t in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if i != last:  # pairs come sorted by a where the join sorts them
                    last, x = i, shingle_set(s.as_py(), words)
                both = np.concatenate([x, shingle_set(t.as_py(), words)])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(same >= similarity * (len(both) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if pairs.isEmpty():
        return pairs
    met = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a")
    return common.cut(met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def _grouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups with _c, the component of their fingerprint."""
    component = common.components(links)
    return groups.join(component, groups["_fp"] == component["node"], "left").withColumn("_c", F.coalesce("component", "_fp"))


def _named(prints: DataFrame, groups: DataFrame, links: DataFrame, key: str, more: list) -> DataFrame:
    """The prints' rows with the smallest key of their component. Keys may be missing, so components are over the prints."""
    named = _grouped(groups, links)
    least = named.groupBy("_c").agg(F.min("_rep").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    total = groups.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("g")).first()
    least = common.join_hot(named.select("_fp", "_m", "_c"), least, ["_c"], "_n", total["g"])
    return common.join_hot(prints, least.select("_fp", "_m", "component_id"), ["_fp"], "_m", total["n"]).select(F.col("_k").alias(key), *more, "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component of similar texts, with all columns of docs.

    The row with the least key stays, then the least by the text's md5, of rows alike in both any one; a row with a null
    key stays only where its component has no other key. Rows that share a key but not a component are kept apart. Texts
    without a word are one component; texts of any length are taken whole. Columns may have any names. An empty table
    gives an empty result.
    """
    columns = docs.columns
    docs, own = common.shielded(docs)
    key, text = own[key], own[text]
    _, groups, links = _similar(docs, key, text, words, similarity)
    kept = _grouped(groups, links).groupBy("_c").agg(F.min("_first").alias("_f")).select(F.col("_f._k").alias("_k"), F.col("_f._md5").alias("_md5"))
    kept = kept.select(common.group_key("_k").alias("_id"), "_md5")
    row = {"_id": common.group_key(key), "_md5": F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))}
    out = docs.withColumns(row).join(kept, ["_id", "_md5"], "left_semi")
    first = W.partitionBy("_id", "_md5").orderBy("_id", "_md5")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*[F.col(own[c]).alias(c) for c in columns])
