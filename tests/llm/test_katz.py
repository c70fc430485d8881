"""LM scoring against Katz backoff with dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import katz


def brute(rows, folds=5, held=1):
    words = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").replace("\x0b", " ").translate({9: 32, 10: 32, 12: 32, 13: 32}).split(" ") if w] + [None]
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % folds == held
    grams = lambda w: list(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    uni, bi, tri = Counter(), Counter(), Counter()
    for k, t in rows:
        if not out(k):
            w = words(t)
            uni.update(w)
            bi.update(g[1:] for g in grams(w))
            tri.update(grams(w))
    n, v = sum(uni.values()), len(uni)
    d = lambda c: katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)])
    d1, d2, d3 = d(uni), d(bi), d(tri)
    less = lambda c, by: c * (by[c] if c <= katz.CUT else katz.BIG)
    used = sum(less(c, d1) for c in uni.values())
    p1 = lambda w: less(uni[w], d1) / n if uni[w] else 1 - used / n if n else 1.0
    after = defaultdict(dict)
    for g, c in [*bi.items(), *tri.items()]:
        after[g[:-1]][g[-1]] = c

    def p(context, w):
        by, shorter = (d3, lambda x: p(context[1:], x)) if len(context) == 2 else (d2, p1)
        mine = after.get(context)
        if not mine:
            return shorter(w)
        whole = sum(mine.values())
        if w in mine:
            return less(mine[w], by) / whole
        return (1 - sum(less(c, by) for c in mine.values()) / whole) / (1 - sum(shorter(x) for x in mine)) * shorter(w)

    for context in list(after)[:40]:  # normalised over the known words and the unknown one
        assert sum(p(context, w) for w in [*uni, "never seen"]) == pytest.approx(1)
    res = []
    for k, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        res.append((k, out(k), len(w), sum(x in uni for x in w), n, base, sum(math.log10(p(g[:2], g[2])) for g in grams(w))))
    return res


def check(spark, rows, hot=katz.HOT, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in katz.score(docs, hot=hot, **options).collect()), key=str)
    want = sorted(brute([r[:2] for r in rows]), key=str)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1:5], round(r[5], 6), round(r[6], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(r.choices(vocab, [1 / (i + 1) for i in range(60)], k=r.randint(1, 40)))
    return [(i, text() + (" ÀB Q" if i % 7 == 0 else ""), None) for i in range(120)] + [(200, None, "x"), (201, "", None), (202, "the " * 3000, None), (None, "the end", None), (3, "w1 w2", None), (3, "w1 w2", None), (11, "Unknown\tW0\nw0\x1fq", None)]


def test_brute_force(spark, rows):
    check(spark, rows)


def test_many_chunks_buckets_and_dealt_words(spark, rows):
    check(spark, rows, chunk_tokens=300, bucket_bytes=2000, hot=60)


def test_small_corpora(spark):
    check(spark, [(1, "a", None)])
    check(spark, [(1, "a a a a a a a a", None), (2, "a a a a a a a a a", None)])
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert row.held_out and (row.n_known, row.train_tokens) == (0, 0) and row.score == row.base_score == 0
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables(spark, rows, tmp_path):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    katz.score(docs, keep_tables=f"{tmp_path}/t", bucket_bytes=2000)
    t = spark.read.parquet(f"{tmp_path}/t")
    total = katz.score(docs).first().train_tokens
    assert t.selectExpr("sum(count)").first()[0] == total and t.groupBy("u", "v", "w").count().where("count > 1").count() == 0
    pairs = t.groupBy("v", "w").agg({"count": "sum", "count_vw": "max"})
    assert pairs.where("`sum(count)` <> `max(count_vw)`").count() == 0


def test_rows_that_come_from_a_shuffle_are_written_once(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert katz.is_scan(docs.select("doc_id", "text").where("text is null or text <> 'q'")) and not katz.is_scan(docs.repartition(3))
    assert katz.score(docs.repartition(3)).count() == len(rows)
    with pytest.raises(ValueError):
        katz.score(docs, key="score")
