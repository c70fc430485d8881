"""The corpus operators against brute force on small tables, with nulls, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import ann, bpe, common, embdedup, mixing, sharding, simhash, toxicity, urlfilter
from quarry.llm.queries import vocabulary_file

DOCS = "doc_id long, text string, source string, slot string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 60))), r.choice(["a", "a", "a", "b", None, "c"]), "x") for i in range(300)]
    rows += [(300 + i, rows[i][1], "a", None) for i in range(40)]
    rows += [(400 + i, rows[i][1].replace("a", "A", 1) + " tail", "b", None) for i in range(40)]
    rows += [(500, None, None, None), (501, "", "a", "y"), (502, "long word " * 20_000, "a", "y"), (None, "no key here", "a", "y"), (7, rows[7][1], "a", "y"), (7, rows[7][1], "a", "y")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_mixing(spark, docs):
    weights = {"a": 5.0, "b": 2.0, "c": 2.0, None: 1.0}
    got = mixing.mix(table(spark, docs), weights, block_rows=4, resolution=10).orderBy("slot", "offset").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(str, (d[:3] for d in docs)))
    slots = {r.slot: r.source for r in got}
    assert sorted(slots) == list(range(len(slots)))
    share = {s: w / 10 for s, w in weights.items()}
    left = {s: sum(d[2] == s for d in docs) for s in share}
    seen = dict.fromkeys(share, 0)
    for t in range(1, len(slots) + 1):  # while every source has rows, each is less than a block from its share
        seen[slots[t - 1]] += 1
        if all(seen[s] * 4 < left[s] for s in share):
            assert all(abs(seen[s] - t * share[s]) < 1 for s in share)
    assert mixing.mix(table(spark, [])).count() == 0
    assert mixing.in_order(table(spark, docs)).columns == ["doc_id", "text", "source", "slot"]
    clashing = table(spark, docs).selectExpr("*", "1 as _k", "2 as _g", "3 as _slot", "4 as block", "5 as _p")
    out = mixing.in_order(clashing, place=("slot", "_p"))
    assert out.columns == ["doc_id", "text", "source", "_k", "_g", "_slot", "block", "slot", "_p"] and {(r._k, r._g, r._slot, r.block) for r in out.collect()} == {(1, 2, 3, 4)}
    with pytest.raises(ValueError):
        mixing.integer_weights({str(i): 1.0 for i in range(11)}, 10)
    with pytest.raises(ValueError):
        mixing.mix(table(spark, docs), max_sources=2)


def test_mixing_query_plan_is_native(spark, docs):
    plan = mixing.mix(table(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_sharding(spark, docs):
    got = sharding.shard(table(spark, docs), 7).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and sorted(by) == list(range(7))
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
        for s in ("a", "b", "c", None):  # each shard holds its share of each source
            assert abs(sum(r.source == s for r in v) - sum(d[2] == s for d in docs) / 7) <= 2
    assert sharding.shard(table(spark, []), 7).count() == 0
    clashing = sharding.shard(table(spark, docs).selectExpr("*", "1 as _k", "2 as _n", "3 as _q"), 7)
    assert {(r._k, r._n, r._q) for r in clashing.collect()} == {(1, 2, 3)}
    # by brute force: fractional ranks of rows shuffled within their source, cut into equal shards
    ranks = {}
    for d in sorted(docs, key=lambda d: (hashlib.md5(f"42:{'null' if d[0] is None else d[0]}".encode()).hexdigest(), -1 if d[0] is None else d[0], hashlib.md5((d[1] or "").encode()).hexdigest())):
        ranks.setdefault(d[2], []).append(d)
    order = sorted(((2 * r - 1) / (2 * len(v)), "0" if s is None else f"={s}", r, str(d[:3])) for s, v in ranks.items() for r, d in enumerate(v, 1))
    want = {(str(x[3]), i * 7 // len(order)) for i, x in enumerate(order)}
    assert {(str((r.doc_id, r.text, r.source)), r.shard) for r in got} == want
    assert {r.shard for r in sharding.shard(table(spark, docs[:3]), 7).collect()} <= set(range(7))


def brute_print(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        new = label[:]
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new
    return label


def test_components_with_hubs(spark):
    r = random.Random(9)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(12)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(59, 100), (3, 3), (None, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    index = sorted({x for e in edges for x in e if x is not None})
    label = components(len(index), [(index.index(a), index.index(b)) for a, b in edges if a is not None])
    want = {(index[i], index[c]) for i, c in enumerate(label) if i != c}
    for hub in (5, 10**9):
        got = {tuple(x) for x in common.components(df, hub=hub).collect()}
        assert {g for g in got if g[0] != g[1]} == want


def test_hot_keys_join_alike(spark):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(100)] + [(None, 1)], "k long, i long")
    unique = rows.groupBy("k").count().where("k is not null")
    a, b = (common.join_hot(rows, unique, ["k"], "count", 101, most=m) for m in (10, 1000))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.columns == b.columns


def check_simhash(spark, docs, **options):
    fp = [brute_print(d[1]) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4]
    label = components(len(docs), links)
    least = {}
    for d, c in zip(docs, label):
        least[c] = min([x for x in (least.get(c), d[0]) if x is not None], default=None)
    want = sorted(str((d[0], f"{f:016x}", least[c])) for d, f, c in zip(docs, fp, label))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(table(spark, docs), **options).collect()) == want


def test_simhash_brute_force(spark, docs):
    check_simhash(spark, docs)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_crowded_points(spark, docs):
    check_simhash(spark, docs, block=3)


def test_grid_meets_all_pairs_within_radius():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 200, dtype=np.int64)
    flips = [sum(1 << int(b) for b in r.choice(63, k, replace=False)) for k in r.integers(0, 6, 200)]
    b = a ^ np.array(flips, np.int64)
    (ia, pa), (ib, pb) = simhash.grid_points(a), simhash.grid_points(b)
    for i in range(200):
        assert set(pa[ia == i]) & set(pb[ib == i])


def test_similar_texts(spark):
    r = random.Random(1)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w), "a", None) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        v = list(w)
        v[50] = v[150] = "changed"
        rows.append((100 + i, " ".join(v), "b", None))
    got = simhash.keep_one(table(spark, [*rows, rows[3], (None, "alone and without a key", "a", None), (900, None, "a", None), (901, "", "a", None)])).collect()
    ids = sorted((x.doc_id for x in got), key=str)
    assert len([x for x in ids if x is not None and x < 100]) == 30
    assert len([x for x in ids if x is not None and 100 <= x < 200]) <= 2 and None in ids and 900 in ids and 901 not in ids


def test_similar_texts_are_decided_by_whole_sets(spark):
    r = random.Random(2)
    rows = []
    for _ in range(60):  # chains of texts with more and more words changed, on both sides of the similarity
        w = [f"w{r.randint(0, 9999)}" for _ in range(r.randint(20, 120))]
        for _ in range(6):
            rows.append((len(rows), " ".join(w), "a", None))
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = f"w{r.randint(0, 9999)}"
    sets = [{tuple(d[1].split()[i : i + 5]) for i in range(len(d[1].split()) - 4)} for d in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if i // 6 == j // 6 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = list(enumerate(components(len(rows), links)))
    assert 60 < len({c for _, c in want}) < len(rows)
    assert sorted(map(tuple, simhash.similar_texts(table(spark, rows)).collect())) == want
    assert simhash.similar_texts(table(spark, [])).count() == 0


def test_one_large_group_of_texts_on_both_sides_of_the_similarity(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(None, None, "a", None)]
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(150)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "a", None))
    sets = [{tuple(d[1].split()[i : i + 5]) for i in range(len(d[1].split()) - 4)} for d in rows[1:]]
    links = [(i, j) for i in range(150) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = [*enumerate(components(150, links)), (None, None)]
    assert 20 < len({c for _, c in want}) < 140
    for block in (1024, 20):
        assert sorted(map(tuple, simhash.similar_texts(table(spark, rows), block=block).collect()), key=str) == sorted(want, key=str)


def test_long_print_is_a_majority_of_bits():
    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2**64
        return x ^ x >> 31

    r = np.random.default_rng(3)
    for n in (1, 2, 4, 7, 255, 256, 700):
        h = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        for salt, word in zip(simhash.SALTS.tolist(), simhash.long_print(h).tolist()):
            own = [mixed((x + salt) % 2**64) for x in h.tolist()]
            assert word == sum((2 * sum(x >> k & 1 for x in own) + (own[0] >> k & 1) > len(own)) << k for k in range(64))


@pytest.mark.parametrize("shared, left, right", [(4, 0, 1), (8, 1, 1), (16, 0, 4), (17, 1, 3), (18, 2, 2), (320, 40, 40), (320, 0, 80)])
def test_sets_at_the_similarity_meet_in_a_cell(shared, left, right):
    r = np.random.default_rng(shared + left)
    prints, sizes = [], []
    for _ in range(60):
        x = r.integers(0, 2**64, shared + left + right, dtype=np.uint64)
        for h in (np.unique(x[: shared + left]), np.unique(np.r_[x[:shared], x[shared + left :]])):
            prints.append(simhash.long_print(h))
            sizes.append(len(h))
    words = np.stack(prints)
    share = np.bitwise_count(words[::2] ^ words[1::2]).sum() / (60 * 64 * words.shape[1])
    assert 0.1 < share < simhash.differing(0.8) + simhash.SMALL_MORE * (shared <= 16) + 0.01
    found = set()
    for _, records in simhash.cells(words, np.array(sizes), 0.8):
        a, b, crowded = simhash.cell_links(records, 0.8)
        found |= {frozenset(x) for x in zip(a.tolist(), b.tolist())}
        assert not len(crowded)
    near = words[:, simhash.TABLE_WORDS].tolist()
    assert sum(frozenset(near[i : i + 2]) in found for i in range(0, 120, 2)) >= 59 and len(found) < 70


def test_points_are_popcounts_of_segments():
    r = np.random.default_rng(7)
    words = r.integers(0, 2**64, (50, len(simhash.SALTS)), dtype=np.uint64)
    sizes = np.array([5, 18, 300, 20, 21] * 10)
    for t, records in simhash.cells(words, sizes, 0.8):
        if t % 50 == 0:
            want = []
            for segments, rows in ((6, sizes <= 20), (9, sizes > 16)):
                weights = simhash.table_weights(segments)[:, t].astype(int).tolist()
                assert sum(w > 0 for w in weights) == segments
                for w in words[rows, : simhash.TABLE_WORDS]:
                    bits = [x >> k & 1 for x in w.tolist() for k in range(64)]
                    want.append(sum(x * (bits[2 * k] + bits[2 * k + 1]) for k, x in enumerate(weights) if x) + 3**9 * (segments == 6))
            assert records["p"].tolist() == want


@pytest.mark.parametrize("cell", [simhash.CELL, 40])
def test_cell_links_brute_force(cell):
    r = np.random.default_rng(11)
    records = np.zeros(400, simhash.RECORD)
    records["p"] = r.choice([1, 2, 3, 4, 3**9 + 5], 400, p=[0.5, 0.3, 0.05, 0.05, 0.1])
    records["s"] = r.integers(8, 10, 400)
    base = r.integers(0, 2**64, (40, 2), dtype=np.uint64)
    flips = np.packbits(r.random((400, 128)) < 0.14, axis=1).view(np.uint64)
    records["w"] = base[r.integers(0, 40, 400)] ^ flips
    a, b, crowded = simhash.cell_links(records, 0.8, cell)
    per = {p: int((records["p"] == p).sum()) for p in set(records["p"].tolist())}
    left = {p for p, n in per.items() if n > cell}
    assert bool(left) == (cell == 40) and sorted(set(crowded["p"].tolist())) == sorted(left) and len(crowded) == sum(per[p] for p in left)
    near = lambda i, j: np.bitwise_count(records["w"][i] ^ records["w"][j]).sum() <= simhash.bits_within(simhash.differing(0.8) + simhash.SMALL_MORE * (records["p"][i] > 3**9))
    links = [(i, j) for i in range(400) for j in range(i) if records["p"][i] == records["p"][j] and records["p"][i] not in left and near(i, j)]
    at = {w: i for i, w in enumerate(records["w"][:, 0].tolist())}
    assert len(at) == 400 and components(400, [(at[x], at[y]) for x, y in zip(a.tolist(), b.tolist())]) == components(400, links)


def test_crowded_cells_are_dealt_to_blocks(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(150)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "a", None))
    sets = [simhash.shingle_set(x[1], 5) for x in rows]
    words, sizes = np.stack([simhash.long_print(x) for x in sets]), np.array([len(x) for x in sets])
    assert any(len(simhash.cell_links(records, 0.8, 33)[2]) for _, records in simhash.cells(words, sizes, 0.8))
    links = [(i, j) for i in range(150) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    assert sorted(map(tuple, simhash.similar_texts(table(spark, rows), cell=20).collect())) == list(enumerate(components(150, links)))


def test_large_groups_give_few_links(spark, monkeypatch):
    r = random.Random(14)
    rows = []
    for g, words in enumerate([22] * 60 + [150]):  # many small groups and a large one, of texts on both sides of the similarity
        base = [f"w{g}_{i}" for i in range(words)]
        for _ in range(6 if words == 22 else 300):
            w = list(base)
            for _ in range(r.randint(0, 1 if words == 22 else 4)):
                w[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "a", None))
    groups = simhash._similar(table(spark, rows), "doc_id", "text", 5, 0.8)[1]
    sets = groups.where("_size >= 4").select("_size", "_print", "_near").collect()
    words, at = np.stack([np.frombuffer(x._print, np.uint64) for x in sets]), {x._near: i for i, x in enumerate(sets)}
    by_table = [simhash.cell_links(records, 0.8)[:2] for _, records in simhash.cells(words, np.array([x._size for x in sets]), 0.8)]
    links = [(at[x], at[y]) for a, b in by_table for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())]
    cut, made = simhash.common.cut, []

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b", "p", "s"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash.common, "cut", counted)
    for cell in (simhash.CELL, 20):
        made.clear()
        got = [(at[x.a], at[x.b]) for x in simhash._near(groups, 0.8, cell).collect()]
        assert components(len(sets), got) == components(len(sets), links)
        assert cell == 20 or sum(made) < 8 * len(sets) < len(links) / 4


def test_forests_join_the_same(spark, monkeypatch):
    r = random.Random(13)
    edges = [(r.randint(0, 30), r.randint(0, 30)) for _ in range(300)] + [(100 + r.randint(0, 40), 100 + r.randint(0, 40)) for _ in range(25)]
    label = components(150, edges)
    for size, most in ((10**6, 75), (100, 300)):
        monkeypatch.setattr(simhash, "FOREST", size)
        got = [tuple(x) for x in simhash._forests(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()]
        assert components(150, got) == label and len(got) < most
    assert simhash._forests(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_the_stage_come_from_fingerprints(spark, monkeypatch):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a", None), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1", "a", None)]
    assert [x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()] == [1]
    monkeypatch.setattr(simhash, "_near", lambda groups, *_: groups.select(groups["_near"].alias("a"), groups["_near"].alias("b")).limit(0))
    assert sorted(x.doc_id for x in simhash.keep_one(table(spark, rows)).collect()) == [1, 2]


@pytest.mark.parametrize("two_sides", [False, True])
def test_join_sets(two_sides):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 12, r.integers(1, 12)).astype(np.uint64)) for _ in range(60)]
    label, side = r.integers(0, 40, 60) * 7, r.integers(0, 1 + two_sides, 60)
    alike = lambda i, j: len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]}) and (not two_sides or side[i] != side[j])
    same = [(i, j) for i in range(60) for j in range(i) if label[i] == label[j]]
    i, j = simhash.join_sets(tuple(sets), label, 0.8, side)
    assert len(i) and all(alike(*x) for x in zip(i, j)) and len(i) < len(set(label))
    links = [(i, j) for i in range(60) for j in range(i) if alike(i, j)]
    assert components(60, [*same, *zip(i.tolist(), j.tolist())]) == components(60, [*same, *links])


def test_keep_one_keeps_a_row_of_each_component(spark):
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    lone = [words(40) for _ in range(4)]
    rows = [(None, lone[0], "a", None), (None, lone[1], "a", None), (None, lone[2], "a", None), (None, lone[2], "b", None)]  # different texts without a key
    rows += [(7, lone[3], "a", None), (7, words(40), "a", None), (5, words(40), "a", None)]  # different texts of one key
    rows += [(9, rows[6][1], "b", None), (5, rows[4][1], "b", None), (None, rows[5][1], "c", None)]  # and copies of them
    got = sorted(((x.doc_id, x.text) for x in simhash.keep_one(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, lone[0]), (None, lone[1]), (None, lone[2]), (5, lone[3]), (7, rows[5][1]), (5, rows[6][1])], key=str)


def test_embedding_dedup_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + r.normal(scale=0.08, size=8) * (i >= 40)).tolist(), int(i % 40) % 3) for i in range(200)]
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] * 8, 1), (404, rows[0][1], None), (405, [1.0], 0), (406, [], 0), (None, rows[0][1], 0), (0, rows[0][1], rows[0][2])]
    schema = "vec_id long, embedding array<double>, label int"
    ok = [x for x in rows if x[0] is not None and x[2] is not None and x[1] and None not in x[1] and np.isfinite(x[1]).all() and any(x[1])]
    n, links = dict.fromkeys(range(len(ok)), 0), []
    for i, (_, v, a) in enumerate(ok):
        for j, (_, w, b) in enumerate(ok):
            if i != j and a == b and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                n[i] += 1
                links.append((i, j))
    label = components(len(ok), links)
    least = {c: min(ok[i][0] for i in range(len(ok)) if label[i] == c) for c in set(label)}
    want = [(x[0], n[i], least[label[i]], x[0] == least[label[i]]) for i, x in enumerate(ok)]
    want += [(x[0], 0, x[0], x[0] is not None) for x in rows if all(x is not o for o in ok)]
    for chunk in (2048, 4):
        got = embdedup.near_duplicates(spark.createDataFrame(rows, schema), chunk=chunk).collect()
        assert sorted(str(tuple(g)) for g in got) == sorted(map(str, want))
    assert embdedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_embedding_dedup_refuses_too_many_lengths(spark):
    rows = spark.range(1, 1002).selectExpr("id as vec_id", "array_repeat(1d, int(id)) as embedding", "0 as label")
    with pytest.raises(ValueError, match="lengths"):
        embdedup.near_duplicates(rows)


def brute_nearest(rows, asked, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and any(v) and np.isfinite(v).all()]
    out = {}
    for q, v in {(q, tuple(v)) for q, v in asked if q is not None and v and None not in v and any(v) and np.isfinite(v).all()}:
        best = sorted((-float((w * np.array(v)).sum()), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out[q] = [i for _, i in best]
    return out


def test_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 64)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 64), (602, [float("inf")] * 64), (None, x[0].tolist()), (603, x[1].tolist()), (603, x[1].tolist()), (604, [1.0]), (620, [2.0]), (640, [3.0] + [None] * 63), (100, x[100].tolist())]
    rows += [(700 + i, x[3].tolist()) for i in range(30)]  # ties
    df = spark.createDataFrame([(*x, "mine") for x in rows], "vec_id long, embedding array<double>, score string")
    asked = df.where("vec_id % 20 = 0")
    seen = []
    for block in (8192, 100):
        got = ann.search(df, asked, k=20, rows_block=block, queries_block=block).collect()
        by = {}
        for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
            by.setdefault(g.query_id, []).append(g)
        want = brute_nearest(rows, [x for x in rows if x[0] is not None and x[0] % 20 == 0], 20)
        assert by.keys() == {q for q, v in want.items() if v} and [g.vec_id for g in by[620]] == [604]
        hit = 0
        for q, mine in by.items():
            assert [g["rank"] for g in mine] == list(range(1, len(want[q]) + 1)) and all(g.vec_id != q for g in mine)
            vectors = dict(x for x in rows if x[0] is not None)
            assert all(g.score == pytest.approx(float(np.dot(vectors[g.vec_id], vectors[q]))) for g in mine)
            assert [(-g.score, g.vec_id) for g in mine] == sorted((-g.score, g.vec_id) for g in mine)
            hit += len(set(want[q]) & {g.vec_id for g in mine})
        assert hit >= 0.9 * sum(len({*w}) for w in want.values())
        seen.append(sorted(map(tuple, got)))
    assert seen[0] == seen[1]  # blocks are no part of the result
    assert ann.search(df.limit(0), asked, k=5).count() == 0 and ann.search(df, asked.limit(0), k=5).count() == 0
    assert {len([g for g in ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5).collect()])} == {2}


def test_the_index_finds_every_code_within_the_radius():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 64))
    x[1000:1100] = x[5]
    model = ann.Model(x[:1000], 3000, 20, 0.95)
    code = model.codes(x)
    index = ann.Index(code)
    for radius in (0, 20, model.radius):
        for q in code[:20]:
            at, probed = index.within(q, radius)
            assert at.tolist() == np.flatnonzero(np.bitwise_count(code ^ q).sum(axis=1) <= radius).tolist() and probed >= len(at)


def test_url_rules(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "x.org/", None, "http://com/fr/", "ftp://b.com/de/#f", "http://notcom/de/", "http://h.org", "http://example.org/es", "://", "http://q.com/fr/", "http://q.com/fr/"]
    pages = spark.createDataFrame([(i, u, "mine", "b") for i, u in enumerate(urls)], "page_id long, url string, rule string, _best string")
    rules = spark.createDataFrame(list(urlfilter.RULES), "action string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest.replace("?", "/").replace("#", "/").split("/")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, a) for a, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")
    assert urlfilter.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(500).selectExpr("concat('site', id, '.net/') as _key", "'block' as action")
    rules = listed.selectExpr("action", "substr(_key, 1, length(_key) - 1) as host", "'/' as path")
    pages = spark.range(1000).selectExpr("id as page_id", "concat('http://www.site', id, '.net/a') as url")
    assert urlfilter.judge(pages, rules).where("verdict = 'block'").count() == 500


def test_toxicity(spark):
    r = random.Random(4)
    calm = lambda: " ".join(r.choice(["river", "stone", "green", "table", "sun", "walk", "quiet"]) + str(r.randint(0, 99)) for _ in range(30))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = calm().split()
        if bad:
            words.insert(r.randint(0, 29), r.choice(["wretchling", "vilethug"]))
        rows.append((i, " ".join(words), "s", None))
        labels.append((i, int(bad)))
    rows += [(900, "you WR3TCHLING go", "s", None), (901, "vіlethug now", "s", None), (902, None, "s", None), (903, "", "s", None), (904, "calm " * 50_000, "s", None), (None, "stone vilethug", "s", None), (900, "you WR3TCHLING go", "s", None)]
    lab = spark.createDataFrame(labels + [(None, 1), (905, None)], "doc_id long, toxic int")
    got = toxicity.score(table(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    by = {g.doc_id: g for g in got}
    assert all(by[i].predicted == y for i, y in labels)
    assert [by[i].predicted for i in (900, 901, 902, 903, 904, None)] == [1, 1, 0, 0, 0, 1]
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    clashing = table(spark, rows).selectExpr("doc_id", "text", "7.0D as score", "'x' as predicted", "'y' as held_out", "1 as _hit", "doc_id as _k")
    kept = toxicity.clean(clashing, lab)
    assert kept.columns == clashing.columns and {tuple(r)[2:6] for r in kept.collect()} == {(7.0, "x", "y", 1)}
    with pytest.raises(ValueError):
        toxicity.score(clashing, lab, keep=["score"])
    kept = toxicity.clean(table(spark, rows), lab)
    assert kept.columns == ["doc_id", "text", "source", "slot"] and kept.count() == len(rows) - 80 - 4
    assert toxicity.score(table(spark, rows[:3]), lab.limit(0)).where("score = 0").count() == 3
    assert toxicity.score(table(spark, []), lab).count() == 0


def test_exceptions_spare_a_match():
    x = toxicity.Lexicon({"trash": 2.0}, ("trash can",))
    assert x.evidence("the trash can is full")[0] == 0 and x.evidence("this trash talks")[0] == 2 and x.evidence("trаsh")[0] == 2 and x.evidence("trashy")[0] == 0


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary_file())
    tk.no_truncation()
    tk.no_padding()
    odd = ["Ünïcode ÉTÉ ß İstanbul", "tab\tnew\nline\x1fodd sep", "<|endoftext|> <|startoftext|>x", "a" * 5000, "ȩ́ \U0001f600\U0001f468‍\U0001f469", "it's we'll 123,456", " \n ", "Σίσυφος ΟΔΟΣ", "　x\xa0y"]
    rows = [*docs, *[(1000 + i, t, "a", None) for i, t in enumerate(odd)]]
    got = bpe.encode_decode(table(spark, rows), vocabulary_file(), ["doc_id", "text"], full=True).collect()
    assert len(got) == len(rows)
    for g in got:
        ids = tk.encode(g.text or "", add_special_tokens=False).ids
        text = tk.decode(ids, skip_special_tokens=False)
        assert (g.n_tokens, g.ids, g.decoded) == (len(ids), ids, text)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and g.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(table(spark, []), vocabulary_file(), ["doc_id"]).count() == 0


def test_bpe_groups(docs, monkeypatch):
    """Groups and packed pieces of any size give the same, on the way of words without a piece too."""
    with open(vocabulary_file(), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    texts = [d[1] for d in docs]

    def alone(text):
        encoder = bpe.Encoder(vocabulary)
        words = encoder.words(text or "")
        return tuple(side[0] for side in encoder._encode([pa.array(words, pa.string())], [0, len(words)]))

    want = [alone(t) for t in texts]
    for words, size, empty in ((0, 1 << 21, False), (7, 1 << 21, True), (7, 50, False), (1 << 16, 1, True)):
        monkeypatch.setattr(bpe, "PACKED_WORDS", words)
        encoder = bpe.Encoder(vocabulary)
        encoder.empty = empty
        assert [row for ids, decoded in encoder.encode(texts, size) for row in zip(ids, decoded, strict=True)] == want
