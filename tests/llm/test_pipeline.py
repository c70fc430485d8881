"""The whole pipeline against brute force, over files of unequal size."""

import hashlib
import random

import pytest

import corpus_pipeline
from quarry.llm import mixing


@pytest.fixture
def several_files(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_run_returns_the_mixed_order(spark, several_files, tmp_path):
    r = random.Random(6)
    word = lambda: r.choice(["river", "stone", "green", "table", "sun", "walk", "quiet"]) + str(r.randint(0, 99))
    rows, bad = [], set()
    for i in range(600):
        words = [word() for _ in range(r.choice([20, 30, 40]))]
        if i % 5 == 0:
            words[r.randrange(20)] = r.choice(["wretchling", "vilethug"])
            bad.add(i)
        rows.append((i, " ".join(words), "en", r.choice(["a", "a", "a", "b", None])))
    rows += [(1000 + i, rows[i][1], "en", "b") for i in range(1, 100) if i % 5]
    rows += [(2000 + i, " ".join(word() for _ in range(3000)), "en", "b") for i in range(20)]
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.where("doc_id < 50").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id >= 50").repartition(3).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in bad)) for i in range(600)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = [x for x in rows if x[0] not in bad and not 1000 <= x[0] < 2000]
    by = {}
    for x in kept:
        by.setdefault("0" if x[3] is None else f"={x[3]}", []).append(x[0])
    blocks = {}
    for s, ids in by.items():
        ids.sort(key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        blocks[s] = [ids[k : k + mixing.BLOCK_ROWS] for k in range(0, len(ids), mixing.BLOCK_ROWS)]
    weights = mixing.integer_weights(dict(sorted((s, len(v) ** 0.5) for s, v in by.items())), mixing.RESOLUTION)
    want, left = [], dict(sorted(blocks.items()))
    while left:  # a period at a time; before a source runs out, one takes the rest of it
        w = {s: weights[s] for s in left}
        if any(len(left[s]) < w[s] for s in left):
            w = {s: min(w[s], len(left[s])) for s in left}
        for s, j in mixing.period(w):
            want += left[s][j]
        left = {s: v[w[s] :] for s, v in left.items() if v[w[s] :]}

    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", *corpus_pipeline.PLACE).collect()
    assert len({r[1:] for r in got}) == len(got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r[1:])] == want
