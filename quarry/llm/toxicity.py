"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Homoglyphs and full-width letters fold to plain letters, invisible characters go, and digits or signs that stand for
letters are read both ways. Words of the lexicon carry a learned weight; a match inside an exception phrase does not
count. The sum of weights, once for each match and normalised by length, becomes a probability by a fitted logistic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows on which lexicon and logistic are fitted, at most (in expectation, by a hash of the key).
SAMPLE = 8000
#: Different neighbourhoods in texts of label 1 that a word of the lexicon needs.
MIN_SUPPORT = 6
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "class clown", "sore loser", "idiot proof", "pond scum", "soap scum")

_LOOK = {
    "a": "аɑαａ𝐚ạ", "b": "Ьｂ𝐛", "c": "сϲｃⅽ𝐜", "d": "ԁｄⅾ𝐝", "e": "еｅ𝐞ҽ", "f": "ｆ𝐟", "g": "ɡｇ𝐠", "h": "һｈ𝐡", "i": "іıɩιｉⅰ𝐢", "j": "јｊ𝐣",
    "k": "кκｋ𝐤", "l": "ӏｌⅼ𝐥ǀ", "m": "ｍⅿмᴍ𝐦", "n": "ｎոռ𝐧", "o": "оοօｏ𝐨", "p": "рρｐ𝐩", "q": "ԛｑ𝐪", "r": "ｒг𝐫", "s": "ѕｓ𝐬", "t": "тτｔ𝐭",
    "u": "υսｕ𝐮", "v": "νѵｖⅴ𝐯", "w": "ԝｗω𝐰", "x": "хχｘⅹ𝐱", "y": "уγｙ𝐲", "z": "ｚᴢ𝐳",
}
HOMOGLYPHS = {ord(c): a for a, alike in _LOOK.items() for c in alike}
DIGITS = {ord(c): a for c, a in zip("013457@$!|+", "oieastasiit", strict=True)}
HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")
DISGUISE = re.compile(r"[a-z][0-9@$!|+]+[a-z]|(?<![^\W_])[0-9@$][a-z]|[a-z][0-9@$](?![^\W_])")


def fold(text: str) -> str:
    """Lower-cased text with homoglyphs as plain letters and without invisible characters."""
    low = text.lower()
    if low.isascii():
        return low
    return HIDDEN.sub("", low).translate(HOMOGLYPHS)


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: Sequence[str]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        entries = {w: (len(w), float(v)) for w, v in weights.items()} | {x: (len(x), None) for x in exceptions}
        for w, what in entries.items():
            self.auto.add_word(w, what)
        self.any = bool(entries)
        if self.any:
            self.auto.make_automaton()

    def matches(self, folded: str) -> dict[int, tuple[int, float | None]]:
        """End and weight by start; whole words, a plural s allowed, the longest at each start."""
        out: dict[int, tuple[int, float | None]] = {}
        n = len(folded)
        for end, (size, weight) in self.auto.iter(folded):
            start, after = end - size + 1, end + 1
            if start and folded[start - 1].isalpha():
                continue
            if after < n and folded[after] == "s":
                after += 1
            if after < n and folded[after].isalpha():
                continue
            if start not in out or out[start][0] < end:
                out[start] = (end, weight)
        return out

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of matches, and the length in characters."""
        if not text or not self.any:
            return 0.0, len(text or "")
        folded = fold(text)
        found = self.matches(folded)
        if DISGUISE.search(folded):
            for start, what in self.matches(folded.translate(DIGITS)).items():
                if start not in found or found[start][0] < what[0]:
                    found[start] = what
        spared = [(s, e) for s, (e, w) in found.items() if w is None]
        return sum(w for s, (e, w) in found.items() if w is not None and not any(a <= s and e <= b for a, b in spared)), len(folded)


def features(total: float, length: int) -> tuple[float, float]:
    """Whether anything matched, and the weight by length: a match counts for less in a longer text, but not in proportion."""
    return float(total > 0), float(np.log1p(total) / (1 + 0.1 * np.log1p(length / 1000)))


def learn_words(train: DataFrame, text: str, label: str, min_support: int) -> dict[str, float]:
    """Words with their log odds, from the different neighbourhoods that each has in texts of label 1 and of label 0.

    A neighbourhood is the word before and the word after, so that copies of one text count once. All words with support
    come to the driver; they come from the bounded sample alone.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: w != "")
    rows = train.select(F.col(label).alias("y"), words.alias("w"))
    near = F.transform(
        F.col("w"), lambda x, i: F.struct(x.alias("x"), F.xxhash64(F.get(F.col("w"), i - 1), F.get(F.col("w"), i + 1)).alias("c"))
    )
    each = rows.select("y", F.explode(near).alias("e")).select("y", "e.x", "e.c")
    once = each.groupBy("x", "c").agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    by = once.groupBy("x").agg(F.sum(F.when(F.col("lo") == 1, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("lo") == 0, 1).otherwise(0)).alias("good"))
    by = by.where((F.col("bad") >= min_support) & (F.length("x") >= 3))
    # The lower end of the share of bad neighbourhoods, two deviations down, over a half.
    n = F.col("bad") + F.col("good")
    share = (F.col("bad") + 2) / (n + 4)
    by = by.withColumn("low", share - 2 * F.sqrt(share * (1 - share) / (n + 4))).where("low > 0.5")
    top = by.withColumn("weight", F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5))).collect()
    return {r["x"]: r["weight"] for r in top}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


#: Columns that scoring adds beside those of the input; no input has them.
HIT, WEIGHT, SCORE, HELD = "__tox_hit", "__tox_weight", "__tox_score", "__tox_held"


def scored(
    docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str = "toxic", folds: int = 4, held: int = 2,
    sample: int = SAMPLE, exceptions: Sequence[str] = EXCEPTIONS, min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """docs with SCORE and HELD beside its own columns."""
    spark = docs.sparkSession
    fold_of = lambda k: F.pmod(F.crc32(F.col(k).cast("string").cast("binary")), F.lit(folds))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(fold_of("_k") != held)
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    train = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).where(fold_of("_k") != held).join(known, "_k").select("_t", "_y")
    weights = learn_words(train, "_t", "_y", min_support) if n else {}
    model = spark.sparkContext.broadcast((weights, tuple(exceptions)))

    def measure(at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(*model.value)
            for b in batches:
                got = [features(*lexicon.evidence(t.as_py())) for t in b.column(at)]
                hit, weight = (np.array(z, float) for z in zip(*got, strict=True)) if got else (np.zeros(0), np.zeros(0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit), pa.array(weight)], [*b.schema.names, HIT, WEIGHT])

        return run

    def measured(df: DataFrame, at: str) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(measure(df.columns.index(at)), f"{kinds}, {HIT} double, {WEIGHT} double")

    seen = measured(train, "_t").select("_y", HIT, WEIGHT).toPandas() if n else None
    if seen is None or not len(seen):
        beta = np.array([-np.inf, 0, 0])
    elif seen["_y"].nunique() < 2:
        beta = np.array([np.inf if seen["_y"].iloc[0] else -np.inf, 0, 0])
    else:
        beta = fit_logistic(seen[[HIT, WEIGHT]].to_numpy(), seen["_y"].to_numpy(float))
    z = F.lit(float(beta[0])) + F.col(HIT) * float(beta[1]) + F.col(WEIGHT) * float(beta[2])
    got = measured(docs, text).withColumns({SCORE: 1 / (1 + F.exp(-z)), HELD: F.coalesce(fold_of(key) == held, F.lit(False))})
    return got.drop(HIT, WEIGHT)


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: Sequence[str] = (), **options) -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs, and the columns named in keep.

    Rows whose crc32 of the key as text, modulo ``folds``, is ``held`` are never learned from. Whole texts are scored;
    null and empty texts match nothing. With no labelled text, or with one label alone, the score is the share of label
    1, 0 without labels. Labels that are null and rows with a null key are not learned from; a null key is not held out.
    Repeated rows are scored each. An empty table gives an empty result. Other columns of docs may have any names; a
    column in keep, or a key, of the name of a result column raises ValueError. To the driver come the words with support
    in about ``sample`` labelled rows, and two numbers for each of these.
    """
    if clash := {"held_out", "score", "predicted"} & {key, *keep}:
        raise ValueError(f"result columns are named like columns to keep: {sorted(clash)}")
    docs = docs.select(key, *([text] if text != key else []), *[c for c in keep if c not in (key, text)])
    out = scored(docs, labels, key=key, text=text, **options)
    return out.select(key, F.col(HELD).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"), *[c for c in keep if c != key])


def clean(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs with a score below ``threshold``, with the columns of docs, whatever their names."""
    return scored(docs, labels, key=key, text=text, **options).where(F.col(SCORE) < threshold).select(*docs.columns)
