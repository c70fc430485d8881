"""LM scoring by Katz backoff over Good-Turing discounted trigram, bigram and unigram counts.

p(w|uv) is d(c)·c(uvw)/c(uv) where uvw was seen in training; alpha(uv)·p(w|v) where only the context uv was; p(w|v) where
it was not. p(w|v) goes on in the same way to p(w), which is d(c)·c(w)/N for known words, and what these discounts leave
for all unknown words together. alpha is what the discounts leave of a context, over what its unseen words have one order
below, so that each distribution adds up to one. Counts up to ``CUT`` are discounted by Good-Turing; larger ones by the
factor ``BIG``, so that each context leaves something.

A chunk of documents has its own list of words and the tokens as numbers in it. Each chunk's list goes to the words'
buckets, is counted there over the whole corpus, and comes back with counts and global numbers. Then every token w goes,
with its document and the word u before the last, to the bucket of the word v between: the trigrams uvw, the bigrams vw
and what p(w|v) takes all lie there. c(uv) stands below the line for each token whatever its case; it is c(vw) of the
token before, whose bucket adds it up. A word so frequent that it would crowd a bucket is dealt to several by its
successors; the sums over a context of it are then put together: those of v on the driver, those of uv in buckets of
contexts, where the tokens that back off from them go too. Two things are known only when all buckets are counted: the
discounts of bigrams and trigrams. Buckets therefore keep, by document, the sum of what they know, how many of its grams
have each discounted count, and which of its tokens back off from which context.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import give_back, pack, unpack

CUT, BIG = 5, 0.9999
#: Tokens of a chunk of documents, and bytes of text to a bucket, whatever the size of the corpus.
CHUNK_TOKENS, BUCKET_BYTES = 900_000, 8_000_000
#: A document's place in its chunk, which has no more documents than tokens, takes so many bits.
CHUNK_BITS = 22
#: Tokens that are held as words at a time.
PIECE_TOKENS = 100_000
#: A word seen more often is dealt to several buckets by its successors; raised so that at most ``HOT_WORDS`` words are.
HOT, HOT_WORDS = 700_000, 100_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
START, END = b" start", b" end"  # no word holds a space
SEED = 17


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, then one end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(), END]


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..CUT) by Good-Turing with Katz's correction, from the numbers n(1..CUT+1) of grams of each count.

    Where a number is missing or the formula leaves (0, 1), that count is discounted absolutely by n1/(n1+2*n2), and by
    a half where n1 or n2 is missing.
    """
    n = np.concatenate([[0.0], np.asarray(n, float)])
    away = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = np.ones(CUT + 1)
    last = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last != 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - away) / r
    return d


def seen(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return c * np.where(c <= CUT, d[np.minimum(c, CUT).astype(np.int64)], BIG)


def left(n: np.ndarray, big: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What the discounts leave of contexts with n[r-1] grams of count r and ``big`` tokens in grams of larger counts."""
    r = np.arange(1, CUT + 1)
    return (n * (r * (1 - d[1:]))[:, None]).sum(axis=0) + big * (1 - BIG)


class Unigrams:
    """p(w) from the count of w."""

    def __init__(self, total: int, n: np.ndarray):
        self.d, self.total = discounts(n), max(total, 1)
        small = n[:CUT].reshape(-1, 1)
        big = total - float((np.arange(1, CUT + 1) * n[:CUT]).sum())
        self.unknown = float(left(small, np.array([big]), self.d)[0]) / self.total if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, seen(c, self.d) / self.total, self.unknown)


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, the first from zero; they take fewer bytes."""
    return np.diff(x, prepend=x.dtype.type(0))


def encode(docs: DataFrame, key: str, text: str, folds: int, held: int, chunk_tokens: int) -> DataFrame:
    """Chunks: (chunk, mark, keys, words, counts, blob), the same ones whenever the same rows are read in the same order.

    mark tells chunks of different content apart. words: hashes in ascending order, the start among them; counts: in
    training rows; blob: token count of each document, which are held out, the places of start and end, the tokens' places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, out, lengths = [], [], []
        flat: list[bytes] = []
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        held_back = 0

        def piece() -> None:
            nonlocal flat, held_back
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            flat = []
            hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
            pieces.append((hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)))
            held_back += len(pieces[-1][1])

        def chunk() -> pa.RecordBatch:
            nonlocal number, keys, out, lengths, pieces, held_back
            piece()
            edges = np.array([xxhash.xxh64_intdigest(x, SEED) for x in (START, END)], np.uint64)
            words, place = np.unique(np.concatenate([*[h for h, _ in pieces], edges]), return_inverse=True)
            shift = np.cumsum([0, *[len(h) for h, _ in pieces]])
            ids = np.concatenate([place[s:][i].astype(np.uint32) for s, (_, i) in zip(shift.tolist(), pieces, strict=False)])
            pieces, held_back = [], 0
            size, away = np.array(lengths), np.array(out)
            counts = np.bincount(ids[~np.repeat(away, size)], minlength=len(words))
            counts[place[-2]] += int((~away).sum())
            blob = pack(size, away, place[-2:], ids)
            mark = xxhash.xxh64_intdigest(words.tobytes() + blob) >> 1
            row = [part << 32 | number], [mark], [pickle.dumps(keys)], [pack(deltas(words))], [pack(counts)], [blob]
            number += 1
            keys, out, lengths = [], [], []
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)], ["chunk", "mark", "keys", "words", "counts", "blob"])

        for b in batches:
            for k, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = tokens(t.as_py())
                keys.append(k)
                out.append(h)
                flat += words
                lengths.append(len(words))
                if len(flat) >= PIECE_TOKENS:
                    piece()
                if held_back + len(flat) >= chunk_tokens:
                    yield chunk()
        if keys:
            yield chunk()

    fold = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    return docs.select(key, fold.alias("_h"), text).mapInArrow(run, "chunk long, mark long, keys binary, words binary, counts binary, blob binary")


N2, N3 = [f"n{r}" for r in range(1, CUT + 2)], [f"m{r}" for r in range(1, CUT + 2)]
SUMS, SUMS3 = (", ".join(f"{c} long" for c in names) for names in (N2, N3))


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, mark, back, total, distinct, n1..): counts and global numbers of a chunk's words in the order of
    their hashes; the sums on one row a bucket. A bucket is a range of hashes."""
    edges = [(k << 64) // buckets for k in range(1, buckets)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = np.array(edges, np.uint64)
        for b in batches:
            for chunk, mark, words, counts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w, (c,) = np.cumsum(unpack(words)[0], dtype=np.uint64), unpack(counts)
                cuts = [0, *np.searchsorted(w, inner).tolist(), len(w)]
                rows = [(k, pack(deltas(w[i:j]), c[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                cols = [k for k, _ in rows], [chunk] * len(rows), [mark] * len(rows), [p for _, p in rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["bucket", "chunk", "mark", "part"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        parts = [(np.cumsum(w, dtype=np.uint64), c) for w, c in map(unpack, rows["part"])]
        words, place = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in parts]).astype(float), len(words)).round().astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.lexsort((words, -total))] = np.arange(len(words)) * buckets + bucket
        cuts = np.cumsum([len(w) for w, _ in parts])[:-1]
        out = pd.DataFrame({"bucket": rows["bucket"], "chunk": rows["chunk"], "mark": rows["mark"], "back": [pack(total[p], number[p]) for p in np.split(place, cuts)]})
        real = total[words != np.uint64(xxhash.xxh64_intdigest(START, SEED))]
        sums = {"total": real.sum(), "distinct": (real > 0).sum()} | {f"n{r}": (real == r).sum() for r in range(1, CUT + 2)}
        for name, n in sums.items():  # once for the bucket
            out[name] = [int(n)] + [0] * (len(out) - 1)
        return out

    dealt = chunks.select("chunk", "mark", "words", "counts").mapInArrow(deal, "bucket int, chunk long, mark long, part binary")
    return dealt.groupBy("bucket").applyInPandas(count, f"bucket int, chunk long, mark long, back binary, total long, distinct long, {SUMS}")


def joint(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by several columns of numbers from zero, the first one first, and where in it a new value of all begins."""
    bits = [max(1, int(k.max()).bit_length()) if len(k) else 1 for k in keys]
    if sum(bits) <= 63:
        one = keys[0].astype(np.int64)
        for k, b in zip(keys[1:], bits[1:], strict=True):
            one = one << b | k
        order = np.argsort(one)
        one = one[order]
        return order, np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else order
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """For n places in order the number of the group each is in, from where the groups start."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def deal_tokens(chunks: DataFrame, counted: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(bucket, keys, blob): the tokens of a chunk by the bucket of the word before, in order of that word, themselves and
    the word before the last.

    On rows with a bucket below zero, the chunk's documents: their keys, token counts, known tokens and base scores.
    """

    def deal(key: tuple, chunk: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(back):
            raise RuntimeError("a chunk came out different when it was read again")
        base = int(key[0])
        parts = [unpack(p) for p in back.sort_values("bucket")["back"]]
        known, number = (np.concatenate(z).astype(np.int64) for z in zip(*parts, strict=True))
        size, away, (start, end), ids = unpack(chunk["blob"].iloc[0])
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        docs = pack(np.array([base]), size, away, np.bincount(doc, known[ids] > 0, len(size)).round().astype(np.int64), np.bincount(doc, np.log10(known + 0.5)[ids], len(size)), known[[start]])
        rows = [(-1 - base % buckets, chunk["keys"].iloc[0], docs)]
        by_number = np.argsort(number)
        rank = np.empty(len(number), np.int32)
        rank[by_number] = np.arange(len(number), dtype=np.int32)
        number, known = number[by_number], known[by_number]
        w, begin = rank[ids], np.cumsum(size) - size
        del ids
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[begin] = rank[start]
        u = np.empty_like(w)
        u[1:] = v[:-1]
        u[begin] = rank[start]
        salts = np.clip(-(-known // hot), 1, buckets).astype(np.uint64)
        mixed = (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        salt = number.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
        bucket = ((mixed[v] + salt[w] % salts[v]) % np.uint64(buckets)).astype(np.int64)
        order, _ = joint(bucket, v, w, u)
        v, w, u, doc, bucket = v[order], w[order], u[order], doc[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            bv, bw = v[i:j], w[i:j]
            pairs = np.flatnonzero(np.concatenate([[True], (bv[1:] != bv[:-1]) | (bw[1:] != bw[:-1])]))
            pv = bv[pairs]
            names = np.flatnonzero(np.concatenate([[True], pv[1:] != pv[:-1]]))
            nv = pv[names]
            own_w, at_w = np.unique(bw[pairs], return_inverse=True)
            own_u, at_u = np.unique(u[i:j], return_inverse=True)
            rows.append((int(bucket[i]), None, pack(
                deltas(number[nv]), salts[nv] > 1, known[nv], np.diff(np.append(names, len(pairs))), deltas(number[own_w]), known[own_w], at_w,
                np.diff(np.append(pairs, j - i)), deltas(number[own_u]), at_u, doc[i:j], away, np.array([base, number[rank[end]]]),
            )))
        del order, v, w, u, doc, bucket
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "keys", "blob"])

    left, right = chunks.select("chunk", "mark", "keys", "blob"), counted.select("chunk", "mark", "bucket", "back")
    return left.groupBy("chunk", "mark").cogroup(right.groupBy("chunk", "mark")).applyInPandas(deal, "bucket int, keys binary, blob binary")


def row_numbers(base: int, doc: np.ndarray) -> np.ndarray:
    """A document's number in the corpus from its chunk and its place there."""
    return ((base >> 32 << 20 | (base & 0xFFFFFFFF)) << CHUNK_BITS) + doc.astype(np.int64)


class Bucket:
    """All tokens of a bucket by trigram: ``v``, ``w`` and ``u`` are places in the words' lists, ``pair`` the bigram of each
    trigram and ``context`` its uv; c3 and c2 are counts in training; ``doc`` and ``kind`` are document and trigram of each token."""

    def __init__(self, blobs):
        cols: list[list] = [[] for _ in range(9)]
        lists: list[list] = [[] for _ in range(5)]
        self.end, pairs, n_w, n_u = -1, 0, 0, 0
        for x in blobs:
            v, salted, known_v, runs, w, known_w, at_w, many, u, at_u, doc, away, (base, self.end) = unpack(x)
            for at, got in enumerate((np.cumsum(v, dtype=np.int64), salted, known_v, np.cumsum(w, dtype=np.int64), np.cumsum(u, dtype=np.int64))):
                lists[at].append(got)
            cols[0].append(runs.astype(np.int32))
            cols[1].append(at_w.astype(np.int32) + n_w)
            cols[2].append(np.repeat(np.arange(pairs, pairs + len(many), dtype=np.int32), many))
            cols[3].append(at_u.astype(np.int32) + n_u)
            cols[4].append(row_numbers(int(base), doc))
            cols[5].append(~away[doc])
            cols[6].append(known_w)
            pairs, n_w, n_u = pairs + len(many), n_w + len(w), n_u + len(u)

        def take(k: int) -> np.ndarray:
            got, cols[k] = np.concatenate(cols[k]), []
            return got

        raw = np.concatenate(lists[0])
        self.names, first, place = np.unique(raw, return_index=True, return_inverse=True)
        self.salted, self.total = np.concatenate(lists[1])[first].astype(bool), np.concatenate(lists[2])[first].astype(np.int64)
        pv = np.repeat(place.astype(np.int32), take(0))
        self.words, first, place = np.unique(np.concatenate(lists[3]), return_index=True, return_inverse=True)
        self.known = take(6)[first].astype(np.int64)
        pw = place.astype(np.int32)[take(1)]
        self.before, place = np.unique(np.concatenate(lists[4]), return_inverse=True)
        eu, ep = place.astype(np.int32)[take(3)], take(2)
        del lists, raw, first, place
        order, new = joint(pv[ep], pw[ep], eu)
        order = order.astype(np.int32)
        ep, eu = ep[order], eu[order]
        self.kind = spread(new, len(order)).astype(np.int32)
        self.doc, train = take(4)[order], take(5)[order]
        del order
        self.c3 = np.bincount(self.kind, train, len(new)).round().astype(np.int64)
        self.u, tv, tw = eu[new], pv[ep[new]], pw[ep[new]]
        del eu, ep, train
        starts = np.flatnonzero(np.concatenate([[True], (tv[1:] != tv[:-1]) | (tw[1:] != tw[:-1])]))
        self.pair = spread(starts, len(tv)).astype(np.int32)
        self.v, self.w = tv[starts], tw[starts]
        self.c2 = np.bincount(self.pair, self.c3, len(starts)).round().astype(np.int64)
        order, new = joint(tv, self.u)
        self.context = np.empty(len(tv), np.int32)
        self.context[order] = spread(new, len(tv))
        self.context_v, self.context_u = tv[order[new]], self.u[order[new]]


FACTS3 = 2 * (CUT + 1)


def by_count(c: np.ndarray, at: np.ndarray, size: int, value: np.ndarray | None = None) -> list[np.ndarray]:
    """For each of ``size`` groups the sum of value (or the number) over counts 1 to CUT, and over larger ones."""
    out = [np.bincount(at[c == r], None if value is None else value[c == r], size) for r in range(1, CUT + 1)]
    big = c > CUT
    return [*out, np.bincount(at[big], c[big] if value is None else value[big], size)]


def facts(docs: np.ndarray, known: np.ndarray, low3: list, low2: list, two: tuple, three: tuple) -> bytes:
    """A row's content: sums by document; and for bigram and trigram contexts which tokens back off, and the contexts' sums."""
    (at2, where2, names, salted, sums2), (at3, where3, sums3) = two, three
    return pack(docs, known, *low3, *low2, at2, where2, names, salted, *sums2, at3, where3, *sums3)


def gather(dealt: DataFrame, one: Unigrams, buckets: int) -> DataFrame:
    """(bucket, keys, blob, context, n1.., m1..): what a bucket knows of its documents and of the contexts that still matter.

    Rows with a context instead of a bucket hold the part that a bucket knows of the contexts uv of a dealt word. n: the
    numbers of bigrams of each count, m: those of trigrams, once for the bucket.
    """
    zeros = {c: 0 for c in N2 + N3}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return rows.assign(context=None, **zeros)
        b = Bucket(rows["blob"])
        p1 = one.p(b.known)
        kv = b.total[b.v]
        seen2, seen3, seen_context = b.c2 > 0, b.c3 > 0, np.bincount(b.context, b.c3, len(b.context_v)) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            share = b.c2 / np.maximum(kv, 1)
            above = np.where(seen2 & (b.words[b.w] != b.end), -np.log10(b.c2), 0.0)  # the next token's c(uv)
            back = np.where(seen2, np.log10(share) + np.where(b.c2 > CUT, np.log10(BIG), 0), np.log10(p1[b.w]) - np.log10(np.maximum(kv, 1)))
            value = np.where(seen3, np.log10(b.c3) + np.where(b.c3 > CUT, np.log10(BIG), 0), back[b.pair]) + above[b.pair]
        docs, at = np.unique(b.doc, return_inverse=True)
        at = at.astype(np.int32)
        known = np.bincount(at, value[b.kind], len(docs))
        low3 = [np.bincount(at[(b.c3 == r)[b.kind]], minlength=len(docs)) for r in range(1, CUT + 1)]
        low2 = [np.bincount(at[(~seen3 & (b.c2 == r)[b.pair])[b.kind]], minlength=len(docs)) for r in range(1, CUT + 1)]
        # Tokens that back off from v: neither gram was seen, the context was.
        off = np.flatnonzero((~seen2 & (kv > 0))[b.pair][b.kind])
        where = b.v[b.pair[b.kind[off]]]
        sums2 = [*by_count(b.c2, b.v, len(b.names)), np.bincount(b.v[seen2], p1[b.w[seen2]], len(b.names))]
        matter = np.flatnonzero((np.bincount(where, minlength=len(b.names)) > 0) | b.salted)
        spot = np.zeros(len(b.names), np.int32)
        spot[matter] = np.arange(len(matter))
        two = at[off], spot[where], b.names[matter], b.salted[matter], [x[matter] for x in sums2]
        # Tokens that back off from uv: the trigram was not seen, the context was, here or in another bucket of v.
        dealt_v = b.salted[b.context_v]
        sums3 = by_count(b.c3, b.context, len(b.context_v)) + by_count(b.c2[b.pair[seen3]], b.context[seen3], len(b.context_v), share[b.pair[seen3]])
        off = np.flatnonzero((~seen3 & (seen_context | dealt_v)[b.context])[b.kind])
        where = b.context[b.kind[off]]
        there = dealt_v[where]
        matter = np.flatnonzero((np.bincount(where[~there], minlength=len(b.context_v)) > 0) & ~dealt_v)
        spot = np.zeros(len(b.context_v), np.int32)
        spot[matter] = np.arange(len(matter))
        three = at[off[~there]], spot[where[~there]], [x[matter] for x in sums3]
        blob = facts(docs, known, low3, low2, two, three)
        head = {f"n{r}": int((b.c2 == r).sum()) for r in range(1, CUT + 2)} | {f"m{r}": int((b.c3 == r).sum()) for r in range(1, CUT + 2)}
        out = [{"bucket": rows["bucket"].iloc[0], "keys": None, "blob": blob, "context": None, **head}]
        ours = np.flatnonzero(dealt_v)
        if len(ours):
            u, v = b.before[b.context_u[ours]], b.names[b.context_v[ours]]
            to = (((u.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ v.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) % np.uint64(buckets)
            spot[ours] = np.arange(len(ours))
            asks, doc = spot[where[there]], b.doc[off[there]]
            goes = to[asks] if len(asks) else to[:0]
            for k in np.unique(to).tolist():
                mine, e = np.flatnonzero(to == k), np.flatnonzero(goes == k)
                own = np.zeros(len(ours), np.int64)
                own[mine] = np.arange(len(mine))
                whole = np.flatnonzero(seen_context[ours[mine]])
                out.append({"bucket": None, "keys": None, "blob": pack(u[mine], v[mine], doc[e], own[asks[e]], whole, *[x[ours[mine[whole]]] for x in sums3]), "context": int(k), **zeros})
        del b, docs, at, value, off, where
        give_back()
        return pd.DataFrame(out)

    return dealt.groupBy("bucket").applyInPandas(run, f"bucket int, keys binary, blob binary, context int, {SUMS}, {SUMS3}")


def gather_contexts(parts: DataFrame) -> DataFrame:
    """(blob): rows like the buckets' for the contexts uv of dealt words, with the sums of all parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        us, vs, docs, asks, at, sums = [], [], [], [], [], [[] for _ in range(FACTS3)]
        n = 0
        for x in rows["blob"]:
            u, v, doc, own, whole, *got = unpack(x)
            us.append(u)
            vs.append(v)
            docs.append(doc)
            asks.append(own + n)
            at.append(whole + n)
            for s, g in zip(sums, got, strict=True):
                s.append(g)
            n += len(u)
        u, v, doc, asks, at = (np.concatenate(x) for x in (us, vs, docs, asks, at))
        order, new = joint(np.unique(v, return_inverse=True)[1], np.unique(u, return_inverse=True)[1])
        place = np.empty(len(u), np.int64)
        place[order] = spread(new, len(u))
        sums = [np.bincount(place[at], np.concatenate(s), len(new)) for s in sums]
        is_seen = np.zeros(len(new), bool)
        is_seen[place[at]] = True
        where = place[asks]
        ok = is_seen[where] if len(where) else np.zeros(0, bool)
        where, doc = where[ok], doc[ok]
        matter = np.flatnonzero(np.bincount(where, minlength=len(new)))
        spot = np.zeros(len(new), np.int64)
        spot[matter] = np.arange(len(matter))
        docs, at = np.unique(doc, return_inverse=True)
        none, zero = np.zeros(0, np.int64), np.zeros(len(docs), np.int64)
        two = none, none, none, none.astype(bool), [none] * (CUT + 2)
        blob = facts(docs, zero.astype(float), [zero] * CUT, [zero] * CUT, two, (at, spot[where], [x[matter] for x in sums]))
        return pd.DataFrame({"blob": [blob]})

    return parts.groupBy("context").applyInPandas(run, "blob binary")


def score(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1,
    chunk_tokens: int = CHUNK_TOKENS, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, keep_tables: str | None = None,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    The model learns from rows whose crc32 of the key as text, modulo ``folds``, is not ``held``; a null key is not held
    out. A null or empty text has one token, its end. Texts of any length are taken whole; repeated rows count and are
    scored each. Unknown words are one symbol, in the base as in the model, and both sum to one over the known words and
    it. Before a document stand two starts. Without training rows every score is 0. An empty table gives an empty result.
    Words are told apart by 64-bit hashes. ``hot`` and the sizes of chunks and buckets are no part of the result. Other
    columns are left out; a key named like a result column raises ValueError. Docs that are not read straight from a table
    are written once, as they are read twice in one order. keep_tables: a folder to which the counts of trigrams are
    written, by bucket. To the driver come only a few sums, and those of at most ``HOT_WORDS`` words.
    """
    results = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    if key in results:
        raise ValueError(f"the key is named like a result column: {key}")
    spark = docs.sparkSession
    docs = docs.select(key, text) if is_scan(docs) else common.cut(docs.select(key, text))
    chunks = encode(docs, key, text, folds, held, chunk_tokens)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket_bytes))
    counted = common.cut(count_words(chunks, buckets))
    sums = lambda names: [F.coalesce(F.sum(c), F.lit(0)) for c in names]
    total, distinct, *n1 = counted.agg(*sums(["total", "distinct", *N2])).first()
    one = Unigrams(total, np.array(n1, float))
    dealt = deal_tokens(chunks, counted, buckets, max(hot, total // HOT_WORDS))
    if keep_tables:
        write_tables(dealt, keep_tables)
    table = common.cut(gather(dealt, one, buckets))
    counts = np.array(table.agg(*sums(N2 + N3)).first(), float)
    d2, d3 = discounts(counts[: CUT + 1]), discounts(counts[CUT + 1 :])
    names2 = [*N2[:CUT], "big", "lower"]
    first2 = 2 + 2 * CUT

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                names, on, *rest = unpack(x.as_py())[first2 + 2 :]
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(z[on].astype(t)) for z, t in zip([names, *rest[: CUT + 2]], [np.int64] + [np.float64] * (CUT + 2), strict=True)], ["v", *names2])

    bucket_rows = table.where("bucket >= 0").select("blob")
    kinds = ", ".join(f"{c} double" for c in names2)
    hot_sums = bucket_rows.mapInArrow(salted, f"v long, {kinds}").groupBy("v").agg(*[F.sum(c).alias(c) for c in names2]).orderBy("v").toPandas()
    shared = spark.sparkContext.broadcast((hot_sums["v"].to_numpy(np.int64), hot_sums[names2].to_numpy(float).T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_v, hot_facts = shared.value
        for b in batches:
            for x in b.column(0):
                rows, s, *rest = unpack(x.as_py())
                low3, low2, rest = rest[:CUT], rest[CUT : 2 * CUT], rest[2 * CUT :]
                (at2, where2, names, on), two, (at3, where3), three = rest[:4], np.array(rest[4 : CUT + 6], float), rest[CUT + 6 : CUT + 8], np.array(rest[CUT + 8 :], float)
                for r in range(CUT):
                    s = s + low3[r] * np.log10(d3[r + 1]) + low2[r] * np.log10(d2[r + 1])
                if on.any():
                    two[:, on] = hot_facts[:, np.searchsorted(hot_v, names[on])]
                n, big, lower = two[:CUT], two[CUT], two[CUT + 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    alpha2 = np.log10(left(n, big, d2) / np.maximum(1 - lower, 1e-300))
                    lower = (three[CUT + 1 : 2 * CUT + 1] * d2[1:, None]).sum(axis=0) + BIG * three[2 * CUT + 1]
                    alpha3 = np.log10(left(three[:CUT], three[CUT], d3) / np.maximum(1 - lower, 1e-300))
                s = s + np.bincount(at2, alpha2[where2], len(rows)) + np.bincount(at3, alpha3[where3], len(rows))
                chunk, doc = rows >> CHUNK_BITS, rows & ((1 << CHUNK_BITS) - 1)
                cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])).tolist() if len(rows) else [0]
                parts = [pack(doc[i:j], s[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.nulls(len(parts), pa.binary()), pa.array(parts, pa.binary())], ["chunk", "keys", "blob"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk = [int(row_numbers(int(unpack(x.as_py())[0][0]), np.zeros(1))[0]) >> CHUNK_BITS for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *b.columns], ["chunk", "keys", "blob"])

    const = float(np.log10(total + 0.5 * (distinct + 1)))

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["keys"].notna()
        own = rows[mine].iloc[0]
        _, size, away, known, b0, starts = unpack(own["blob"])
        s = np.full(len(size), -np.log10(max(int(starts[0]), 1)))  # c(uv) of the two starts
        for x in rows["blob"][~mine]:
            doc, part = unpack(x)
            s[doc] += part
        return pd.DataFrame({
            key: pd.Series(pickle.loads(own["keys"]), dtype=object), "held_out": away, "n_tokens": size, "n_known": known,
            "train_tokens": total, "base_score": b0 - size * const, "score": s,
        })

    kind, one_row = docs.schema[key].dataType.simpleString(), "chunk long, keys binary, blob binary"
    names = table.where("bucket < 0").select("keys", "blob").mapInArrow(named, one_row)
    parts = gather_contexts(table.where("context is not null").select("context", "blob"))
    return names.union(bucket_rows.union(parts).mapInArrow(run, one_row)).groupBy("chunk").applyInPandas(
        together, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def is_scan(df: DataFrame) -> bool:
    """Whether df is read straight from a table, so that its rows come in the same order whenever it is read."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        name, below = plan.nodeName(), plan.children()
        if below.isEmpty():
            return name != "InMemoryRelation"
        if name not in ("Project", "Filter") or below.size() != 1:
            return False
        plan = below.head()


def write_tables(dealt: DataFrame, folder: str) -> None:
    """The counts as Parquet: (u, v, w, count, count_vw, count_w) by the words' numbers, a folder for each bucket of v.

    count_vw is the part of the bigram's count that comes from this bucket, which is all of it."""

    def rows(rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(rows["blob"])
        on = np.flatnonzero(b.c3)
        pair = b.pair[on]
        return pd.DataFrame({
            "bucket": rows["bucket"].iloc[0], "u": b.before[b.u[on]].astype(np.int64), "v": b.names[b.v[pair]].astype(np.int64), "w": b.words[b.w[pair]].astype(np.int64),
            "count": b.c3[on], "count_vw": b.c2[pair], "count_w": b.known[b.w[pair]],
        })

    kinds = "bucket int, u long, v long, w long, count long, count_vw long, count_w long"
    dealt.where("bucket >= 0").groupBy("bucket").applyInPandas(rows, kinds).write.partitionBy("bucket").parquet(folder)
