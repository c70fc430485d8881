"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch lie in one linked list of symbols. An index maps each adjacent pair that has a rank to all its
positions; ranks that occur are applied in ascending order, and each merge updates the lists of the pairs around it.
Words are what white space separates: the vocabulary's splitting never crosses white space, so that a word's tokens do
not depend on its neighbours and are kept for the rest of the partition.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import give_back

#: Words kept by a partition; beyond it the memory is emptied and filled anew.
MEMORY_WORDS = 200_000
#: Characters of text whose new words are merged together.
GROUP_CHARS = 1 << 21
#: Words of a group that are held as Python strings at once, and those of one more text.
PACKED_WORDS = 1 << 16
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[^\S\x1c-\x1f]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Vocabulary, ranks and text rules of a word-end BPE tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["ignore_merges"]:
            raise ValueError("not a word-end BPE file of the kind supported")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.alphabet = byte_alphabet()
        self.keys, self.rank_of, self.made, self.pairs = self._pairs(model["merges"])
        if any(c + e not in self.ids for c in self.alphabet for e in ("", self.end)):
            raise ValueError("a byte has no symbol")
        self.inner = np.array([self.ids[c] for c in self.alphabet], np.int32)
        self.last = np.array([self.ids[c + self.end] for c in self.alphabet], np.int32)
        base = 1 + int(max(self.inner.max(), self.last.max()))
        self.base_rank = np.full((base + 1, base + 1), -1, np.int32)  # the last row and column: an end
        a, b = np.divmod(np.arange(base * base), base)
        self.base_rank[:base, :base] = self.ranks(a, b).reshape(base, base)

    def _pairs(self, merges: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Sorted pair keys, the rank of each, and the symbol that each rank makes and the pair that it joins."""
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in merges]
        ids = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs])
        born = np.full(max(self.ids.values()) + 1, -1)
        born[ids[:, 2]] = np.arange(len(ids))
        if len(np.unique(ids[:, 2])) < len(ids) or (np.maximum(born[ids[:, 0]], born[ids[:, 1]]) >= np.arange(len(ids))).any():
            raise ValueError("a merge comes before a symbol that it needs, or two merges make one symbol")
        keys = ids[:, 0] << 32 | ids[:, 1]
        order = np.argsort(keys)
        return keys[order], order.astype(np.int32), ids[:, 2].astype(np.int32), [(a, b) for a, b in ids[:, :2].tolist()]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none or a symbol is an end."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], -1)


def merge(symbol: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Merge the words in ``symbol``, which -1 ends, in place; what a merge has taken becomes -2.

    No merge can bring up a pair of lower rank (the vocabulary is checked for it), and so one pass over the active ranks
    in ascending order gives each word what it would get alone.
    """
    n = len(symbol)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    where: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray, r: np.ndarray) -> None:
        keep = r >= 0
        at, r = at[keep], r[keep]
        if len(r) > 1:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            ranks, parts = r[[0, *cuts]].tolist(), np.split(at, cuts) if len(cuts) else [at]
        else:
            ranks, parts = r.tolist(), [at]
        for k, x in zip(ranks, parts, strict=False):
            if k in where:
                where[k].append(x)
            else:
                where[k] = [x]
                heapq.heappush(active, k)

    note(np.arange(n - 1, dtype=np.int32), v.base_rank[symbol[:-1], symbol[1:]])
    while active:
        rank = heapq.heappop(active)
        parts = where.pop(rank)
        i = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b = v.pairs[rank]
        i = i[symbol[i] == a]
        j = after[i]
        ok = symbol[j] == b
        if not ok.all():
            i, j = i[ok], j[ok]
        if a == b and len(i) > 1:  # runs: every second one from the left
            start = np.concatenate([[True], i[1:] != j[:-1]])
            run = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
            odd = (np.arange(len(i)) - run) % 2 == 0
            i, j = i[odd], j[odd]
        if not len(i):
            continue
        symbol[i] = v.made[rank]
        symbol[j] = -2
        k = after[j]
        after[i] = k
        before[k] = i  # the last position is an end, so k is inside
        left = before[i]
        i = np.concatenate([left[left >= 0], i])
        note(i, v.ranks(symbol[i], symbol[after[i]]))
    return symbol


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.names = np.array([b"%d" % i for i in range(max(vocabulary.tokens) + 1)], dtype=object)
        self.shown = np.array([vocabulary.tokens.get(i, "").encode() for i in range(max(vocabulary.tokens) + 1)], dtype=object)
        self.marked = regex.compile(vocabulary.words.pattern + "|\\n")
        self.forget()

    def forget(self) -> None:
        """Empty the memory of words: ids as decimal text, and the tokens that they decode to. A line end marks a special token."""
        self.empty = False
        self.known = {f"\n{t}": b"%d" % i for t, i in self.v.special.items()}
        self.decoded = {f"\n{t}": t.encode() for t in self.v.special}

    def learn(self, words: Iterable[str]) -> None:
        """Encode words, none of which holds a line end, and decode their ids."""
        new = list(words)
        if not new:
            return
        low = unicodedata.normalize("NFC", "\n".join(new)).replace("Σ", "σ").lower()
        raw = np.frombuffer(("\n".join(self.marked.findall(low)) + "\n").encode(), np.uint8)
        end = raw == 10
        # A word's end is a piece of its own, so that three line ends stand between two words.
        runs = np.diff(np.flatnonzero(np.diff(np.concatenate([[False], end, [False]]).astype(np.int8))))[::2] if len(raw) else []
        third = np.zeros(len(raw), bool)
        third[2:] = end[2:] & end[1:-1] & end[:-2]
        if len(new) != third.sum() + 1 or end[0] or (runs > 3).any():  # a word without a piece
            for w in new:
                if self.v.words.search(unicodedata.normalize("NFC", w)):
                    self.learn([w]) if len(new) > 1 else self._keep(new, raw, end, third)
                else:
                    self.known[w] = self.decoded[w] = b""
                    self.empty = True
            return
        self._keep(new, raw, end, third)

    def _keep(self, new: list[str], raw: np.ndarray, end: np.ndarray, third: np.ndarray) -> None:
        symbol = self.v.inner[raw]
        last = np.flatnonzero(end[1:] & ~end[:-1])
        symbol[last] = self.v.last[raw[last]]
        symbol[end] = -1
        merge(symbol, self.v)
        left = symbol >= 0
        ids, owner = symbol[left], np.cumsum(third)[left]
        names, shown = self.names[ids].tolist(), self.shown[ids].tolist()
        cuts = np.searchsorted(owner, np.arange(len(new) + 1)).tolist()
        self.known.update({w: b" ".join(names[a:b]) for w, a, b in zip(new, cuts, cuts[1:], strict=False)})
        self.decoded.update({w: b" ".join(shown[a:b]) for w, a, b in zip(new, cuts, cuts[1:], strict=False)})

    def words(self, text: str) -> list[str]:
        if any(t in text for t in self.v.special):
            parts = self.v.specials.split(text)
            return [w for k, p in enumerate(parts) for w in (["\n" + p] if k % 2 else self.words(p))]
        if ODD_SPACE.search(text):  # white space to Python alone
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def encode(self, texts: Iterable[str | None], size: int = GROUP_CHARS) -> Iterator[tuple[list[bytes], list[bytes]]]:
        """For a group of texts after another: their ids, in decimal, joined by a space; their tokens, joined by a space."""
        packed: list[pa.Array] = []
        flat: list[str] = []
        offsets, chars = [0], 0
        for t in texts:
            words = self.words(t or "")
            flat += words
            offsets.append(offsets[-1] + len(words))
            chars += len(t or "")
            if len(flat) > PACKED_WORDS or chars > size:  # a word in a list takes ten times the memory
                packed.append(pa.array(flat, pa.string()))
                flat = []
            if chars > size:
                yield self._encode(packed, offsets)
                packed, offsets, chars = [], [0], 0
        yield self._encode([*packed, pa.array(flat, pa.string())], offsets)

    def _encode(self, packed: list[pa.Array], offsets: list[int]) -> tuple[list[bytes], list[bytes]]:
        coded = pa.concat_arrays(packed).dictionary_encode()
        used = coded.dictionary.to_pylist()
        new = [w for w in used if w not in self.known]
        if len(self.known) + len(new) > MEMORY_WORDS:
            self.forget()
            new = [w for w in used if w not in self.known]
        self.learn(new)
        out = []
        for memo in (self.known, self.decoded):
            values = list(map(memo.__getitem__, used))
            if self.empty:
                at = coded.indices.to_numpy()
                out.append([b" ".join(filter(None, map(values.__getitem__, at[a:b].tolist()))) for a, b in zip(offsets, offsets[1:], strict=False)])
            else:
                taken = pa.array(values, pa.binary()).take(coded.indices)
                out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken), b" ").to_pylist())
        return out[0], out[1]


def encode_decode(docs: DataFrame, vocabulary_file: str, keys: list[str], text: str = "text", full: bool = False) -> DataFrame:
    """Encode each whole text and decode it again: the key columns, n_tokens, ids_sha256 and decoded_sha256.

    full: also ids (array of int) and decoded. Null texts are empty; an empty text has no tokens and the hash of the
    empty string; a text of any length is encoded whole. Repeated rows give repeated rows, an empty table an empty
    result. Columns beside the keys are left out; keys named like a result column raise ValueError. The vocabulary is
    read on the driver once and goes to the executors with the task; its size does not depend on the data.
    """
    if clash := set(keys) & {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}:
        raise ValueError(f"keys are named like result columns: {sorted(clash)}")
    with open(vocabulary_file, encoding="utf-8") as f:
        content = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(content)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys] + [added])
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(_runner(spec, keys, full), schema)


def _runner(spec, keys: list[str], full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(spec.value))
            done = 0
            for ids, decoded in encoder.encode(t.as_py() for t in batch.column(len(keys))):
                columns = [batch.column(i).slice(done, len(ids)) for i in range(len(keys))]
                done += len(ids)
                n = [x.count(b" ") + bool(x) for x in ids]
                columns += [pa.array(n, pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (ids, decoded))]
                names = [*keys, "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    flat = np.concatenate([np.zeros(0, np.int32), *[np.fromstring(x, np.int32, sep=" ") for x in ids if x]])
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
                give_back()

    return run
