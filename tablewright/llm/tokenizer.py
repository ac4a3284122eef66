"""Byte-level BPE over Arrow batches with a public rank file.

A text is cut by the vocabulary's pattern. Each distinct pre-token of a batch is looked up whole through a minimal
perfect hash of the vocabulary; a pre-token that isn't in it is merged byte by byte, with a heap of candidate merges over
a doubly linked list. The rank file is read once on the driver; its size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "TABLEWRIGHT_TOKENIZERS"
DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that cuts text into pre-tokens for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in slices of about so many characters, which bounds the memory of a batch.
SLICE_CHARS = 4_000_000

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + d.astype(np.uint64) * _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Minimal perfect hash by displacement: a key's bucket gives the displacement that sends it to its own slot; a
    bucket of one key holds the slot itself, as -slot-1."""

    shift: np.ndarray
    ids: np.ndarray
    prints: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(h)) < n:
            raise ValueError("two keys of the vocabulary hash alike")
        n_buckets = max(1, n // 4)
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        shift, ids, taken = np.zeros(n_buckets, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        tries = np.arange(1, 65)
        single = []
        for b in np.argsort(-np.diff(starts), kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                single += [(b, m) for m in members]
                continue
            base = 0
            while True:
                slots = (_mix(h[members][None, :], (tries + base)[:, None]) % np.uint64(n)).astype(np.int64)
                free = ~taken[slots].any(1)
                good = next((t for t in np.flatnonzero(free) if len(set(slots[t])) == len(members)), None)
                if good is not None:
                    break
                base += len(tries)
            shift[b] = tries[good] + base
            taken[slots[good]] = True
            ids[slots[good]] = members
        for (b, m), slot in zip(single, np.flatnonzero(~taken)):
            shift[b], ids[slot] = -slot - 1, m
        return cls(shift, ids, h[ids])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The id that each key must have if it is in the vocabulary, -1 if its fingerprint isn't."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        d = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, (_mix(h, np.maximum(d, 0)) % np.uint64(len(self.ids))).astype(np.int64))
        return np.where(self.prints[slot] == h, self.ids[slot], -1)


class Vocabulary:
    """Tokens by id, their perfect hash, and the encoder."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens, self.pattern, self.hash = tokens, pattern, PerfectHash.build(tokens)
        self._ready = False

    @classmethod
    def from_ranks(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError(f"{path}: ranks must run from 0 without gaps")
        return cls(tokens, pattern)

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "hash": self.hash, "_ready": False}

    def _prepare(self) -> None:
        if not self._ready:
            self.rank = {t: i for i, t in enumerate(self.tokens)}
            self.cut = regex.compile(self.pattern).findall
            self.lengths = np.fromiter(map(len, self.tokens), np.int32, len(self.tokens))
            self._ready = True

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge bytes in order of rank, leftmost first among equals."""
        rank, n = self.rank, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens: tier one by perfect hash, tier two by merging."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        tokens = self.tokens
        return {p: (int(i),) if i >= 0 and tokens[i] == b else self.merge(b) for p, b, i in zip(pieces, raw, self.hash.find(raw))} if raw else {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty or null text has none."""
        self._prepare()
        out: list[list[int]] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < SLICE_CHARS):
                size += len(texts[j] or "")
                j += 1
            cut = [self.cut(t) if t else () for t in texts[i:j]]
            ids = self.resolve(list(set(chain.from_iterable(cut))))
            out += [list(chain.from_iterable(map(ids.__getitem__, c))) for c in cut]
            i = j
        return out


def default_vocabulary(name: str = "byte_bpe_50k") -> Vocabulary:
    """The rank file `name`.tiktoken in the folder of the environment variable TABLEWRIGHT_TOKENIZERS, else in
    /opt/tokenizers."""
    return Vocabulary.from_ranks(os.path.join(os.environ.get(TOKENIZER_DIR, DEFAULT_DIR), f"{name}.tiktoken"))


def _offsets(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)


def encode_column(spark, vocabulary: Vocabulary):
    """An Arrow UDF from text to array<int>: ids without special tokens, an empty array for empty or null text."""
    held = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.value
        for batch in batches:
            ids = v.encode_batch(batch.to_pylist())
            yield pa.ListArray.from_arrays(_offsets(ids), np.fromiter(chain.from_iterable(ids), np.int32))

    return F.arrow_udf(encode, "array<int>")


def count_column(spark, vocabulary: Vocabulary):
    """An Arrow UDF from text to its number of tokens, 0 for empty or null text."""
    held = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.value
        for batch in batches:
            yield pa.array(np.fromiter(map(len, v.encode_batch(batch.to_pylist())), np.int32, len(batch)))

    return F.arrow_udf(count, "int")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer tasks than the cluster has cores is spread out before costly work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def encode_documents(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, ids), one row for each row of docs; other columns are left out."""
    use = encode_column(docs.sparkSession, vocabulary)
    return spread(docs.select(F.col(key), F.col(text).alias("_text"))).select(key, use("_text").alias("ids"))


def count_tokens(docs: DataFrame, key: str, text: str | Column, vocabulary: Vocabulary) -> DataFrame:
    """(key, n_tokens), one row for each row of docs."""
    use = count_column(docs.sparkSession, vocabulary)
    column = F.col(text) if isinstance(text, str) else text
    return spread(docs.select(F.col(key), column.alias("_text"))).select(key, use("_text").alias("n_tokens"))
