"""Byte-level BPE of whole corpora with a public rank file, in numpy.

A batch's distinct pieces go into padded matrices of one length bucket each. In every round each row looks up all its
neighbouring pairs in an open-addressing hash table, merges its minimum-rank pair, leftmost first, and closes the gaps;
rows without a merge leave the matrix. Where every other place of the same minimum pair stays the minimum whatever
happens at the first one, those places merge in the same round; otherwise only the leftmost does.

Defined results: null and empty texts give an empty list; lone surrogates cannot occur in Spark strings; a text of any
length is encoded whole; rows are independent, so repeats come out as often as they go in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.bounded import spread

#: Fixed value: the pattern that cuts text into pieces before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
CACHED_PIECES = 200_000
CELLS = 4_000_000


def default_ranks() -> str:
    """Place of the 50k byte-level rank file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Bytes from which a piece is a row of its own.
LONG_PIECE = 4096


class PairTable:
    """Hash of (left id, right id) -> merged id; a pair's rank is its merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64(2**bits - 1)
        self.keys = np.full(2**bits, np.uint64(2**64 - 1))
        self.values = np.full(2**bits, NO_RANK, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # all keys that find their slot free and come first there settle; the rest probe on
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NO_RANK where there is none or either side is padding (negative)."""
        out = np.full(left.shape, NO_RANK, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.uint64) << np.uint64(32)) | right[at].astype(np.uint64)
        slot, found, todo = self._slot(keys), np.full(len(keys), NO_RANK, np.int32), np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            found[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        out[at] = found
        return out


class Encoder:
    """Encodes lists of texts; one per Python worker and rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, np.ndarray] = {}

    def _merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """The final ids of the rows of a matrix padded with -1."""
        out: list[np.ndarray | None] = [None] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.ranks_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            least = ranks.min(axis=1)
            done = least == NO_RANK
            if done.any():
                for r, row in zip(rows[done], ids[done]):
                    out[r] = row[row >= 0]
                ids, rows, ranks, least = ids[~done], rows[~done], ranks[~done], least[~done]
                if not len(rows):
                    break
            width = ranks.shape[1]
            hit = ranks == least[:, None]
            # of a run of overlapping places every second one counts, from its start
            place = np.arange(width)[None, :]
            start = np.maximum.accumulate(np.where(hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1], place, -1), axis=1)
            hit &= (place - start) % 2 == 0
            several = hit.sum(axis=1) > 1
            if several.any():
                h = hit[several]
                i = np.nonzero(h)
                row, t = ids[several], least[several][i[0]].astype(np.int32)
                padded = np.pad(row, ((0, 0), (1, 1)), constant_values=-1)
                before, after = padded[i[0], i[1]], padded[i[0], i[1] + 3]
                lower = np.minimum.reduce([self.pairs.ranks_of(a, b) for a, b in ((before, t), (t, after), (t, t))]) < t
                unsafe = np.zeros(len(row), bool)
                unsafe[i[0][lower]] = True
                only = np.nonzero(several)[0][unsafe]
                first = hit[only].argmax(axis=1)
                hit[only] = False
                hit[only, first] = True
            ids = ids.copy()
            ids[:, :-1][hit] = np.broadcast_to(least[:, None], hit.shape)[hit]
            keep = np.ones(ids.shape, bool)
            keep[:, 1:] = ~hit
            keep &= ids >= 0
            lengths = keep.sum(axis=1)
            packed = np.full((len(ids), int(lengths.max())), -1, np.int32)
            packed[np.arange(packed.shape[1])[None, :] < lengths[:, None]] = ids[keep]
            ids = packed
            if ids.shape[1] < 2:
                for r, row in zip(rows, ids):
                    out[r] = row[row >= 0]
                break
            ranks = self.pairs.ranks_of(ids[:, :-1], ids[:, 1:])
        return out  # type: ignore[return-value]

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The final ids of one long row: the same rounds over a linked row, where only pairs next to a merge are looked up again.

        All places of the minimum pair merge up to and with the first whose merge makes a pair of lower rank.
        """
        ids = ids.astype(np.int32)
        while True:
            n = len(ids)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            ranks, alive = np.full(n, NO_RANK, np.int32), n
            ranks[:-1] = self.pairs.ranks_of(ids[:-1], ids[1:])
            at = lambda i: np.where((i >= 0) & (i < n), ids[np.clip(i, 0, n - 1)], -1)
            while True:
                least = ranks.min()
                if least == NO_RANK:
                    return ids[ids >= 0]
                hit = np.flatnonzero(ranks == least)
                if len(hit) > 1:
                    # of a run of overlapping places every second one counts, from its start
                    place = np.arange(len(hit))
                    fresh = np.r_[True, after[hit[:-1]] != hit[1:]]
                    hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
                t = np.full(len(hit), least, np.int32)
                lower = np.minimum.reduce([self.pairs.ranks_of(a, b) for a, b in ((at(before[hit]), t), (t, at(after[np.clip(after[hit], 0, n - 1)])), (t, t))]) < least
                if lower.any():
                    hit = hit[: int(lower.argmax()) + 1]
                right = after[hit]
                then = after[right]
                ids[hit], ids[right], ranks[right] = least, -1, NO_RANK
                after[hit] = then
                inside = then < n
                before[then[inside]] = hit[inside]
                touched = np.unique(np.concatenate([hit, before[hit][before[hit] >= 0]]))
                ranks[touched] = self.pairs.ranks_of(ids[touched], at(after[touched]))
                alive -= len(hit)
                if alive < 0.7 * n:
                    break
            ids = ids[ids >= 0]
            if len(ids) < 2:
                return ids

    def pieces(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """Ids of distinct pieces."""
        out, buckets = {}, {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            one = self.whole.get(raw)
            if one is not None:
                out[p] = np.array([one], np.int32)
            elif len(raw) == 1:
                out[p] = self.bytes[[raw[0]]]
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for bits, bucket in sorted(buckets.items()):
            if 2**bits > LONG_PIECE:
                out.update((p, self._merge_long(self.bytes[np.frombuffer(raw, np.uint8)])) for p, raw in bucket)
                continue
            step = max(1, CELLS // max(len(raw) for _, raw in bucket))
            for at in range(0, len(bucket), step):
                part = bucket[at : at + step]
                lengths = np.array([len(raw) for _, raw in part])
                ids = np.full((len(part), int(lengths.max())), -1, np.int32)
                ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                out.update(zip((p for p, _ in part), self._merge(ids)))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, empty for null and empty ones."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        new = {p for parts in cut for p in parts if p not in self.cache}
        known = self.pieces(sorted(new))
        none = np.zeros(0, np.int32)
        cache = self.cache
        out = [np.concatenate([known[p] if p in known else cache[p] for p in parts]) if parts else none for parts in cut]
        if len(cache) + len(known) > CACHED_PIECES:
            cache.clear()
        cache.update((p, v) for p, v in known.items() if len(p) <= 64)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file."""
    return Encoder(path)


def encoded(df: DataFrame, key: str, text: str, ranks: str, batch_chars: int = 2_000_000) -> DataFrame:
    """(key, ids array<int>) of every row; texts reach the encoder in groups of about `batch_chars` characters."""
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < batch_chars:
                    chars += len(texts[end] or "")
                    end += 1
                ids = enc.encode(texts[at:end])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])
                at = end

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(run, schema).withColumnRenamed("key", key)


def counted(df: DataFrame, key: str, text: str, ranks: str) -> DataFrame:
    """(key, n_tokens) of every row."""
    return encoded(df, key, text, ranks).select(key, F.size("ids").alias("n_tokens"))
