"""Byte-level BPE with a queue of merge ranks.

Candidate merges wait in one bucket per rank; a bucket holds the positions (in a
linked list of parts) where that merge is possible.  A bitmap of three levels, 64 ways
each, says which buckets are in use: the next rank is found by three find-first-set
steps.  An entry whose pair has changed meanwhile is stale and skipped.  A pre-token
of n bytes takes O(n log n), so very long ones are no trouble.

Short pre-tokens go through one queue together: their bytes lie in one array, and a
bucket is worked off as an array, one merge (the leftmost) for each pre-token in it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import PreTokenCoder, WordCoder

#: Pre-tokens of so many bytes or fewer share a queue.
SHORT = 64


class RankBitmap:
    """Set of ranks with find-first."""

    def __init__(self, size: int):
        self.low, self.mid, self.top = [0] * (size // 64 + 1), [0] * (size // 4096 + 1), 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def remove(self, rank: int) -> None:
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))

    def first(self) -> int:
        """The least rank, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


class RankQueue:
    """Encoder for one table of ranks (token bytes -> id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bitmap = RankBitmap(max(ranks.values()) + 1)

    def encode(self, token: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, bitmap, n = self.ranks, self.bitmap, len(token)
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))  # a part is named by its first byte
        pair = [-1] * (n + 1)  # rank of merging a part with the next
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            rank = ranks.get(token[i : i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap
                else:
                    buckets[rank] = [i]
                    bitmap.add(rank)
        while (rank := bitmap.first()) >= 0:
            bucket = buckets[rank]
            i = heappop(bucket)  # the leftmost of equal rank
            if not bucket:
                del buckets[rank]
                bitmap.remove(rank)
            if pair[i] != rank:
                continue
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            pair[gone] = -1
            for p in (before[i], i):
                if p < 0:
                    continue
                stop = end if p != i else (after[end] if end < n else -1)
                new = ranks.get(token[p:stop]) if 0 < stop - p <= self.longest else None
                pair[p] = -1 if new is None else new
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], p)
                    else:
                        buckets[new] = [p]
                        bitmap.add(new)
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : after[i]]])
            i = after[i]
        return out


class SharedQueue:
    """Encoder of many short pre-tokens at once; the same merges in the same order within each."""

    def __init__(self, ranks: dict[bytes, int]):
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ids must be 0 to n - 1")
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.merged = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], -1)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bitmap = RankBitmap(len(ranks))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging two ids, -1 if there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """Ids (unsigned 32-bit) of each pre-token."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.array([len(t) for t in tokens], np.int64)
        n, ends = data.size, np.cumsum(sizes)
        owner = np.repeat(np.arange(len(tokens)), sizes)
        ids = np.append(self.of_byte[data], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # a part is named by its first byte; n is no part
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = -1
        pair = np.full(n + 1, -1, np.int64)
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = self.bitmap

        def push(rank: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, a, b in zip(rank[np.append(0, cut)].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(rank)]):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    bitmap.add(r)

        def renew(at: np.ndarray) -> None:
            rank = self._ranks(ids[at], ids[after[at]])
            pair[at] = rank
            some = rank >= 0
            if some.any():
                push(rank[some], at[some])

        renew(np.flatnonzero(after[:n] < n))
        while (r := bitmap.first()) >= 0:
            parts = buckets.pop(r)
            bitmap.remove(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[pair[at] == r]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                first = np.ones(len(at), bool)
                first[1:] = owner[at[1:]] != owner[at[:-1]]
                if not first.all():
                    buckets[r] = [at[~first]]
                    bitmap.add(r)
                    at = at[first]
            if not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            ids[at], after[at], pair[gone], pair[at] = r, rest, -1, -1
            ids[gone] = -1
            inside = rest < n
            before[rest[inside]] = at[inside]
            left = before[at]
            renew(np.concatenate([at[inside], left[left >= 0]]))
        live = ids[:n] >= 0
        blob = ids[:n][live].astype("<u4").tobytes()
        at = (np.concatenate([[0], np.cumsum(np.bincount(owner[live], minlength=len(tokens)))]) * 4).tolist()
        return [blob[a:b] for a, b in zip(at, at[1:])]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its id, line by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[WordCoder, list[bytes], list[bytes]]:
    """Encoder of texts, bytes of each id, decimal digits of each id; one for each Python worker."""
    ranks = read_ranks(path)
    queue, shared = RankQueue(ranks), SharedQueue(ranks)

    def encode(tokens: list[str]) -> list[bytes]:
        coded = [t.encode() for t in tokens]
        short = [i for i, t in enumerate(coded) if len(t) <= SHORT]
        out = [b""] * len(coded)
        for i, ids in zip(short, shared.encode([coded[i] for i in short]), strict=True):
            out[i] = ids
        for i, t in enumerate(coded):
            if len(t) > SHORT:
                out[i] = array("I", queue.encode(t)).tobytes()
        return out

    size = max(ranks.values()) + 1
    table = [b""] * size
    for token, i in ranks.items():
        table[i] = token
    return WordCoder(PreTokenCoder(encode, pattern)), table, [b"%d" % i for i in range(size)]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row: each match of ``pattern`` by itself, no special tokens.

    Null and empty texts have no ids; repeated rows give repeated rows, an empty table none.
    ``pattern`` must cut at spaces as the GPT-2 pattern does (see ``tokens``).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)[0]
        for batch in batches:
            for lo, hi, ids, offsets in coder.column(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "ids"])

    source = _source(docs, id_col, text_col)
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_bpe(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the bytes that the ids of each row stand for; null ids are none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _coder(ranks_path, pattern)[1]
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(rows, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256) for each row.

    ids_sha256: of the decimal ids joined by one space.  The decoded bytes come from the ids alone.
    A null text is empty and has no ids; repeated rows give repeated rows, null ids stay, an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table, digits = _coder(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, _, all_ids, offsets in coder.column(batch.column(1)):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    ids = all_ids[a:b].tolist()
                    n.append(b - a)
                    ids_sha.append(hashlib.sha256(b" ".join(map(digits.__getitem__, ids))).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = _source(docs, id_col, text_col)
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
