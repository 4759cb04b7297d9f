"""Long repeated byte strings over all documents, by merging Burrows-Wheeler transforms of shards.

Wanted are all positions whose next ``length`` bytes also start somewhere else.  Sorting
every suffix of a large corpus is out of reach, and needless: most text is unique.

1. Anchors.  Of each window of ``length`` bytes the least of its first ``width`` 16-byte
   hashes is the anchor.  Equal windows have equal anchors, so a window can repeat only if the
   bytes that all windows of its anchor share (the core) occur again.  An anchor's windows
   together cover one string; if that whole string occurs again, all its windows do.  Both are
   counted by Spark over all documents; nothing is sampled.  What is left are anchors with a
   repeated core and a string of their own: edges of repeats.  They go through this step once
   more with a smaller width.
2. Transforms.  The strings left are short: some bytes, a core (one symbol), some bytes.
   Each task is a shard and builds the BWT of its strings for each bucket of cores.
3. Merge.  A bucket's shards are merged by refining an interleave: all shards in a row at
   first, then, round by round, dealt stably by the symbol before each entry.  After h rounds the
   order is right by h symbols; a place where two neighbours first come apart in round h has a
   common prefix of h - 1 symbols.  No suffix is sorted again.  Prefixes of ``length`` bytes or more
   mark repeated windows.

Cores with very many different strings (a passage shared by a third of all documents) are not
merged in one task: their windows are counted one by one by Spark, which is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .store import keyed, plain_id, stored

#: Bytes of the hashes that anchors are chosen by, and windows handled at once.
GRAM, STEP = 16, 1 << 20
#: Anchor widths of the two rounds, strings in a bucket, and strings of one core that are merged at most.
WIDTHS, BUCKET, CORE = (192, 32), 20_000, 4096
#: The table of spans is broadcast up to so many bytes in all (measured first), else joined by shuffle.
BROADCAST_BYTES = 8 << 20
ANCHOR = "id long, t long, p int, lo int, hi int, core long, f1 long, f2 long"


class Anchors(NamedTuple):
    text: np.ndarray
    p: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    core: np.ndarray
    f1: np.ndarray
    f2: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, length: int, wanted: np.ndarray | None = None) -> Iterator[Anchors]:
    """Anchor, first and last window of each run of windows with one anchor; positions in ``data``.

    ``wanted``: windows to look at (one flag a byte). Hashes: of the core, and two of the whole string.
    """
    low = K.U64((1 << 22) - 1)
    gram = min(GRAM, length - width + 1)
    for at in range(0, data.size, STEP):
        part = data[at : at + STEP + length]
        starts = np.arange(max(0, part.size - gram + 1))
        first, second = K.Spans(part), K.Spans(part, 1)
        keys = (first.hash(starts, starts + gram) & ~low) | starts.astype(K.U64)  # ties: the first
        p = (K.sliding_min(keys, width) & low).astype(np.int64)[:STEP]
        i = np.arange(p.size)
        text = np.searchsorted(offsets, i + at, "right") - 1
        ok = i + at + length <= offsets[text + 1]
        if wanted is not None:
            ok &= wanted[at : at + p.size]
        i, p, text = i[ok], p[ok], text[ok]
        if not i.size:
            continue
        new = np.ones(i.size, bool)
        new[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1]) | (i[1:] != i[:-1] + 1)
        a = np.flatnonzero(new)
        lo, hi, p, text = i[a], i[np.append(a[1:], i.size) - 1], p[a], text[a]
        core = first.hash(p, p + length - width + 1)
        yield Anchors(text, p + at, lo + at, hi + at, core.view(np.int64), first.hash(lo, hi + length).view(np.int64), second.hash(lo, hi + length).view(np.int64))


def _anchor_batches(ids, ts, data, offsets, width, length, wanted) -> Iterator[pa.RecordBatch]:
    for x in anchors(data, offsets, width, length, wanted):
        base = offsets[x.text]
        rel = [pa.array((c - base).astype(np.int32)) for c in (x.p, x.lo, x.hi)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[x.text]), pa.array(ts[x.text]), *rel, pa.array(x.core), pa.array(x.f1), pa.array(x.f2)], ["id", "t", "p", "lo", "hi", "core", "f1", "f2"])


def _all_anchors(width: int, length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(2))
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in K.pieces(offsets):
                part = offsets[lo : hi + 1]
                yield from _anchor_batches(ids[lo:hi], ts[lo:hi], data[part[0] : part[-1]], part - part[0], width, length, None)

    return rows


def _some_anchors(width: int, length: int):
    """Texts with the windows to look at (``marks``: structs lo, hi)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, (text, marks) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                m = marks.values
                edge = np.bincount(m.field("lo").to_numpy(), minlength=data.size + 1) - np.bincount(m.field("hi").to_numpy() + 1, minlength=data.size + 1)
                wanted = np.cumsum(edge[: data.size]) > 0
                yield from _anchor_batches(ids[i : i + 1], ts[i : i + 1], data, np.array([0, data.size]), width, length, wanted)

    return rows


class _Round(NamedTuple):
    full: DataFrame  # id, t, lo, hi: all these windows repeat
    strings: DataFrame  # edges with a repeated core, and one of each repeated string they may meet


def _classify(found: DataFrame, name: str) -> _Round:
    """Anchors whose string occurs again, and the strings to look at closer (each different one once)."""
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    some = stored(found.join(cores, "core"), f"{name}-cores")
    strings = some.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "t", "p", "lo", "hi")).alias("x"), F.first("core").alias("core"))
    strings = stored(strings, f"{name}-strings")
    full = some.join(strings.filter("copies > 1").select("f1", "f2"), ["f1", "f2"], "left_semi").select("id", "t", "lo", "hi")
    groups = strings.groupBy("core").agg(F.count(F.lit(1)).alias("n_strings"), F.min("copies").alias("least")).filter("n_strings > 1 AND least = 1").select("core", "n_strings")
    edges = strings.join(groups, "core").select("x.*", "core", "n_strings")
    return _Round(full, stored(edges, f"{name}-edges"))


def _with_marks(source: DataFrame, strings: DataFrame, *columns: str) -> DataFrame:
    """Texts of the strings' documents with their ``marks``; a document's marks are bounded by its length."""
    marks = strings.groupBy("id", "t").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    return source.join(marks, ["id", "t"]).select("id", "t", "text", "marks")


# The transforms.  Symbols are 16-bit: 0 ends a string, 1 to 256 are bytes, from 257 on cores.
CORE_SYMBOL = 257


def shard_bwt(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(BWT, suffix numbers in sorted order) of a few strings of symbols without 0.

    Suffixes are numbered through all strings, each with its end.  Ends of different strings differ,
    in the order of the strings.
    """
    codes = [s.astype(">u2").tobytes() + b"\0\0" for s in strings]
    order, at = [], 0
    for n, c in enumerate(codes):
        order += [(c[j:], n, at + j // 2) for j in range(0, len(c), 2)]
        at += len(c) // 2
    order.sort()
    suffixes = np.array([x[2] for x in order], np.int64)
    before = np.concatenate([np.concatenate([[0], s]) for s in strings]).astype(np.uint16)
    return before[suffixes], suffixes


def interleave(shards: list[np.ndarray], n_strings: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Merge BWTs: (shard of each entry of the merged order, symbols shared with the entry before).

    Entries of one shard keep their order.  Round h deals the entries stably by the symbol before them, so that
    entry k of the result is the suffix that begins with that symbol; blocks are entries alike in h symbols.
    """
    bwt = np.concatenate(shards)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), n_strings)
    common = np.full(bwt.size, -1, np.int64)
    block = np.zeros(bwt.size, np.int64)
    h, parts = 0, 1
    while parts < bwt.size:
        h += 1
        symbols = np.empty_like(bwt)
        symbols[np.argsort(shard, kind="stable")] = bwt  # each shard's entries where the interleave has them
        order = np.argsort(symbols, kind="stable")
        symbols, block, shard = symbols[order], block[order], shard[order]
        shard[: ends.size] = ends
        apart = np.ones(bwt.size, bool)
        apart[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        apart[: ends.size] = True
        common[apart & (common < 0)] = h - 1
        block = np.cumsum(apart) - 1
        parts = int(block[-1]) + 1
    return shard, common


def _shards(width: int, length: int, buckets: int):
    """Texts with their strings to BWTs, one for each bucket met in a batch."""
    keep = length - width + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[tuple]] = {}
            for id_, t, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for m in marks:
                    left, right = data[m["lo"] : m["p"]], data[m["p"] + keep : m["hi"] + length]
                    by.setdefault(m["core"] % buckets, []).append((m["core"], id_, t, m["lo"], m["hi"], left, right))
            for bucket, all_strings in by.items():
                for at in range(0, len(all_strings), 2000):
                    strings = all_strings[at : at + 2000]
                    cores = sorted({s[0] for s in strings})
                    number = {c: CORE_SYMBOL + n for n, c in enumerate(cores)}
                    bwt, suffixes = shard_bwt([np.concatenate([s[5].astype(np.int64) + 1, [number[s[0]]], s[6].astype(np.int64) + 1]) for s in strings])
                    digest = hashlib.blake2b(bwt.tobytes() + str(strings[0][1:4]).encode(), digest_size=8).hexdigest()
                    meta = [[s[k] for s in strings] for k in range(1, 5)] + [[len(s[5]) for s in strings], [len(s[5]) + len(s[6]) + 2 for s in strings]]
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "shard": digest, "bwt": bwt.tobytes(), "suffixes": suffixes.astype(np.int32).tobytes(), "cores": cores, "id": meta[0], "t": meta[1], "lo": meta[2], "hi": meta[3], "n_left": meta[4], "n": meta[5]}], _SHARD_SCHEMA)

    return rows


_SHARD = "bucket long, shard string, bwt binary, suffixes binary, cores array<long>, id array<long>, t array<long>, lo array<long>, hi array<long>, n_left array<long>, n array<long>"
_LONGS = pa.list_(pa.int64())
_SHARD_SCHEMA = pa.schema([("bucket", pa.int64()), ("shard", pa.string()), ("bwt", pa.binary()), ("suffixes", pa.binary()), *((c, _LONGS) for c in ("cores", "id", "t", "lo", "hi", "n_left", "n"))])


def _merge(width: int, length: int):
    keep = length - width + 1

    def fn(table: pa.Table) -> pa.Table:
        shards = sorted(table.to_pylist(), key=lambda r: r["shard"])
        cores = {c: n for n, c in enumerate(sorted({c for s in shards for c in s["cores"]}))}
        if len(cores) + CORE_SYMBOL > 1 << 16:
            raise ValueError("too many cores in a bucket")
        bwts, numbers, base = [], [], 0
        for s in shards:
            bwt = np.frombuffer(s["bwt"], np.uint16)
            renamed = np.concatenate([np.arange(CORE_SYMBOL), [CORE_SYMBOL + cores[c] for c in s["cores"]]]).astype(np.uint16)
            bwts.append(renamed[bwt])
            numbers.append(np.frombuffer(s["suffixes"], np.int32).astype(np.int64) + base)
            base += len(bwt)
        cat = lambda c: np.array([v for s in shards for v in s[c]], np.int64)
        ids, ts, lo, hi, n_left, n = map(cat, ("id", "t", "lo", "hi", "n_left", "n"))
        shard, common = interleave(bwts, [len(s["id"]) for s in shards])
        suffix = np.empty(shard.size, np.int64)
        suffix[np.argsort(shard, kind="stable")] = np.concatenate(numbers)
        starts = np.concatenate([[0], np.cumsum(n)])
        string = np.searchsorted(starts, suffix, "right") - 1
        offset = suffix - starts[string]
        to_core = n_left[string] - offset
        # Bytes shared with the neighbour before: a core among the symbols counts in full.
        shared = common + np.where((to_core >= 0) & (common > to_core), keep - 1, 0)
        longest = shared.copy()
        longest[:-1] = np.maximum(shared[:-1], shared[1:])
        window = lo[string] + offset
        hit = (to_core >= 0) & (window <= hi[string]) & (longest >= length)
        string, window = string[hit], window[hit]
        return pa.table({"id": ids[string], "t": ts[string], "lo": window.astype(np.int32), "hi": window.astype(np.int32)})

    return fn


def repeated_windows(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """(id, t, lo, hi): windows of ``length`` bytes that start at lo to hi and occur elsewhere too."""
    if not 1 <= widths[1] <= widths[0] <= length // 2:
        raise ValueError("widths must fall, from half the length at most")
    source = keyed(docs, id_col, text_col)
    found = stored(source.mapInArrow(_all_anchors(widths[0], length), ANCHOR), "anchors")
    wide = _classify(found, "wide")
    found = stored(_with_marks(source, wide.strings, "lo", "hi").mapInArrow(_some_anchors(widths[1], length), ANCHOR), "anchors")
    narrow = _classify(found, "narrow")
    out = wide.full.unionByName(narrow.full)

    usual = narrow.strings.filter(F.col("n_strings") <= CORE)
    n = usual.count()
    if n:
        buckets = -(-n // BUCKET)
        shards = _with_marks(source, usual, "p", "lo", "hi", "core").mapInArrow(_shards(widths[1], length, buckets), _SHARD)
        out = out.unionByName(shards.groupBy("bucket").applyInArrow(_merge(widths[1], length), "id long, t long, lo int, hi int"))
    hot = narrow.strings.filter(F.col("n_strings") > CORE)
    if not hot.isEmpty():
        single = stored(_with_marks(source, hot, "lo", "hi").mapInArrow(_some_anchors(1, length), ANCHOR), "windows")
        twice = single.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f1", "f2")
        out = out.unionByName(single.join(twice, ["f1", "f2"], "left_semi").select("id", "t", "lo", "hi"))
    return out


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """(id, t, spans): maximal byte runs [start, end) covered by repeated windows, for documents that have any.

    Matches never cross documents.  Texts shorter than ``length`` have none.  Rows equal in id and text
    repeat each other in full.
    """
    windows = repeated_windows(docs, length, id_col, text_col, widths)
    lists = windows.groupBy("id", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for runs in batch.column(2):
                lo, hi = runs.values.field("lo").to_numpy().astype(np.int64), runs.values.field("hi").to_numpy() + length
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                new = np.ones(lo.size, bool)
                new[1:] = lo[1:] > reach[:-1]
                a = np.flatnonzero(new)
                spans.append(np.column_stack([lo[a], reach[np.append(a[1:], lo.size) - 1]]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64()))], ["id", "t", "spans"])

    return lists.mapInArrow(rows, "id long, t long, spans array<long>")


def _whole_characters(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """``spans`` without the parts of characters at their ends."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < data.size and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return np.array([x for x in out if x[0] < x[1]], np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = (), output: str = "bytes", widths: tuple[int, int] = WIDTHS) -> DataFrame:
    """Rows of ``docs`` as (doc_id, ``more``..., n_bytes, n_removed, n_spans, kept) without their repeated spans.

    ``output``: ``bytes`` (kept is binary), ``sha256`` (its digest as hexadecimal text), or ``text`` (kept is a string; a
    character that is only partly in a span stays whole).  All occurrences go, judged on the input.  Null and empty texts
    have 0 bytes; repeated rows that are long enough lose all; no rows give none.
    """
    spans = stored(repeated_spans(docs, length, id_col, text_col, widths), "spans")
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 8 + 48), F.lit(0))).first()[0]
    joined = keyed(docs, id_col, text_col, *more).join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["id", "t"], "left")
    rows_in = joined.select("text", "spans", plain_id().alias("doc_id"), *more)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer()
                out, cut = raw, np.zeros((0, 2), np.int64)
                if spans.is_valid:
                    data = np.frombuffer(raw, np.uint8)
                    cut = spans.values.to_numpy().reshape(-1, 2)
                    if output == "text":
                        cut = _whole_characters(data, cut)
                    ends = np.concatenate([[0], cut.ravel(), [data.size]])
                    out = b"".join(data[a:b].tobytes() for a, b in ends.reshape(-1, 2))
                n_bytes.append(raw.size)
                n_removed.append(int((cut[:, 1] - cut[:, 0]).sum()))
                n_spans.append(len(cut))
                kept.append(hashlib.sha256(out).hexdigest() if output == "sha256" else bytes(out) if output == "bytes" else bytes(out).decode())
            rest = batch.drop_columns(["text", "spans"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary() if output == "bytes" else pa.string())], [*rest.schema.names, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows_in.schema.fields[2:])
    return rows_in.mapInArrow(rows, f"{schema}, n_bytes long, n_removed long, n_spans long, kept {'binary' if output == 'bytes' else 'string'}")
