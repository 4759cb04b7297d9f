import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskspark.llm import best_fit as B, rank_queue as Q, store, token_files as T, tokens
from riskspark.llm.queries import QUERIES

from .cases import documents, empty, odd_texts, thue_morse

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def mixed_texts():
    rng = random.Random(1)
    letters = "ab \n\t'sé 1,.　 日\r\x1c\x85<|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000, " " * 900, "\n" * 300, "don't we'll 'tis", "<|endoftext|>"] + look_alikes() + MARKED


MARKED = ["a <|endoftext|> b", "x<|endoftext|><|endoftext|>y", "<|endoftext|", " <|endoftext|>\n\n<|endoftext|> <|endo", "!!<|endoftext|>'s"]


def look_alikes():
    """Long words of equal polynomial hash, apart and in one text."""
    out = []
    for n in (512, 1024, 2048, 4096):
        x, y = thue_morse(n)
        out += [f"x {x} {y} y", f"{y}\n{x}", f"one {x}", f"one {y}"]
    return out


def test_rank_queue_equals_library(tik):
    coder, table, _ = Q._coder(RANKS, P.PATTERN)
    texts = mixed_texts()
    for text, blob in zip(texts, coder.texts(texts), strict=True):
        ids = blob.tolist()
        assert ids == tik.encode_ordinary(text), text
        assert b"".join(table[i] for i in ids) == text.encode()


def test_pieces_with_one_hash_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(tokens.K.Spans, "_by_blocks", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(tokens.K, "LONG", 1 << 30)  # as if no block were mixed: the batch goes by its bytes
    coder = tokens.WordCoder(lambda words: [np.array(library(w), "<u4").tobytes() for w in words])
    flat = lambda self, starts, ends: (ends - starts).astype(np.uint64) if self.which == 0 else self.exact(starts, ends)
    init, exact = tokens.K.Spans.__init__, tokens.K.Spans.hash

    def marked(self, data, which=0):
        init(self, data, which)
        self.which = which

    monkeypatch.setattr(tokens.K.Spans, "__init__", marked)
    monkeypatch.setattr(tokens.K.Spans, "exact", exact, raising=False)
    monkeypatch.setattr(tokens.K.Spans, "hash", flat)
    texts = ["one two six", "ten two", "six one ten"]
    assert [b.tolist() for b in coder.texts(texts)] == [library(t) for t in texts]


def test_rank_queue_on_very_long_pre_tokens(tik):
    queue = Q.RankQueue(Q.read_ranks(RANKS))
    rng = random.Random(2)
    for token in ["x" * 40_000, "".join(rng.choice("etaoin") for _ in range(30_000)), "=" * 20_001]:
        assert queue.encode(token.encode()) == tik.encode_ordinary(token)


def test_bitmap_finds_the_first():
    m, kept, rng = Q.RankBitmap(50_256), set(), random.Random(4)
    for _ in range(3000):
        r = rng.randrange(50_256)
        (m.remove if r in kept else m.add)(r)
        kept ^= {r}
        assert m.first() == min(kept, default=-1)


def test_library_coder(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 40)
    monkeypatch.setattr(tokens, "PART_BYTES", 300)
    coder = tokens.library_coder(JSON, P.PATTERN)
    texts = mixed_texts()
    for text, blob in zip(texts, coder.texts(texts), strict=True):
        assert blob.tolist() == library(text), text


def test_bpe_round_trip(spark, tik):
    rows = odd_texts()
    encoded = Q.encode_bpe(documents(spark, rows), RANKS, P.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == Counter((i, tuple(tik.encode_ordinary(t or ""))) for i, t in rows)
    decoded = Counter((r.doc_id, bytes(r.bytes)) for r in Q.decode_bpe(encoded, RANKS, P.PATTERN).collect())
    assert decoded == Counter((i, (t or "").encode()) for i, t in rows)
    assert Q.bpe_digests(empty(spark), RANKS, P.PATTERN).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, library, tmp_path):
    rows = odd_texts()
    path = str(tmp_path / "tokens")
    T.write_tokens(documents(spark, rows), path, JSON, P.PATTERN, 2, files=3, page_rows=2)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in T.token_digests(spark, path).collect())
    assert Counter((i, n, c) for i, _, n, c in got) == Counter(((i is not None, i or 0), len(library(t)) + 1, crc(library(t) + [2])) for i, t in rows)
    start = 0
    for _, at, n, _ in sorted(got, key=lambda x: (x[0], x[1])):
        assert at == start
        start += n
    files = [f for f in sorted((tmp_path / "tokens").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows]
    for f in files:
        columns = {c["path_in_schema"]: c for c in (pq.ParquetFile(f).metadata.row_group(0).column(k).to_dict() for k in range(5))}
        assert "RLE_DICTIONARY" in columns["tokens.list.element"]["encodings"]
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"]["encodings"]
        meta = pq.ParquetFile(f).metadata.row_group(0).column(1)
        assert meta.has_offset_index and meta.has_column_index
    plan = T.read_tokens(spark, path).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_tokens:bigint>" in plan
    with pytest.raises(ValueError):
        T.write_options("plain", 1, 1)


def test_delta_coded_tokens(spark, tmp_path):
    path = str(tmp_path / "tokens")
    T.write_tokens(documents(spark, [(1, "some words"), (2, "more words")]), path, JSON, P.PATTERN, encoding="delta", files=1)
    f = next((tmp_path / "tokens").glob("*.parquet"))
    found = [pq.ParquetFile(f).metadata.row_group(0).column(k) for k in range(5)]
    assert next(c for c in found if c.path_in_schema == "tokens.list.element").encodings.count("DELTA_BINARY_PACKED")


def test_token_files_without_rows(spark, tmp_path):
    T.write_tokens(empty(spark), str(tmp_path / "none"), JSON, P.PATTERN)
    assert T.token_digests(spark, str(tmp_path / "none")).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {bins[b]: b for b in range(len(bins)) if bins[b] + items[i] <= capacity}.values():
            bins[b] += items[i]
            go(i + 1, bins)
            bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_packing_is_right():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.randint(6, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        histogram = Counter(items)
        fixed, left = B.reduce_instance(dict(histogram), capacity)
        rest = [s for s, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        bins = B.pack_histogram(dict(histogram), capacity)
        assert Counter(x for s, t in bins for x in s for _ in range(t)) == histogram
        assert all(sum(s) <= capacity for s, _ in bins)
    assert B.pack_histogram({}, 5) == []
    with pytest.raises(ValueError):
        B.pack_histogram({6: 1}, 5)


def check_packing(rows, ids_of, capacity):
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by, bins


def test_pack_documents(spark, library):
    rows = odd_texts()
    got = B.pack_documents(documents(spark, rows), JSON, P.PATTERN, 128, 0).collect()
    by, bins = check_packing(got, library, 128)
    want = Counter()
    for i, t in rows:
        ids = library(t) + [0]
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 128) + 2
    assert B.pack_documents(empty(spark), JSON, P.PATTERN, 128, 0).count() == 0


def test_registered_packing(spark, sf, library):
    got = QUERIES["op6_best_fit_packing"](spark, sf).collect()
    _, bins = check_packing(got, library, 2048)
    assert len(bins) <= 1.03 * sum(r.length for r in got) / 2048 + 1
    assert store.parallelism(spark) > 0
