"""Similarity join of word-shingle sets by parity sketches.

A document's set is summed up in a sketch of K words: every shingle's 64-bit hash is XORed
into one of them.  Where two sets differ in s shingles, their sketches differ in at most s
words.  A Jaccard similarity of at least p/q bounds s by d = (q - p)(|A| + |B|) / (q + p),
so of d + 1 words one at least is equal in both: words are the keys of the join.  A second,
smaller sketch has one bit flipped by each shingle; its Hamming distance is at most s too.

* Size bands.  The number of words K follows the largest size of a band.  A document
  enters the sketch of its own band and of those bands whose sizes it may still be similar to.
* Spare words.  K = d + 1 + r, so a similar pair has r + 1 equal words.  Words of at most one
  shingle say little and many documents share them; a document leaves them out if they are r at most.
  What is left of r then goes to words that many nodes have (of a common passage, say): a
  document leaves all of these out too if r suffices.  Both are properties of a word, alike for all
  documents that have it, so a pair loses r equal words at most and is still found.
* Copies.  Equal sets are one node.
* Groups.  A key's nodes are first compared with the smallest of them only, which joins a
  group of near copies in linear work; a key of two nodes (most are) is done with that and is not
  looked at again.  The others are compared with their second smallest node.  Then only pairs of different
  components are left, in groups that frequent words have been taken from.  Small groups give them by a join;
  large ones are laid out in blocks, which give only pairs that pass the first two checks, and each
  pair only in the first of the groups that both documents are in.
* Every pair is checked three times: sizes, Hamming distance of the bit sketches, and at
  last the shingle sets themselves, made again from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .graph import components
from .store import keep_keys, keyed, plain_id, small, stored

#: A word is frequent if more nodes than this have it; members of a group that are compared in one block.
SMALL_GROUP, BLOCK = 32, 1024
SEED = K.U64(0x5851F42D4C957F2D)


class Bands:
    """Size bands and the sketch of each, for a similarity of p / q."""

    def __init__(self, p: int, q: int, ratio: float = 1.4):
        self.p, self.q = p, q
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * ratio))))
        self.edges = np.array(edges, np.int64)

    def apart(self, sizes):
        """The most that similar sets of ``sizes`` (together) can differ."""
        return (self.q - self.p) * sizes // (self.q + self.p)

    def of(self, n: int) -> range:
        """The bands a set of ``n`` shingles enters; the first is its own."""
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        last = own
        while self.q * n >= self.p * int(self.edges[last + 1]):
            last += 1
        return range(own, last + 1)

    def shape(self, band: int) -> tuple[int, int]:
        """(words, spare words) of the band's sketch."""
        d = int(self.apart(2 * (int(self.edges[band + 1]) - 1)))
        spare = -(-16 * (d + 1) // 100) if d >= 6 else 0
        return d + 1 + spare, spare


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The set of ``k``-word shingles of each text, as sorted hashes; with fewer words, one for all words."""
    lower = K.LOWER[data]
    starts, ends, text = K.words(lower, offsets)
    values = K.Spans(lower).hash(starts, ends)
    h, at = K.windows(values, text, k)
    n = offsets.size - 1
    first_word = np.searchsorted(text, np.arange(n + 1))
    first = np.searchsorted(at, first_word)
    for i in range(n):
        a, b = first_word[i], first_word[i + 1]
        if b - a >= k:
            yield np.unique(h[first[i] : first[i + 1]])
        elif b > a:
            yield K.windows(values[a:b], np.zeros(b - a, np.int64), int(b - a))[0]
        else:
            yield np.zeros(0, K.U64)


def sketch(tokens: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``words`` XORs of hashes, tokens in each, one bit a token in ``words`` bytes)."""
    m = K.mix(tokens ^ SEED)
    at = ((m >> K.U64(32)) * K.U64(words) >> K.U64(32)).astype(np.int64)
    xor = np.zeros(words, K.U64)
    np.bitwise_xor.at(xor, at, K.mix(m + SEED))
    bit = (m & K.U64(0xFFFFFFFF)) * K.U64(8 * words) >> K.U64(32)
    parity = np.bincount(bit.astype(np.int64), minlength=8 * words) & 1
    return xor, np.bincount(at, minlength=words), np.packbits(parity.astype(np.uint8))


def low_words(counts: np.ndarray, spare: int) -> int:
    """Words of so few tokens or fewer are left out as keys (-1: none are)."""
    return next((most for most in (1, 0) if np.count_nonzero(counts <= most) <= spare), -1) if spare else -1


def _sketches(k: int, bands: Bands):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "t", "node", "check", "n", "own", "band", "free", "keys", "bits"]
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(2))
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in K.pieces(offsets, K.PART_BYTES):
                part = offsets[lo : hi + 1]
                out: list[list] = [[] for _ in names]
                for i, u in enumerate(shingles(data[part[0] : part[-1]], part - part[0], k)):
                    n = len(u)
                    node, check = np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), np.int64)
                    for band in bands.of(n) if n else (-1,):
                        own = not n or band == bands.of(n)[0]
                        keys, free, bits = np.zeros(0, K.U64), 0, b""
                        if n:
                            size, spare = bands.shape(band)
                            words, counts, parity = sketch(u, size)
                            skip = low_words(counts, spare)
                            free = spare - int(np.count_nonzero(counts <= 1)) if skip == 1 else 0
                            place = K.mix(np.arange(size, dtype=K.U64) + K.U64(band << 40))
                            keys, bits = K.mix(words ^ place)[counts > skip], parity.tobytes()
                        for c, v in zip(out, (ids[lo + i], ts[lo + i], node, check, n, own, band, free, keys.view(np.int64), bits), strict=True):
                            c.append(v)
                types = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return rows


def _near(bands: Bands):
    """Pairs (a, b, n_a, bits_a, n_b, bits_b): keep those that sizes and bit sketches allow."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = bands.q * np.minimum(n_a, n_b) >= bands.p * np.maximum(n_a, n_b)
            if batch.num_rows:
                (x, at), (y, _) = K.text_bytes(batch.column(3)), K.text_bytes(batch.column(5))
                running = np.zeros(x.size + 1, np.int64)
                np.cumsum(np.bitwise_count(x ^ y), out=running[1:])
                ok &= running[at[1:]] - running[at[:-1]] <= bands.apart(n_a + n_b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return rows


def _block_pairs(bands: Bands):
    """Two blocks of one group: pairs of different components that sizes and bit sketches allow, but for those that meet in an earlier group too."""

    def fn(table: pa.Table) -> pa.Table:
        pivot = table.column("pivot")[0].as_py()
        earlier = [frozenset(q for q in p if q < pivot) for p in table.column("pivots").to_pylist()]
        node, label, n, block = (table.column(c).to_numpy() for c in ("node", "label", "n", "block"))
        bits, _ = K.text_bytes(table.column("bits"))
        bits = bits.reshape(len(node), -1) if len(node) else bits
        width = -bits.shape[1] % 8
        words = np.pad(bits, ((0, 0), (0, width))).view(K.U64)
        _, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
        rare = inverse != count.argmax()  # of two different components one at least is not the largest
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        every = np.arange(len(node))
        out_a, out_b = [], []
        for i in np.flatnonzero(rare):
            right = every if same else np.flatnonzero(block != block[i])
            apart = np.bitwise_count(words[i] ^ words[right]).sum(1, dtype=np.int64)
            ok = (label[right] != label[i]) & (apart <= bands.apart(n[i] + n[right])) & (bands.q * np.minimum(n[i], n[right]) >= bands.p * np.maximum(n[i], n[right]))
            mine = earlier[i]
            hit = np.array([h for h in right[ok].tolist() if mine.isdisjoint(earlier[h])], np.int64)
            out_a.append(np.minimum(node[i], node[hit]))
            out_b.append(np.maximum(node[i], node[hit]))
        return pa.table({"a": np.concatenate(out_a) if out_a else np.zeros(0, np.int64), "b": np.concatenate(out_b) if out_b else np.zeros(0, np.int64)})

    return fn


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, node, band) in; out (key, band, node, pivot) of keys with two nodes or more, pivot the first. Equal rows are one."""
    pivot = last = None  # first and last row of the run that the batch before ended with: (key, node, band)
    for batch in batches:
        key, node, band = (batch.column(c).to_numpy() for c in range(3))
        told = 0  # rows put in front: the run's first, and its last if it is out already
        if pivot is not None:
            front = [pivot] if last == pivot else [pivot, last]
            told = len(front)
            key, node, band = (np.concatenate([np.array([r[i] for r in front], x.dtype), x]) for i, x in enumerate((key, node, band)))
        if not key.size:
            continue
        keep = np.ones(key.size, bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        at = np.flatnonzero(keep)
        key, node, band = key[at], node[at], band[at]
        new = np.ones(key.size, bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        emit = np.bincount(run)[run] > 1
        if told == 2:
            emit[:2] = False
        first = node[starts][run]
        yield pa.RecordBatch.from_arrays([pa.array(key[emit]), pa.array(band[emit]), pa.array(node[emit]), pa.array(first[emit])], ["key", "band", "node", "pivot"])
        pivot = (int(key[starts[-1]]), int(node[starts[-1]]), int(band[starts[-1]]))
        last = (int(key[-1]), int(node[-1]), int(band[-1]))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_pivots`` in; out (pivot, band, node, key, other, nth) of all nodes but the pivots, nth from 0 within the key.

    ``other`` is the first of a key's rows; key, other and nth are null if the key has just one, as its only pair is (pivot, node).
    """
    rows = np.zeros((0, 4), np.int64)  # the last row waits for the next, which may be of its key
    run = None  # (key, other, nth) of the row before
    for batch in chain(batches, (None,)):
        if batch is not None:
            more = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            rows = np.concatenate([rows, more[more[:, 2] != more[:, 3]]])
        n = len(rows) - (batch is not None)
        if n <= 0:
            continue
        key, band, node, pivot = rows.T
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        other, nth = node[starts][of], np.arange(len(rows)) - starts[of]
        lone = new & np.append(new[1:], True)
        if run is not None and run[0] == key[0]:
            other[of == 0], lone[0] = run[1], False
            nth[of == 0] += run[2] + 1
        first = [pa.array(pivot[:n]), pa.array(band[:n].astype(np.int32)), pa.array(node[:n])]
        yield pa.RecordBatch.from_arrays([*first, *(pa.array(x[:n], mask=lone[:n]) for x in (key, other, nth))], ["pivot", "band", "node", "key", "other", "nth"])
        run, rows = (int(key[n - 1]), int(other[n - 1]), int(nth[n - 1])), rows[n:]


def _sets(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for lo, hi in K.pieces(offsets, K.PART_BYTES):
                part = offsets[lo : hi + 1]
                sets = [u.tobytes() for u in shingles(data[part[0] : part[-1]], part - part[0], k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["node", "set"])

    return rows


def _links(p: int, q: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), K.U64), np.frombuffer(y.as_buffer(), K.U64)
                both = np.sort(np.concatenate([a, b]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = q * same >= p * (len(a) + len(b) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return rows


def _groups(keys: DataFrame) -> DataFrame:
    """``_members`` of the keys that several nodes share; pivot is the smallest of them.  One shuffle, read as a sorted stream."""
    dealt = keys.select("key", "node", "band").repartition("key").sortWithinPartitions("key", "node")
    return stored(dealt.mapInArrow(lambda batches: _members(_pivots(batches)), "pivot long, band int, node long, key long, other long, nth long"), "groups")


class _Join:
    def __init__(self, docs: DataFrame, k: int, p: int, q: int, id_col: str, text_col: str):
        self.k, self.bands = k, Bands(p, q)
        self.source = keyed(docs, id_col, text_col)
        schema = "id long, t long, node long, check long, n long, own boolean, band int, free int, keys array<long>, bits binary"
        self.rows = stored(self.source.mapInArrow(_sketches(k, self.bands), schema), "sketches")
        self.docs = self.rows.filter("own").select("id", "t", "node", "check", "n")
        self.nodes = stored(self.docs.filter("n > 0").groupBy("node").agg(F.min(F.struct("id", "t")).alias("first"), F.min("check").alias("c1"), F.max("check").alias("c2")), "nodes")
        if not self.nodes.filter("c1 <> c2").isEmpty():
            raise ValueError("two shingle sets have one 64-bit digest")
        self.sketches = stored(self.rows.filter("n > 0").select("node", "band", "n", "free", "bits").dropDuplicates(["node", "band"]), "bits")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> None:
        """Check pairs (a, b, band)."""
        pairs = pairs.groupBy("a", "b").agg(F.min("band").alias("band"))
        side = lambda x: self.sketches.select(F.col("node").alias(x), "band", F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        near = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"]).select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
        self.verify(near.mapInArrow(_near(self.bands), "a long, b long"))

    def verify(self, near: DataFrame) -> None:
        """Compare the sets of pairs (a, b); renew links and labels."""
        near = stored(near, "near")
        if near.isEmpty():
            return
        wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        wanted = stored(self.nodes.join(wanted, "node").select("node", "first.id", "first.t"), "wanted")
        texts = self.source.join(small(wanted), ["id", "t"]).select("node", "text")
        sets = stored(texts.mapInArrow(_sets(self.k), "node long, set binary").dropDuplicates(["node"]), "sets")
        both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        links = stored(both.select("a", "b", "x", "y").mapInArrow(_links(self.bands.p, self.bands.q), "a long, b long"), "links")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = components(self.links)

    def spare(self, members: DataFrame) -> DataFrame:
        """Members of groups without the frequent words that documents can spare.

        A node's words of which it is the pivot do not count: there it has been compared with all others.
        """
        keys = small(stored(members.filter(F.col("nth") == SMALL_GROUP).select("key"), "frequent-keys"))
        often = stored(members.join(keys, "key").select("key", "node", "band"), "frequent")
        spared = often.groupBy("node", "band").agg(F.count(F.lit(1)).alias("n_often")).join(self.sketches.select("node", "band", "free"), ["node", "band"]).filter("n_often <= free")
        left_out = small(stored(often.join(spared.select("node", "band"), ["node", "band"], "left_semi"), "left-out"))
        return stored(members.join(left_out, ["key", "node", "band"], "left_anti").select("pivot", "band", "node", "key", "other"), "members")

    def labelled(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with the component of each of ``columns`` as ``label_...``."""
        labels = None if self.labels is None else small(self.labels)
        for c in columns:
            if labels is None:
                rows = rows.withColumn(f"label_{c}", F.col(c))
            else:
                named = rows.join(labels.select(F.col("node").alias(c), F.col("label").alias("to")), c, "left")
                rows = named.withColumn(f"label_{c}", F.coalesce("to", c)).drop("to")
        return rows

    def run(self) -> None:
        groups = _groups(self.rows.filter("n > 0").select(F.explode("keys").alias("key"), "band", "node"))
        self.compare(groups.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "band"))
        members = self.spare(groups.filter("key IS NOT NULL"))
        pairs = self.labelled(members.select("other", "node", "band").distinct(), "other", "node").filter("label_other <> label_node")
        self.compare(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "band"))
        # Keys of one pivot make one group, so that near copies with many common words meet once.
        named = stored(self.labelled(members, "other", "node").select("pivot", "band", "node", "key", F.col("label_node").alias("label"), F.expr("label_other <> label_node").alias("apart")), "named")
        several = named.filter("apart").select("key").distinct()
        rest = named.join(several, "key").select("pivot", "band", "node", "label").distinct()
        sizes = rest.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("size"))
        rest = stored(rest.join(sizes, ["pivot", "band"]), "rest")
        few = rest.filter(F.col("size") <= SMALL_GROUP)
        left = few.select("pivot", "band", F.col("node").alias("a"), F.col("label").alias("la"))
        right = few.select("pivot", "band", F.col("node").alias("b"), F.col("label").alias("lb"))
        self.compare(left.join(right, ["pivot", "band"]).filter("a < b AND la <> lb").select("a", "b", "band"))
        many = rest.filter(F.col("size") > SMALL_GROUP).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
        if many.isEmpty():
            return
        laid = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        # A node's groups are as few as the words of its sketch; two documents are compared in the first group of both.
        pivots = rest.groupBy("node", "band").agg(F.collect_list("pivot").alias("pivots"))
        laid = laid.join(self.sketches.select("node", "band", "n", "bits"), ["node", "band"]).join(pivots, ["node", "band"])
        laid = laid.select("pivot", "band", "node", "label", "n", "bits", "pivots", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
        laid = laid.select("pivot", "band", "node", "label", "n", "bits", "pivots", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
        self.verify(laid.groupBy("pivot", "band", "i", "j").applyInArrow(_block_pairs(self.bands), "a long, b long").distinct())


def similar_components(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, n_shingles, component_id) for each row: documents linked by a Jaccard similarity of p/q or more.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct
    ``k``-word shingles, or all words as one if there are fewer.  Texts without words
    and null texts have the empty set and are linked with nothing.  ``component_id`` is the
    smallest id that links reach, the row's own included; a null id counts as the least.
    Repeated rows give repeated rows; no rows give none; other columns are not read.
    """
    join = _Join(docs, k, p, q, id_col, text_col)
    join.run()
    labels = join.nodes.select("node", F.col("first.id").alias("least"))
    if join.labels is not None:
        labels = labels.join(join.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labels = labels.join(labels.groupBy("label").agg(F.min("least").alias("component")), "label").select("node", "component")
    else:
        labels = labels.select("node", F.col("least").alias("component"))
    out = join.docs.join(labels, "node", "left")
    return out.select("id", "t", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def without_near_copies(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without all but the first, by (id, text hash), of each component; equal rows are one."""
    groups = stored(similar_components(docs, k, p, q, id_col, text_col).select("id", "t", "component_id", (F.col("n_shingles") == 0).alias("lone")), "components")
    # Empty texts are groups of their own.
    firsts = groups.filter("NOT lone").groupBy("component_id").agg(F.min(F.struct("id", "t")).alias("x")).select("x.id", "x.t")
    firsts = small(stored(firsts.unionByName(groups.filter("lone").select("id", "t").distinct()), "firsts"))
    kept = keep_keys(docs, firsts, "left_semi", id_col, text_col)
    return kept.dropDuplicates(kept.columns[:2]).select(*docs.columns)


def component_rows(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    out = similar_components(docs, k, p, q)
    return out.select(plain_id().alias("doc_id"), "n_shingles", plain_id("component_id").alias("component_id"))
