import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import bwt_dedup as S, graph, parity_join as J
from riskspark.llm.queries import QUERIES

from .cases import documents, empty, odd_texts, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def groups(rows, k, p, q):
    """Component (smallest id) of each row, by all pairs of different sets."""
    by = defaultdict(list)
    for i, t in rows:
        by[shingle_set(t, k)].append(i)
    sets = list(by)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and p * max(len(sets[a]), len(sets[b])) <= q * min(len(sets[a]), len(sets[b])) and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    key = lambda i: (i is not None, i or 0)
    least = {}
    for a, s in enumerate(sets):
        if s:
            least[find(a)] = min([*by[s], *([least[find(a)]] if find(a) in least else [])], key=key)
    number = {s: a for a, s in enumerate(sets)}
    return Counter((i, len(shingle_set(t, k)), least[find(number[shingle_set(t, k)])] if shingle_set(t, k) else i) for i, t in rows)


def near_copies(seed, n=160):
    """Texts in families with a few words changed, chains of copies, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 4000)
    passage = [word() for _ in range(40)]
    rows, families = [], [[word() for _ in range(rng.choice([3, 6, 20, 60, 150, 400]))] for _ in range(14)]
    for i in range(n):
        kind = i % 4
        words = list(rng.choice(families))
        if kind == 1:
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = word()
        elif kind == 2:
            words = passage + [word() for _ in range(rng.randint(5, 80))]
        elif kind == 3:
            words = words[: max(1, len(words) - rng.randint(0, len(words) // 6))]
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    return rows


@pytest.mark.parametrize("k,p,q,small", [(4, 85, 100, 32), (5, 80, 100, 3), (2, 70, 100, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, k, p, q, small):
    monkeypatch.setattr(J, "SMALL_GROUP", small)
    monkeypatch.setattr(J, "BLOCK", small)
    rows = near_copies(k) + [(1000 + (i or 0), t) for i, t in odd_texts() if i not in (6, 7)]
    got = J.component_rows(documents(spark, rows), k, p, q).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows, k, p, q)


def test_odd_texts_and_no_rows(spark):
    rows = odd_texts()
    got = J.component_rows(documents(spark, rows), 4, 85, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows, 4, 85, 100)
    assert J.component_rows(empty(spark), 4, 85, 100).count() == 0


def test_long_look_alikes_are_not_linked(spark):
    rows = []
    for i, n in enumerate((512, 1024, 2048, 4096)):
        x, y = thue_morse(n)
        rows += [(10 * i, f"{x} one"), (10 * i + 1, f"{y} one"), (10 * i + 2, f"{x} one ")]
    got = {r.doc_id: r.component_id for r in J.component_rows(documents(spark, rows), 4, 85, 100).collect()}
    assert got == {i: 10 * (i // 10) if i % 10 != 1 else i for i, _ in rows}


def test_one_of_each_group_stays(spark):
    rows = near_copies(9) + odd_texts()
    kept = J.without_near_copies(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    want = {(i, t) for i, t in rows if not shingle_set(t, 5)}
    n_groups = {c for i, n, c in groups(rows, 5, 80, 100) if n}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set((i, t or "") for i, t in want)) + len(n_groups)
    assert n_groups <= {i for i, _ in got}


def test_sketches_bound_the_difference():
    bands, rng = J.Bands(85, 100), np.random.default_rng(1)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 1 + len(both) // 8), dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 1 + len(both) // 8), dtype=np.uint64)]))
        apart, meet = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
        common = set(bands.of(len(a))) & set(bands.of(len(b)))
        if 100 * meet >= 85 * (len(a) + len(b) - meet):
            assert common
            band = max(bands.of(len(a))[0], bands.of(len(b))[0])
            words, spare = bands.shape(band)
            (x, n_x, bits_x), (y, n_y, bits_y) = J.sketch(a, words), J.sketch(b, words)
            assert int(np.bitwise_count(bits_x ^ bits_y).sum()) <= apart <= bands.apart(len(a) + len(b))
            assert np.count_nonzero(x != y) <= apart
            left = [n > J.low_words(n, spare) for n in (n_x, n_y)]
            assert ((x == y) & left[0] & left[1]).any()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 600), (700, 600), (700, 701), (900, 900)]
    df = spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "a long, b long")
    got = dict(graph.components(df).collect())
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in (500, 600, 700, 701)}, 900: 900}


def repeated(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = Counter()
    for (doc, _), b in zip(rows, texts):
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        out[doc, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 150)))
        if i % 3 == 0:
            at = rng.randint(0, 200)
            text += rng.choice(base)[at : at + rng.randint(20, 100)] + "".join(rng.choice("abé") for _ in range(rng.randint(0, 60)))
        if i % 7 == 0:
            text = "ab" * rng.randint(1, 60) + text
        if i % 11 == 0:
            text = base[0][:150] + text
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("widths,core,bucket", [((12, 4), 4096, 20_000), ((12, 4), 3, 20_000), ((8, 2), 4096, 15)])
def test_repeats_equal_brute_force(spark, monkeypatch, widths, core, bucket):
    monkeypatch.setattr(S, "CORE", core)  # more strings of one core are counted window by window
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "STEP", 97)  # long texts are worked on in steps
    rows = passages(5)
    got = S.remove_repeats(documents(spark, rows), 24, output="sha256", widths=widths).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got) == repeated(rows, 24)


def test_repeats_in_odd_texts(spark):
    rows = odd_texts()
    got = S.remove_repeats(documents(spark, rows), 400, output="sha256").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got) == repeated(rows, 400)
    assert S.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.repeated_windows(documents(spark, rows), 10)


def test_kept_text_has_whole_characters(spark):
    same = "é" * 30
    rows = [(1, "a" + same + "x"), (2, "b" + same + "y"), (3, "é" + same[:-1] + "z")]
    for r in S.remove_repeats(documents(spark, rows), 24, output="text", widths=(8, 2)).collect():
        assert r.kept == "".join(c for c in r.kept) and set(r.kept) <= set("aébxyz")
    whole = S.remove_repeats(documents(spark, rows), 24, output="bytes", widths=(8, 2))
    assert whole.select(F.sum(F.length("kept"))).first()[0] == sum(len(t.encode()) for _, t in rows) - whole.agg(F.sum("n_removed")).first()[0]


def test_merged_transforms_equal_sorted_suffixes():
    rng = random.Random(8)
    for _ in range(60):
        shards = [[np.array([rng.choice([1, 2, 3, 300]) for _ in range(rng.randint(0, 9))]) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        built = [S.shard_bwt(s) for s in shards]
        shard, common = S.interleave([b for b, _ in built], [len(s) for s in shards])
        # All suffixes at once; ends differ in the order of shards and strings.
        suffixes = []
        for k, strings in enumerate(shards):
            for n, s in enumerate(strings):
                for j in range(len(s) + 1):
                    suffixes.append(([(int(c), 0, 0) for c in s[j:]] + [(0, k, n)], k))
        suffixes.sort()
        assert [k for _, k in suffixes] == shard.tolist()
        for i in range(1, len(suffixes)):
            a, b = suffixes[i - 1][0], suffixes[i][0]
            shared = next(x for x in range(len(a) + 1) if x == len(a) or x == len(b) or a[x] != b[x])
            assert common[i] == shared


def test_registered_joins_on_a_given_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op3_parity_sketch_join"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows, 4, 85, 100)
    got = QUERIES["op7_bwt_dedup"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeated(rows, 400)


def test_pivots_do_not_depend_on_batches():
    import pyarrow as pa

    rng = random.Random(6)
    rows = sorted((rng.randint(0, 30), rng.randint(0, 6), 4) for _ in range(300))
    want = defaultdict(set)
    for key, node, _ in rows:
        want[key].add(node)
    want = sorted((k, 4, n, min(v)) for k, v in want.items() if len(v) > 1 for n in v)
    for size in (1, 2, 3, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), (pa.int64(), pa.int64(), pa.int32()))], ["key", "node", "band"]) for i in range(0, len(rows), size)]
        got = [r for b in J._pivots(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == want


def test_members_do_not_depend_on_batches():
    import pyarrow as pa

    rng = random.Random(7)
    runs = {k: sorted(rng.sample(range(50), rng.choice([2, 2, 3, 9]))) for k in range(-20, 20)}
    rows = [(k, 4, n, v[0]) for k, v in sorted(runs.items()) for n in v]
    want = [(v[0], 4, n, *((k, v[1], i) if len(v) > 2 else (None,) * 3)) for k, v in runs.items() for i, n in enumerate(v[1:])]
    order = lambda rows: sorted(rows, key=str)
    for size in (1, 2, 3, 7, 1000):
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), types)], ["key", "band", "node", "pivot"]) for i in range(0, len(rows), size)]
        assert order(r for b in J._members(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))) == order(want)
    assert list(J._members(iter([]))) == []


def test_a_pair_that_shares_no_group_with_others_is_compared_once(spark, monkeypatch):
    # Similarity of 0.81: the pairs share keys, but are not alike.
    rows = [(2 * n + k, " ".join(f"n{n}w{j}" for j in range(360)) + "".join(f" n{n}k{k}w{j}" for j in range(40))) for n in range(6) for k in range(2)]
    rounds, compare = [], J._Join.compare

    def counted(self, pairs):
        rounds.append(pairs.select("a", "b").distinct().count())
        compare(self, pairs)

    monkeypatch.setattr(J._Join, "compare", counted)
    assert {r.doc_id: r.component_id for r in J.component_rows(documents(spark, rows), 4, 85, 100).collect()} == {i: i for i, _ in rows}
    assert rounds == [6, 0, 0]


def test_stored_tables_are_made_of_small_batches(spark):
    import pyarrow as pa

    from riskspark.llm import store

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    got = store.stored(texts.mapInArrow(sizes, "n long"), "sizes")
    assert got.agg(F.sum("n")).first()[0] >= 30_000_000
    assert got.agg(F.max("n")).first()[0] <= 2 * store.BATCH_BYTES
    assert spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError):
        with store.small_batches(spark):
            1 / 0
    assert spark.conf.get(name) == before
