import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import kernels as K, prefix_forest as N, pu_quality as Q, url_trees as U
from riskspark.llm.queries import QUERIES, URL_RULES

from .cases import documents, empty, odd_texts


def exact(rows, queries, k):
    """All neighbours by brute force: {query: [(id, score), ...]}."""
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if queries(q):
            scored = [(-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in good if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def check(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {q for q, near in want.items() if near}
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [round(r.score, 6) for r in rows] == [round(s, 6) for _, s in want[q]]
        assert [r.vec_id for r in rows] == [i for i, _ in want[q]]


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in ("rep", "id", "v", "query", "hash", "score", "rank")})


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(100 + i, hot) for i in range(40)] + [(5, rows[5][1])]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] + [1.0] * 7), (205, [1.0, 2.0]), (None, rows[0][1]), (206, [])]
    asks = lambda i: i % 5 == 0
    # All rows are candidates here, so the result is exact, copies and ties included.
    got = N.nearest(table(spark, rows), asks, 7, candidates=10**9).collect()
    check(got, exact(rows, asks, 7))


def test_few_vectors(spark):
    asks = lambda i: i % 2 == 0
    assert N.nearest(table(spark, []), asks, 3).count() == 0
    assert N.nearest(table(spark, [(2, [1.0, 0.0])]), asks, 3).count() == 0
    got = N.nearest(table(spark, [(2, [1.0, 0.0]), (3, [0.5, 0.0])]), asks, 3).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(2, 1, 3, 0.5)]


def test_recall_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asks = lambda i: i % 50 == 0
    got = N.nearest(table(spark, rows), asks, 10, trees=16, candidates=16 * 60, block_rows=100).collect()
    want = exact(rows, asks, 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for i, _ in near}) / 10 for q, near in want.items()]) >= 0.9


def test_recall_does_not_fall_with_the_table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asks = lambda i: i % 60 == 0
    for n in (1500, 6000):
        # a few rows to ascend for, in small blocks, as with a table far larger than both
        found = {}
        for r in N.nearest(table(spark, rows[:n]), asks, 10, candidates=24 * 8, block_rows=32).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        recall = []
        for q in range(0, n, 60):
            s = x[:n].astype(float) @ x[q].astype(float)
            s[q] = -np.inf
            recall.append(len(found[q] & set(np.argsort(-s)[:10].tolist())) / 10)
        assert np.mean(recall) >= 0.9


def test_slices_of_sorted_hashes():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64) << np.uint64(1))
    q = h[::50]
    for depth in (0, 1, 3, 10, 64):
        lo, hi = N._slices(h, q, depth)
        for i, x in enumerate(q.tolist()):
            assert hi[i] - lo[i] == sum(int(y) >> (64 - depth) == x >> (64 - depth) for y in h.tolist())


def test_registered_search_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    found = {}
    for r in QUERIES["op4_prefix_forest"](spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[n]
            s[n] = -np.inf
            recall.append(len(found[i] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def quality_rows(n=240):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 200))]
        good = rng.random() < 0.7
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:20] for _ in range(8)]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(good)))
    return rows, labels


def test_quality_scores(spark):
    rows, labels = quality_rows()
    extra = [(1000 + (i or 0), t) for i, t in odd_texts()] + [(None, "no id at all"), rows[3], rows[3]]
    labels_df = spark.createDataFrame(labels + [(5, 0), (5, 1), (None, 1), (7, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = Q.quality_scores(documents(spark, rows + extra), labels_df).withColumnRenamed("id", "doc_id").collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None and r.doc_id >= 0)
    score = {r.doc_id: r.score for r in got}
    held = [(score[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad and np.mean([a > b for a in good for b in bad]) >= 0.95


def test_held_out_labels_have_no_say(spark):
    rows, labels = quality_rows(120)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    schema = "doc_id long, quality int"
    a = Q.quality_scores(documents(spark, rows), spark.createDataFrame(labels, schema))
    b = Q.quality_scores(documents(spark, rows), spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], schema))
    assert {r.id: round(r.score, 9) for r in a.collect()} == {r.id: round(r.score, 9) for r in b.collect()}


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality_scores(documents(spark, [(1, "a"), (2, None)]), none).collect()
    assert [r.score for r in got] == [0.5, 0.5]
    assert Q.quality_scores(empty(spark), none).count() == 0


def test_fit_minimises_the_non_negative_risk(spark):
    rng = np.random.default_rng(5)
    d, prior = len(Q.FEATURES), 0.4
    true = rng.random(1500) < prior
    x = rng.normal(size=(1500, d)) + np.where(true[:, None], 1.0, -1.0) * (np.arange(d) < 3)
    pos = rng.normal(size=(400, d)) + 1.0 * (np.arange(d) < 3)
    rows = [(v.tolist(), True) for v in pos] + [(v.tolist(), False) for v in x]
    mean, sd, w = Q.fit_pu(spark.createDataFrame(rows, "x array<float>, positive boolean"), prior)
    g = Q._standard(x, mean, sd) @ w
    assert np.mean((g > 0) == true) > 0.9
    # the unlabelled part of the risk is not below zero by more than the data's noise
    up = Q._standard(pos, mean, sd) @ w
    assert np.logaddexp(0, g).mean() - prior * np.logaddexp(0, up).mean() > -0.02


def test_features_of_single_texts_and_batches_agree():
    texts = [t or "" for _, t in odd_texts() if not t or len(t) < 1000]
    blobs = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    together = Q.text_features(np.frombuffer(b"".join(blobs), np.uint8), offsets)
    for row, b in zip(together, blobs):
        alone = Q.text_features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]
        assert np.allclose(row, alone)
    assert together.shape == (len(texts), len(Q.FEATURES)) and np.isfinite(together).all()
    assert K.words(np.zeros(0, np.uint8), np.array([0]))[0].size == 0


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def odd_urls():
    return [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://Sub.NET/x", "http://example.net/en/1", "http://a.example.net/en/", "http://example.net/EN/", "http://notexample.net/en/", "https://example.com/de/x?y=1#z", "https://example.com/de", "ftp://w.org/fr/a#b", "http://org?x://y", "http://a.b.net?p=/en/", "x://y://z.net/", "http://ÄÖ.net/ü", "http://u:p@h.org:80/fr/", "http://long.com/" + "a" * 5000]


def test_url_rules(spark):
    rows = list(enumerate(odd_urls() * 2)) + [(0, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "depth", "suffix", "label")})
    got = U.judge_urls(pages, URL_RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *rule_of(u)[:3]) for i, u in rows)
    assert all(r.verdict == rule_of(u)[3] for r in got for i, u in rows if i == r.page_id and r.rule and rule_of(u)[2] == r.rule)
    assert all(r.verdict in ("allow", "block") and (r.block_score is None) == (r.rule is not None) for r in got)


@pytest.mark.parametrize("urls,verdict", [([], None), (["http://a.com/"], "allow"), (["http://a.net/", "http://b.com/"], "block"), (["http://a.org/fr/", "http://b.com/"], "allow")])
def test_urls_without_both_labels(spark, urls, verdict):
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).filter("rule IS NULL").collect()
    assert {r.verdict for r in got} == ({verdict} if verdict else set())


def test_trees_learn_lexical_features(spark):
    rng = random.Random(9)
    urls = []
    for i in range(600):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        urls.append(f"http://{name}-x9-{i}.net/{'1' * rng.randint(5, 30)}" if i % 2 else f"http://{name}.org/fr/{name}")
    unruled = [(1000 + i, f"http://{'abc' * 2}-y8-{i}.com/{'2' * 20}") for i in range(20)] + [(2000 + i, f"http://abcdef.com/xx/{'ab' * 3}") for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)) + unruled, "page_id long, url string")
    got = {r.page_id: r for r in U.judge_urls(pages, URL_RULES, max_fit_rows=400).collect()}
    assert np.mean([got[i].block_score for i, _ in unruled[:20]]) > np.mean([got[i].block_score for i, _ in unruled[20:]])


def test_registered_url_rules(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op9_url_trees"](spark, sf).collect()
    assert len(got) == len(urls)
    assert all((r.host, r.path, r.rule) == rule_of(urls[r.page_id])[:3] for r in got)


def test_registered_quality(spark):
    sf = "/root/testdata/sf0.01"  # enough labels to measure
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op1_pu_quality"](spark, sf).collect()
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert not bad or np.mean([a > b for a in good for b in bad]) > 0.95
