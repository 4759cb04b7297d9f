import corpus_pipeline as C
from pyspark.sql import functions as F

from riskspark.llm.store import stored

from .cases import odd_texts


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))


def test_stages_and_columns(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    assert [name for name, _ in C.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        kept.append(docs)
        if name != "best-fit packing":
            assert docs.columns == list(C.COLUMNS)
            assert docs.filter("n_chars <> length(text)").isEmpty() or name == "quality classifier"
    assert kept[0].count() == kept[1].count() >= kept[2].count() == kept[3].count() > 0
    packed = kept[4].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.agg(F.max("n")).first()[0] <= 2048
    assert kept[4].select("doc_id").distinct().count() == kept[3].count()


def test_run_gives_the_last_stage(spark, sf):
    assert C.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_clean_documents_pass_and_copies_go(spark, tmp_path):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(60))) for i in range(12)]
    copies = [(100 + i, clean[0][1] + (" end" if i else "")) for i in range(4)]
    docs = table(spark, clean + copies)
    spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    out = C.quality(spark, docs, sf)
    assert out.count() == 16
    out = C.near_copies(spark, C.lines(spark, out, sf), sf)
    assert sorted(r.doc_id for r in out.collect()) == list(range(12))
    assert {r.text for r in C.passages(spark, out, sf).collect()} == {t for _, t in clean}


def test_odd_texts_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(4, 1), (9, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd_texts(), []):
        docs = table(spark, rows)
        for _, stage in C.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        assert (docs.count() > 0) == bool(rows)


def test_one_text_of_many_copies_is_packed(spark, tmp_path):
    texts = {n: "\n".join(" ".join(f"word{n}x{line}x{j}" for j in range(12)) for line in range(6)) for n in (10, 1000)}
    rows = [(n * 10 + i, t) for n, t in texts.items() for i in range(n)]
    spark.createDataFrame([(n * 10, 1) for n in texts], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, rows)
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
    assert sorted((r.doc_id, r.text) for r in docs.filter("text <> ''").collect()) == [(n * 10, t) for n, t in texts.items()]
    packed = C.sequences(spark, docs, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).filter("n > 1")
    assert sorted(r.doc_id for r in packed.collect()) == [n * 10 for n in texts]


def test_passages_of_just_over_fifty_words_go(spark, tmp_path):
    own = lambda n, k, part: " ".join(f"{'xy'[k]}own{n}{part}{j}{'xy'[k]}" for j in range(80))
    passage = {n: " " + " ".join(f"{n}w{j:02}" for j in range(n)) + " " for n in range(51, 61)}
    assert all(C.PASSAGE <= len(p) < 400 for p in passage.values())
    rows = [(2 * n + k, own(n, k, "a") + p + own(n, k, "b")) for n, p in passage.items() for k in range(2)]
    kept = {r.doc_id: r.text for r in C.passages(spark, table(spark, rows), str(tmp_path)).collect()}
    assert kept == {2 * n + k: own(n, k, "a") + own(n, k, "b") for n in passage for k in range(2)}


def test_the_last_step_of_a_stage_gets_small_batches_of_texts(spark, monkeypatch):
    from riskspark.llm import line_dedup, store

    def limited(batches, apply=line_dedup._apply):
        for batch in batches:
            assert batch.nbytes <= 2 * store.BATCH_BYTES
            yield from apply(iter([batch]))

    monkeypatch.setattr(line_dedup, "_apply", limited)
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat("id", F.lit(" ")), 3000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    before = spark.conf.get(store.BATCH_LIMIT)
    try:
        out = dict(C.STAGES)["line dedup"](spark, docs, "")
        assert out.agg(F.count("text"), F.sum("n_chars")).first() == docs.agg(F.count("text"), F.sum(F.length("text"))).first()
    finally:
        spark.conf.set(store.BATCH_LIMIT, before)


def test_run_sets_the_batch_limit_back(spark, sf):
    from riskspark.llm import store

    before = spark.conf.get(store.BATCH_LIMIT)
    C.run(spark, sf)
    assert spark.conf.get(store.BATCH_LIMIT) == before


def test_texts_are_worked_on_in_small_parts():
    import tracemalloc

    import pyarrow as pa

    from riskspark.llm import kernels as K, parity_join as J, pu_quality

    K.powers(1, 0)  # tables that stay
    n = 6000
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(80)) for i in range(n)], pa.string())
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["id", "t", "text"])
    for rows, most in ((pu_quality.feature_rows, 50_000_000), (J._sketches(5, J.Bands(80, 100)), 12_000_000)):
        tracemalloc.start()
        got = sum(out.num_rows for out in rows(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got >= n
        assert peak < most, peak
