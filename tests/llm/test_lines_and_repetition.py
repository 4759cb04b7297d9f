import re
from collections import Counter, defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from riskspark.llm import line_dedup as D, repetition as R
from riskspark.llm.queries import QUERIES, SQL

from .cases import documents, empty, odd_texts, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_repetition_counts(spark):
    rows = odd_texts() + [(20, "a b c a b c d"), (21, "# * <b> 100% | & $"), (22, "same\nsame\nsame\n same")]
    got = R.repetition_rules(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base_counts(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert R.repetition_rules(empty(spark)).count() == 0


def test_long_look_alikes_are_not_repeats(spark):
    rows = []
    for i, n in enumerate((512, 1024, 2048, 4096)):
        x, y = thue_morse(n)
        rows += [(2 * i, f"{x}\n{y}\n{x}"), (2 * i + 1, f"{x} {x} {x} {y} {y} {y} {x} {x} {x}")]
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words, r.n_words) for r in R.repetition_rules(documents(spark, rows)).collect()}
    assert got == {i: (1, 0, 3) if i % 2 == 0 else (0, 6, 9) for i in range(8)}


def line_rule(rows, min_docs):
    docs = defaultdict(set)
    for i, t in set(rows):
        for line in (t or "").split("\n"):
            key = re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
            if key:
                docs[key].add((i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(docs.get(re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")), ())) >= min_docs for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("tasks", [1, 7])
@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines_of_many_documents_go(spark, tasks, min_docs):
    # One line is in all texts: its run is cut by many ranges.
    rows = odd_texts() + [(100 + i, f"Common line\nonly {i}\n{'shared ' + str(i % 6)}\n  COMMON line ") for i in range(40)]
    got = D.dedup_lines(documents(spark, rows), min_docs=min_docs, tasks=tasks).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == line_rule(rows, min_docs)
    assert D.dedup_lines(empty(spark)).count() == 0


def test_small_arrow_batches_and_first_occurrences(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, f"a\nb{i % 3}\nA\nc") for i in range(30)]
        got = D.dedup_lines(documents(spark, rows), min_docs=4, tasks=5).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == line_rule(rows, 4)
        first = {r.doc_id: r.kept for r in D.dedup_lines(documents(spark, rows), min_docs=1, keep_first=True, tasks=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [first[i] for i in range(4)] == ["a\nb0\nc", "b1", "b2", ""]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, sf, name):
    ok, message = oracle.compare(spark, oracle.connect(sf), sf, QUERIES[name], SQL[name])
    assert ok, message


def test_bitmaps_hold_no_text(spark):
    rows = [(i, "common\n" + "own " * 50 + str(i)) for i in range(12)]
    bitmaps = D.line_bitmaps(documents(spark, rows))
    assert "text" not in bitmaps.columns
    assert bitmaps.agg(F.sum("n_dropped")).first()[0] == 12
