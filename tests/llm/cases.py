"""Small tables with the awkward cases, and helpers."""

import random

#: Columns whose names operators use inside.
CLASH = "id t node label key words shard nth rank score bitmap n spans tree prefix hash x length offset"


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a table with columns of clashing names."""
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"other {c}") for c in CLASH.split()})
    return df


def odd_texts():
    """Null, empty, blank, tied, repeated and long texts; ids may repeat or be null."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\r\n \x0b\x0c"), (4, "One line\nOne line\n\nlast"), (5, "x" * 50_000), (6, long), (7, long + " tail"), (8, "no newline"), (9, "日本語 テキスト\n日本語 テキスト"), (None, "a text without an id"), (10, "twice"), (10, "twice"), (11, "a b  c \n d\x1ce")]
    return rows


def thue_morse(n, a="a", b="b"):
    """``n`` (a power of two) letters, and the same with both letters swapped: equal under any polynomial hash modulo 2**64."""
    one = "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    return one, one.translate(str.maketrans(a + b, b + a))


def empty(spark):
    return documents(spark, [])
