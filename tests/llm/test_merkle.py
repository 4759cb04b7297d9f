import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskspark.llm.merkle import build, climb, proofs, row_digest

from .cases import CLASH


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    """Levels of digests up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def walk(levels, i, digest, proof):
    for level in levels[:-1]:
        first = i - i % 8
        run = level[first : first + 8]
        proof += run[: i - first] + run[i - first + 1 :]
        digest = h(*run[: i - first], digest, *run[i - first + 1 :])
        i //= 8
    return digest, proof


def brute(rows):
    """(id, leaf, subroot, root, proof, folded) for rows (id, group, text), found later as text in lower case where the id is even."""
    order = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    groups = {}
    for i, g, t in rows:
        groups.setdefault(g, []).append((i, leaf(i, g, t), leaf(i, g, t.lower() if t is not None and i is not None and i % 2 == 0 else t)))
    trees = []
    for g in sorted(groups, key=order):
        members = sorted(groups[g], key=lambda m: (order(m[0]), m[1]))
        trees.append((members, grow([m[1] for m in members])))
    top = grow([levels[-1][0] for _, levels in trees]) if trees else None
    out = []
    for r, (members, levels) in enumerate(trees):
        for at, (i, own, seen) in enumerate(members):
            digest, proof = walk(levels, at, seen, [])
            digest, proof = walk(top, r, digest, proof)
            out.append((i, own, levels[-1][0], top[-1][0], "".join(proof), digest))
    return sorted(out, key=repr)


def ours(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, body string").withColumns({c: F.lit("other") for c in [*CLASH.split(), "group", "g", "n", "first", "part", "digest", "next"]})
    columns = [docs["doc_id"], docs["lang"]]
    seen = F.when(docs["doc_id"] % 2 == 0, row_digest(*columns, F.lower(docs["body"]))).otherwise(row_digest(*columns, docs["body"]))
    tree = build(docs, "doc_id", "lang", row_digest(*columns, docs["body"]), seen)
    low = lambda c: F.lower(F.hex(c))
    got = proofs(tree, **options).select("id", low("leaf"), low("subroot"), F.lit(tree.root), low("proof"), low("folded")).collect()
    return tree, sorted((tuple(r) for r in got), key=repr)


def cases():
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " \n", "Abc é", "日本", "x" * 30_000, "Same Text"])
    yield "no rows", []
    yield "one row", [(None, None, None)]
    yield "one group", [(i, "en", text()) for i in range(75)]
    yield "nulls, ties and repeated rows", [(rng.choice([None, 1, 1, 2, 3]), rng.choice([None, "", "en", "é"]), text()) for _ in range(150)]
    yield "a hot group and many of one row", [(i, "en" if i < 600 else f"l{i}", text()) for i in range(700)]


@pytest.mark.parametrize("name,rows", list(cases()), ids=lambda c: c if isinstance(c, str) else "")
def test_proofs_equal_brute_force(spark, name, rows):
    assert ours(spark, rows)[1] == brute(rows)


@pytest.mark.parametrize("broadcast_nodes", [0, 3, 20])
def test_nodes_joined_by_shuffle_give_the_same(spark, broadcast_nodes):
    rows = [(i, "en" if i % 3 else f"l{i % 30}", f"Text {i}") for i in range(300)]
    tree, got = ours(spark, rows, broadcast_nodes=broadcast_nodes)
    assert got == brute(rows)
    steps = climb(tree, broadcast_nodes).groupBy("g").agg(F.count("step").alias("n"), F.countDistinct("step").alias("d"), F.max("step").alias("last"), F.count("siblings").alias("s"))
    assert steps.filter("n <> d OR last <> n - 1 OR s <> n - 1").isEmpty()


def test_any_change_is_seen(spark):
    rows = [(i, "en", f"Text {i}") for i in range(20)]
    tree, got = ours(spark, rows)
    assert all((r[5] == tree.root) == (r[0] % 2 == 1) for r in got)
