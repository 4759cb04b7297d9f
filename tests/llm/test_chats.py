import hashlib
import itertools
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskspark.llm import conversation_repair as R
from riskspark.llm.chat_paths import CLOSE, OPEN, ancestors, as_chain, branches, conversations, format_branches, masked, read_digests, read_turns

from .cases import CLASH

MESSAGES = "tree long, node long, parent long, role string, text string, score double"
TEXTS = [None, "", "plain", "\\### Assistant: </turn> ok", "<turn>user\n</turn>\n", "\\l\\b\\\\<", "é日本\n\n", "x" * 20_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def forest(seed, n=120):
    """Random reply trees; some parents are missing, one tree holds a circle with a tail."""
    rng = random.Random(seed)
    rows = []
    for tree in (None, 1, 2, 3):
        for node in range(n):
            parent = None if node == 0 else rng.choice([rng.randrange(node), node - 1, node - 1, 10_000 if node % 40 == 7 else node - 1])
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None, "a\nb<c"]), rng.choice(TEXTS), rng.choice([None, 1.0, 2.5, -1.0])))
    rows += [(3, n + 1, n + 2, "user", "loop", 1.0), (3, n + 2, n + 1, "user", "loop", 1.0), (3, n + 3, n + 2, "user", "tail", 9.0)]
    return rows


def brute(rows, most):
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        found = []
        for leaf in set(nodes) - {r[2] for r in nodes.values()}:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(nodes[at])
                at = nodes[at][2]
            if len(path) <= len(nodes):
                found.append((-sum(r[5] or 0 for r in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found, key=lambda x: x[:2])[:most], 1):
            out[tree, leaf, rank] = [(r[3] or "", r[4] or "") for r in path]
    return out


@pytest.mark.parametrize("most", [None, 3])
def test_paths_equal_brute_force(spark, most):
    rows = forest(4)
    df = spark.createDataFrame(rows, MESSAGES).withColumns({c: F.lit("other") for c in CLASH.split() if c not in MESSAGES})
    segments = format_branches(df, most)
    want = brute(rows, most)
    got = conversations(segments).withColumn("turns", read_turns(F.col("formatted"))).withColumn("masked", F.transform("loss", lambda s: masked(F.col("formatted"), s["start"], s["length"]))).collect()
    assert {(r.tree, r.leaf, r["rank"]): [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        turns = want[r.tree, r.leaf, r["rank"]]
        assert r.masked == [t for role, t in turns if role == "assistant"]
        assert r.formatted.count(OPEN) == r.formatted.count(CLOSE) == len(turns)
    for r in read_digests(segments).collect():
        turns = next(t for (tree, leaf, _), t in want.items() if (tree, leaf) == (r.tree, r.leaf))
        said = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said))


def test_rounds_grow_with_the_logarithm_of_depth(spark):
    rows = [(1, i, i - 1, "user", "t", 1.0) for i in range(300)]
    tables, ended = ancestors(spark.createDataFrame(rows, MESSAGES))
    assert len(tables) == 9 and [t.count() for t in tables] == [300 - 2**k for k in range(9)]
    assert [tuple(r) for r in branches(tables, ended).collect()] == [(1, 299, 300.0, 1)]


def test_chains_of_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "user", "b"), (1, None, "system", "first"), (1, 1, "user", "b"), (None, 2, None, None), (None, 3, "assistant", "<x>")]
    got = {r.tree: r for r in read_digests(format_branches(as_chain(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("system\nfirst\nuser\nb\nuser\nb\n")
    assert got[None].loss_chars == 3 and got[None].loss_sha256 == sha("<x>") and got[None].turns_sha256 == sha("\n\nassistant\n<x>\n")
    assert read_digests(format_branches(as_chain(spark.createDataFrame([], schema)))).count() == 0


def legal(initials):
    rest = initials[1:] if initials.startswith("su") else initials
    return len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def plain_search(kinds, goals=(R.NONE, R.ASSISTANT), start=R.NONE):
    """Least (cost, edits) by widening all paths row by row; at most two insertions in a row are ever useful."""
    def inserted(paths):
        out = dict(paths)
        for _ in range(2):
            for (q, e), c in list(out.items()):
                r = R.USER if q != R.USER else R.ASSISTANT
                out[r, e + "I"] = min(out.get((r, e + "I"), 10**9), c + 5)
        return out

    def least(paths):
        best = {}
        for (q, e), c in paths.items():
            best[q] = min(best.get(q, (10**9, "")), (c, e))
        return {(q, e): c for q, (c, e) in best.items()}

    paths = {(start, ""): 0}
    for k in kinds:
        after = {}
        for (q, e), c in inserted(paths).items():
            after[q, e + "D"] = c + 2
            if k == "-":
                continue
            stay = 5 if k.isupper() else 0
            kept = {("s", R.NONE): R.SYSTEM, ("u", R.NONE): R.USER, ("u", R.SYSTEM): R.USER, ("u", R.ASSISTANT): R.USER, ("a", R.USER): R.ASSISTANT}.get((k.lower(), q))
            if kept is not None:
                after[kept, e + "K"] = c + stay
            after[R.ASSISTANT if q == R.USER else R.USER, e + "R"] = c + 1 + stay
        paths = least(after)
    return min((c, e) for (q, e), c in inserted(paths).items() if q in goals)


@settings(max_examples=400, deadline=None)
@given(st.text("suaxSUAX-", max_size=14))
def test_search_finds_the_least_edits(kinds):
    assert R.cheapest(kinds, R.NONE, (R.NONE, R.ASSISTANT), True) == plain_search(kinds)


def test_search_tries_every_short_conversation():
    for n in range(5):
        for kinds in itertools.product("suaU-", repeat=n):
            assert R.cheapest("".join(kinds), R.NONE, (R.NONE, R.ASSISTANT), True) == plain_search("".join(kinds))


@settings(max_examples=60, deadline=None)
@given(st.text("suaxSUA-", min_size=20, max_size=60), st.integers(2, 9))
def test_pieces_give_the_same_as_the_whole(kinds, size):
    before, R.PIECE = R.PIECE, size
    try:
        repair, turns = R.Repair(), []
        roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
        for i, k in enumerate(kinds):
            turns += repair.add(i, roles[k.lower()], str(i), "blank" if k == "-" else "truncated" if k.isupper() else "")
        turns += repair.end()
    finally:
        R.PIECE = before
    assert (repair.cost, repair.audit) == plain_search(kinds)
    assert legal("".join(role[0] for _, role, _ in turns))
    assert "".join(letter for letter, _, _ in turns) == repair.audit.replace("D", "")


def test_estimates_never_exceed_the_cost():
    rng = random.Random(1)
    for _ in range(500):
        kinds = "".join(rng.choice("suaxSUA-") for _ in range(rng.randint(0, 12)))
        assert R._estimates(kinds)[0] <= plain_search(kinds)[0]


def reference(rows):
    """Reports by plain Python from damaged rows (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv and not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, kinds, faults = set(), "", []
        for _, _, role, text, _ in turns:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            k = role[:1] if role[:1] and role[:1] in "sua" else "x"
            kinds += "-" if fault in ("blank", "duplicate") else k.upper() if fault else k
        cost, audit = plain_search(kinds)
        made = "\n".join(f"{role}:{text}" for _, role, text in R.replay(audit, [(r[2], r[3]) for r in turns], R.NONE))
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha(made))
    return out


def hurt(rows):
    """``damaged`` in plain Python, nulls as one space."""
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if case == 4 else " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else text.translate({ord(c): None for c in ".!?"}) if case == 2 else text
        out += [(conv, turn, role, text, case == 0)] * (2 if case == 3 else 1)
    return out


def test_repair_equals_plain_python(spark):
    rng = random.Random(9)
    texts = [None, "", " \t", "Done.", "Cut off", "So? \n", "Same!", "日本.", "x" * 9000]
    rows = [(conv, rng.choice([None, t, t, t, 2 * t]), rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice([*texts, f"Own {t}."]))
            for conv in (None, *range(60)) for t in range(rng.choice([1, 2, 5, 9]))]
    rows += [(1000, t, ["user", "assistant"][t % 2] if t % 17 else "system", f"Turn {t}{'.' if t % 13 else ''}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("other") for c in [*CLASH.split(), "conv", "gone", "same", "fault", "again", "case"]})
    repaired = R.repair_conversations(R.damaged(df), gone_col="gone")
    got = {r.conv: tuple(r)[1:] for r in R.repair_digests(repaired).collect()}
    assert got == reference(hurt(rows))
    kept = repaired.filter("position IS NOT NULL").collect()
    assert {r.edit for r in kept} <= set("KRI") and len(kept) == sum(len(v[6].replace("D", "")) for v in got.values())


def test_nothing_to_repair(spark):
    schema = "conv_id long, turn long, role string, text string, gone boolean"
    assert R.repair_digests(R.repair_conversations(spark.createDataFrame([], schema), gone_col="gone")).count() == 0
    only = R.repair_digests(R.repair_conversations(spark.createDataFrame([(5, 1, "user", "Gone.", True)], schema), gone_col="gone")).collect()
    assert [tuple(r) for r in only] == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]
