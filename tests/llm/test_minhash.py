"""Near duplicates against brute force, and awkward rows."""

from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import minhash as M
from quern.llm.common import with_class
from quern.llm.components import connected_components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows, percent=85):
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, scheme=M.Scheme()):  # noqa: B008
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(df, scheme=scheme).collect()}
    assert got == brute(rows)


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.integers(1000)}" for w in words)


def test_copies_edits_and_odd_texts(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for _ in range(15):
        words = [f"w{k}" for k in rng.integers(0, 400, rng.integers(3, 200))]
        for share in (0, 0, 0.002, 0.01, 0.03, 0.1):
            rows.append((i, edited(rng, words, share)))
            i += 1
        rows.append((i, " ".join(words[:-1])))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "One"), (i + 4, "one"), (i + 5, "a b c d"), (i + 6, "A b\nc  d"), (i + 7, "ein\xa0wort"), (i + 8, "w " * 30000)]
    check(spark, rows)


def test_a_large_group_of_unequal_copies(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in rng.integers(0, 4000, 120)]
    rows = [(i, edited(rng, words, 0.012)) for i in range(150)] + [(1000 + i, edited(rng, words, 0.2)) for i in range(20)]
    check(spark, rows)
    check(spark, rows, M.Scheme(block=16, few=4))


def by_row(rows, percent=85):
    """What near_duplicates states for rows (id, text), each a document of its own: sorted (id, n, component)."""
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if comp[a] != comp[b] and x and y and 100 * len(x & y) >= percent * len(x | y):
            comp = [comp[a] if c == comp[b] else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(least[c], i)
    return sorted(((i, len(x), least[c], i is not None and i == least[c]) for (i, _), x, c in zip(rows, sets, comp, strict=True)), key=str)


def check_rows(spark, rows, scheme=M.Scheme()):  # noqa: B008
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(7)).withColumn("tk", F.lit("x")).withColumn("row", F.lit(None))
    got = M.near_duplicates(df, scheme=scheme).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == by_row(rows, scheme.percent)


def test_nulls_repeats_empty_and_extra_columns(spark):
    text = "a b c d e f"
    check_rows(spark, [(1, text), (1, text), (None, text), (3, text), (4, None), (None, None), (5, ""), (None, "other words"), (None, "other words")])
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_with_different_texts(spark):
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"{x}{k}" for k in rng.integers(0, 10**6, 80)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, c), (9, a + " more"), (None, c + " more"), (None, c + " more"), (8, c + " more words")]
    check_rows(spark, rows)
    for share in (0.01, 0.03):
        made = [f"w{k}" for k in rng.integers(0, 4000, 150)]
        rows += [(int(i) if i else None, edited(rng, made, share)) for i in rng.integers(0, 12, 60)]
    check_rows(spark, rows, M.Scheme(block=16, few=4))


def test_classes_join_alike_whether_broadcast_or_shuffled(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(50)] + [(0, k) for k in range(5000)], "key long, x long")
    classes = rows.groupBy("key").agg(F.count("*").alias("c"), F.max("x").alias("m"))
    want = sorted(tuple(r) for r in rows.join(classes, "key").collect())
    assert sorted(tuple(r) for r in with_class(rows, classes, ["key"]).collect()) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), min_size=0, max_size=40), min_size=1, max_size=6))
def test_registers_are_whole_and_depend_on_the_set(sets):
    regs = M.registers([np.array(sorted(s), dtype=np.uint64) for s in sets], 64)
    for s, r in zip(sets, regs, strict=True):
        assert (r > 0).all() == bool(s)
    assert (M.registers([np.array(sorted(sets[0]), dtype=np.uint64)], 64)[0] == regs[0]).all()


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 2000).astype(np.uint64)
    for share in (0.2, 0.5, 0.85):
        k = int(2000 * share)
        y = np.concatenate([x[:k], rng.integers(0, 2**63, 2000 - k).astype(np.uint64)])
        a, b = M.registers([x, y], 252)
        assert abs(M.estimate(a, b) - k / (4000 - k)) < 0.12


def test_overlaps_match_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80))).astype(np.uint64) for _ in range(12)]
    got = M._overlaps(sets[:5], sets[5:], width=7)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}
