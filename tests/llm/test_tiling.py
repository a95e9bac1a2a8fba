import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import tiling, words
from tests.llm.tables import cases, documents, empty, prose


def plain_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of places."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out.append(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=25), st.integers(2, 4))
def test_tiles_are_common_maximal_and_longest_first(a, b, least):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    got = tiling.tiles(x, y, least)
    covered_a, covered_b = np.zeros(len(a), int), np.zeros(len(b), int)
    for n, i, j in got:
        assert n >= least and a[i : i + n] == b[j : j + n]
        covered_a[i : i + n] += 1
        covered_b[j : j + n] += 1
    assert covered_a.max(initial=0) <= 1 and covered_b.max(initial=0) <= 1
    want = plain_tiles(a, b, least)
    assert max((t[0] for t in got), default=0) == max((t[0] for t in want), default=0)
    # nothing long enough is left
    assert not tiling._scan(x, y, covered_a == 0, covered_b == 0, least)


def items(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_id int")


def found(df):
    return sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in df.collect())


def test_exact_reordered_and_partial_passages(spark):
    item = prose(40, 40)
    parts = item.split()
    reordered = " ".join(parts[25:] + ["between"] + parts[10:25] + ["and"] + parts[:10])
    docs = documents(spark, [
        (1, prose(1) + "\n" + item.upper() + "! " + prose(2), "en"), (2, prose(3) + " " + reordered, "en"),
        (3, prose(4) + " " + " ".join(parts[:20]), "en"), (4, prose(5), "en"), (5, item, "en"),
        (5, item, "en"),
    ])
    got = found(tiling.leaks(docs, items(spark, [(7, item), (8, None), (9, "too few words"), (10, "")])))
    assert got == [(1, 7, 1.0), (2, 7, 1.0), (5, 7, 1.0), (5, 7, 1.0)]


def test_case_of_accented_letters(spark):
    docs = documents(spark, [(1, "DÉJÀ VU, ÇA ÉTÉ ÉCRIT ÉVIDEMMENT", None)])
    assert found(tiling.leaks(docs, items(spark, [(7, "Déjà vu ça été écrit évidemment")]))) == [(1, 7, 1.0)]


def test_against_all_pairs(spark):
    texts = {k: prose(k, 50) for k in range(30)}
    bench = {100 + k: " ".join(prose(k, 50).split()[5 : 20 + k]) for k in range(12)} | {200: prose(77)}
    docs = documents(spark, [(k, t, None) for k, t in texts.items()])
    tokens = lambda t: words.hashes([t.encode()], words.PLAIN)[0]
    want = []
    for d, t in texts.items():
        for i, b in bench.items():
            share = sum(x[0] for x in plain_tiles(tokens(t).tolist(), tokens(b).tolist(), 4)) / len(tokens(b))
            if share >= 0.6:
                want.append((d, i, round(share, 3)))
    assert found(tiling.leaks(docs, items(spark, bench.items()))) == sorted(want)
    assert want


def test_cases(spark):
    docs = cases(spark)
    bench = items(spark, [(1, prose(1)), (1, prose(1)), (None, prose(6)), (3, None)])
    got = tiling.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.item_id) == [(1, 1), (1, 1), (11, 1), (11, 1)]
    assert [r.doc_id for r in got if r.item_id is None] == [6, 6]
    assert tiling.leaks(empty(spark), bench).count() == 0
    assert tiling.leaks(docs, items(spark, [])).count() == 0
    stay = tiling.without_leaks(docs, bench)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in stay.collect()) == [-1, -1, 2, 3, 4, 5, 9, 10, 12]
