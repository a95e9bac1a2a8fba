import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from cuelake.llm import fmindex, repeats
from cuelake.llm.jobs import LLM_QUERIES
from tests.llm.tables import cases, documents, empty, prose


def plain(rows, window):
    """Counts every window of words and cuts what is covered."""
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    count = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for doc_id, found in split:
        gone = {
            m for k in range(len(found) - window + 1) if count[tuple(found[k : k + window])] > 1 for m in range(k, k + window)
        }
        stay = [w for k, w in enumerate(found) if k not in gone]
        out.append((doc_id, len(found), len(gone), hashlib.sha256(b" ".join(stay)).hexdigest()))
    return sorted(out, key=repr)


def report(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_index_counts_windows():
    rng = np.random.default_rng(1)
    for _ in range(150):
        window = int(rng.integers(1, 9))
        sequences = [rng.integers(1, 4, size=int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 8)))]
        weights = rng.integers(1, 3, size=len(sequences))
        count = Counter()
        for s, n in zip(sequences, weights, strict=True):
            for k in range(len(s) - window + 1):
                count[tuple(s[k : k + window])] += n
        want = [[k for k in range(len(s) - window + 1) if count[tuple(s[k : k + window])] > 1] for s in sequences]
        assert [x.tolist() for x in fmindex.FMIndex(sequences, weights, window).repeated()] == want


def passages(seed, n=60):
    rng = np.random.default_rng(seed)
    shared = [prose(100 + k, 50).split() for k in range(4)]
    rows = []
    for k in range(n):
        own = [f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(0, 120)))]
        for _ in range(int(rng.integers(0, 3))):
            part = shared[rng.integers(0, 4)][int(rng.integers(0, 10)) :]
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = part
        rows.append((k, "  ".join(own) if k % 3 else " \n".join(own)))
    rows += [(n, "x " * 90), (n + 1, "y z " * 20), (n + 2, rows[3][1]), (n + 3, "Aa " * 35), (n + 4, "aA " * 35)]
    return rows


@pytest.mark.parametrize("window", [35, 12, 5])
def test_equals_counted_windows(spark, window):
    rows = passages(window)
    df = documents(spark, [(i, t, None) for i, t in rows]).repartition(5)
    assert report(repeats.repeat_report(df, window)) == plain(rows, window)


def test_crowded_runs_and_many_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 6)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    rows = passages(9)
    df = documents(spark, [(i, t, None) for i, t in rows]).repartition(3)
    assert report(repeats.repeat_report(df, 20)) == plain(rows, 20)


def test_cases(spark):
    docs = cases(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert report(repeats.repeat_report(docs, 35)) == plain(rows, 35)
    rewritten = repeats.without_repeats(docs, 35)
    assert rewritten.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in rewritten.collect()), key=repr)
    twice = {t for _, t in rows if t and len(t.split()) > 35 and sum(t == u for _, u in rows) > 1}
    want = [(i, "" if t in twice else t, None if t is None else 0 if t in twice else len(t)) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert repeats.repeat_report(empty(spark)).count() == repeats.without_repeats(empty(spark)).count() == 0


def test_long_text_in_segments(spark):
    rows = [(1, "a b " * 3000), (2, " ".join(f"q{k % 5000}" for k in range(12_000)))]
    assert report(repeats.repeat_report(documents(spark, [(i, t, None) for i, t in rows]), 35)) == plain(rows, 35)


def test_query_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert report(LLM_QUERIES["op13_repeats"](spark, sf)) == plain(rows, 35)
