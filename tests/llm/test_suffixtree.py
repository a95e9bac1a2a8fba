import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from cuelake.llm import jobfolder, suffixtree
from tests.llm.tables import cases, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def plain_base(rows):
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    return [
        (i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total,
         sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t)))
        for i, t in rows
    ], count, total, distinct


def plain_scores(rows, tree):
    """Each token by looking up its longest kept contexts one word at a time."""
    _, count, total, distinct = plain_base(rows)
    spell = {int(suffixtree.words.hashes([w.encode()])[0][0]): w for _, t in rows for w in tokens(t) if w} | {int(suffixtree.END): None}
    names = [[(spell[int(h)],) for h in tree.levels[0].keys]]
    for k, level in enumerate(tree.levels[1:], 1):
        names.append([(*names[k - 1][key >> 32], *names[0][key & 0xFFFFFFFF]) for key in level.keys.tolist()])
    counts = {name: int(c) for level, own in zip(tree.levels, names, strict=True) for name, c in zip(own, level.counts, strict=True)}
    kept = {name for level, own in zip(tree.levels, names, strict=True) for name, on in zip(own, level.kept, strict=True) if on}
    after = {}
    for name in counts:
        after.setdefault(name[:-1], []).append(name)
    out = []
    for i, t in rows:
        whole, score = tokens(t), 0.0
        for at, w in enumerate(whole):
            p = (count[w] + 0.1) / (total + 0.1 * (distinct + 1))
            for n in range(1, len(tree.levels)):
                context = tuple(whole[at - n : at])
                if at >= n and context in kept:
                    listed = sum(counts[x] for x in after.get(context, []))
                    rest = counts[context] - listed + tree.prior
                    p = (counts.get((*context, w), 0) + rest * p) / (counts[context] + tree.prior)
            score += math.log10(p)
        out.append((i, score))
    return out


def corpus(n=80, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        text = []
        while len(text) < 80:
            text += ["Once", "upon", "a", "time"] if rng.random() < 0.15 else [rng.choice(vocabulary)]
            if rng.random() < 0.02:
                text.append(f"rare{rng.randrange(10**6)}")
        rows.append((i, " ".join(text)))
    return rows


def test_base_and_tree_scores_against_plain_ones(spark, monkeypatch):
    rows = corpus()
    df = documents(spark, [(i, t, None) for i, t in rows])
    want, *_ = plain_base(rows)
    got = {r.doc_id: r for r in suffixtree.scores(df, min_share=1e-3).collect()}
    for i, out, n, known, total, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    texts = df.select("doc_id", suffixtree.F.col("text").cast("binary").alias("text"))
    tree, _ = suffixtree.fit(texts.filter(suffixtree.remainder("doc_id", 10) != 0), min_share=1e-3)
    assert any(level.kept.any() for level in tree.levels)
    for i, score in plain_scores(rows, tree):
        assert math.isclose(got[i].score, score, rel_tol=1e-6), i
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)  # both negative: the tree is better


def test_rare_words_come_by_a_join(spark, monkeypatch):
    rows = corpus(40, 5)
    df = documents(spark, [(i, t, None) for i, t in rows])
    plain = {r.doc_id: r for r in suffixtree.scores(df, min_share=1e-2).collect()}
    monkeypatch.setattr(suffixtree, "WORD_SHARE", 5e-3)
    for r in suffixtree.scores(df, min_share=1e-2).collect():
        assert r.n_known == plain[r.doc_id].n_known
        assert math.isclose(r.base_score, plain[r.doc_id].base_score, rel_tol=1e-9)
        assert math.isclose(r.score, plain[r.doc_id].score, rel_tol=1e-6)


def test_a_context_is_a_distribution(spark):
    rows = corpus(60, 9)
    df = documents(spark, [(i, t, None) for i, t in rows])
    texts = df.select(suffixtree.F.col("text").cast("binary").alias("text"))
    tree, _ = suffixtree.fit(texts, min_share=1e-3)
    root = tree.base(tree.levels[0].counts.astype(float))
    unseen = float(tree.base(np.zeros(1))[0])
    others = sum(float(tree.base(np.array([c]))[0]) for c in tree.word_counts) - root.sum()
    level, longer = tree.levels[0], tree.levels[1]
    for s in np.flatnonzero(level.kept):
        own = longer.prefix == s
        p = (level.rest[s] * root) / (level.counts[s] + tree.prior)
        np.add.at(p, longer.keys[own] & 0xFFFFFFFF, longer.counts[own] / (level.counts[s] + tree.prior))
        assert math.isclose(p.sum() + level.rest[s] * (others + unseen) / (level.counts[s] + tree.prior), 1, rel_tol=1e-9)


def test_cases(spark):
    docs = cases(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    want, *_ = plain_base(rows)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in suffixtree.scores(docs).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert suffixtree.scores(empty(spark)).count() == 0
    one = suffixtree.scores(documents(spark, [(None, "a b", None)])).first()  # only a held-out row: nothing is learned
    assert one.train_tokens == 0 and one.n_known == 0 and math.isclose(one.score, one.base_score)


def test_a_sequence_seen_twice_counts_at_any_size(spark):
    rows = [(k, "alpha beta", None) for k in range(3)] + [(3, "x " * 1_100_000, None)]
    texts = documents(spark, rows).select(suffixtree.F.col("text").cast("binary").alias("text"))
    tree, _ = suffixtree.fit(texts)
    alpha, beta = suffixtree.words.hashes([b"alpha", b"beta"])[0].view(np.int64).tolist()
    counts = {(r.prefix, r.n) for r in tree.sequences[1].collect()}
    assert (alpha, 3) in counts and (beta, 3) in counts  # alpha beta, beta END


def test_weights_met_by_a_join_give_the_same_scores(spark, monkeypatch):
    rows = corpus(40, 7)
    df = documents(spark, [(i, t, None) for i, t in rows])
    texts = df.select("doc_id", suffixtree.F.col("text").cast("binary").alias("text"))
    monkeypatch.setattr(suffixtree, "WORD_SHARE", 0.05)
    tree, counts = suffixtree.fit(texts.filter(suffixtree.remainder("doc_id", 10) != 0))
    assert tree.weights.filter(suffixtree.F.col("n") < 0.05 * tree.total).count()
    got = {r.doc_id: r.score for r in suffixtree.score_texts(texts, tree, counts).collect()}
    for i, score in plain_scores(rows, tree):
        assert math.isclose(got[i], score, rel_tol=1e-6), i


def test_what_a_level_needed_goes_from_the_disk(spark, tmp_path, monkeypatch):
    """sequences, chances and other tables of all levels stayed in the shared folder until the end."""
    monkeypatch.setattr(jobfolder, "shared_dir", lambda spark: str(tmp_path))
    assert suffixtree.scores(documents(spark, [(i, t, None) for i, t in corpus(30, 3)])).count() == 30
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {"word-counts", "kept-contexts", "weights", "scores"}


def test_sequences_travel_as_pieces_of_buckets():
    """a row for each sequence and task was shuffled."""
    rng = np.random.default_rng(1)
    prefix, suffix = (rng.integers(0, 1 << 63, 30, np.uint64)[rng.integers(0, 30, 5000)] for _ in range(2))
    key = suffixtree.sequence_key(prefix, suffix)
    parts = [suffixtree._summed(key[a : a + 1000], prefix[a : a + 1000]) for a in range(0, 5000, 1000)]
    rows = [suffixtree._pieces(16, *part) for part in parts]
    assert all(len(r[0]) <= 16 for r in rows)
    table = suffixtree.pa.concat_tables(suffixtree.pa.Table.from_arrays(r, ["bucket", "key", "prefix", "n"]) for r in rows)
    got = Counter()
    for bucket in range(16):
        own = table.filter(suffixtree.pa.compute.equal(table["bucket"], bucket))
        if own.num_rows:
            out = suffixtree._lister(5)(own).to_pydict()
            got.update({(p, s): n for p, s, n in zip(out["prefix"], out["suffix"], out["n"], strict=True)})
    signed = Counter(zip(prefix.view(np.int64).tolist(), suffix.view(np.int64).tolist(), strict=True))
    assert got == {k: n for k, n in signed.items() if n >= 5}
