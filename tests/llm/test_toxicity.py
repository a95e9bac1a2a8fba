import random

import numpy as np
from pyspark.sql import functions as F

from cuelake.llm import toxicity
from tests.llm.tables import cases, documents, empty, prose

BAD = ["snarfle", "glump", "zorky", "vexil"]


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = prose(k, rng.choice([30, 60, 150])).split()
        bad = rng.random() < 0.25
        for _ in range(3 * bad):
            word = rng.choice(BAD) + rng.choice(["", "", "ing", f"x{rng.randrange(99)}"])
            words[rng.randrange(len(words))] = word
        rows.append((k, " ".join(words), int(bad)))
    return rows


def labels(spark, rows):
    return spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, score string")


def test_gradients_are_the_losses_slopes():
    texts = [b"you snarfle go away now", b"hello world this is fine", b""]
    vocabulary, index, owner = toxicity.read_words(texts)
    windows, _ = toxicity.windows_of(index, owner, 3)
    net = toxicity.Network.fresh(np.sort(vocabulary.hash[:3]), 0.7, 1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    y, w = np.array([1.0, 0, 0]), np.array([2.0, 1, 1])
    grads = net.gradients(vocabulary, net.word_rows(vocabulary), windows, y, w)

    def loss():
        p = toxicity._sigmoid(net.forward(net.inputs(vocabulary), windows))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    for name, values in net.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), values.shape)
        old = values[at]
        values[at] = old + 1e-4
        up = loss()
        values[at] = old - 1e-4
        down = loss()
        values[at] = old
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        windows, text = toxicity.windows_of(np.arange(n), np.zeros(n, int), 1)
        assert set(windows[windows >= 0].tolist()) == set(range(n))
        assert len(windows) >= 1 and (text == 0).all()
        if n > toxicity.WINDOW:
            assert (windows >= 0).all()


def test_scores_dont_depend_on_company_or_padding():
    net = toxicity.Network.fresh(np.empty(0, np.uint64), 0.7, 1)
    texts = [prose(1, 5).encode(), prose(2, 100).encode(), b"", prose(3, 33).encode()]
    together = net.logits(texts)
    assert np.allclose([net.logits([t])[0] for t in texts], together, atol=1e-5)


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = documents(spark, [(i, t, None) for i, t, _ in rows])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels(spark, rows)).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_never_learned(spark):
    rows = labelled(150)
    docs = documents(spark, [(i, t, None) for i, t, _ in rows])
    marks = labels(spark, rows)
    turned = marks.withColumn("toxic", F.when(toxicity.remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda m: {r.doc_id: r.score for r in toxicity.toxicity(docs, m).collect()}
    assert score(marks) == score(turned)


def test_cases(spark):
    rows = labelled(200)
    docs = documents(spark, [(100 + i, t, None) for i, t, _ in rows]).unionByName(cases(spark))
    marks = labels(spark, [(100 + i, t, y) for i, t, y in rows]).unionByName(
        spark.createDataFrame([(None, 1, "x"), (2, 1, "x"), (3, None, "x"), (6, 0, "x"), (6, 1, "x")], "doc_id long, toxic int, score string")
    )
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 213 and all(0 <= r.score <= 1 for r in got)
    net = toxicity.fit(docs, marks)
    stay = toxicity.without_toxic(docs, net)
    assert stay.columns == docs.columns and stay.count() == sum(r.score < 0.7 for r in toxicity.score_texts(docs, net).collect())
    assert toxicity.toxicity(empty(spark), marks).count() == 0
    none = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert len(none) == 213 and {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_words_of_a_large_sample_are_read_in_groups(monkeypatch):
    """Pipeline, toxicity: hashing the whole sample at once took about 30 bytes for each byte of it."""
    texts = [prose(k, 40).encode() for k in range(300)] + [b"", b"Snarfle snarfle"]
    whole = toxicity.read_words(texts)
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 5000)
    parted = toxicity.read_words(texts)
    for a, b in zip([*vars(whole[0]).values(), *whole[1:]], [*vars(parted[0]).values(), *parted[1:]], strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
    assert toxicity.read_words([])[0].hash.size == 0
    monkeypatch.undo()
    sizes, read = [], toxicity.words.hash_spans

    def hash_spans(joined, start, end):
        sizes.append(len(joined))
        return read(joined, start, end)

    monkeypatch.setattr(toxicity.words, "hash_spans", hash_spans)
    toxicity.read_words([b"one two " * 2000] * 400)  # 6.4 MB
    assert max(sizes) < 1 << 21
