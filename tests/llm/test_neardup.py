import random

import numpy as np
import pyarrow as pa

from cuelake.llm import neardup, words
from cuelake.llm.components import components
from cuelake.llm.jobfolder import kept
from tests.llm.tables import cases, documents, empty, prose


def set_of(text):
    return neardup._set_of((text or "").lower().encode())


def plain_classes(rows):
    """Least id of each row's class, by comparing all pairs."""
    sets, parent = [set_of(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") if not len(sets[i][0]) or not len(sets[j][0]) else (
                neardup.similarity(sets[i], sets[j]) >= 0.8
            )
            if same:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(((doc_id, least.get(top(i))) for i, (doc_id, _) in enumerate(rows)), key=repr)


def edited(text, rng, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for alike in (0.4, 0.8):
        gaps = []
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**62, 150).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * alike)], rng.integers(0, 2**62, 20).astype(np.uint64)]))
            x, y = (a, rng.integers(1, 5, len(a))), (b, rng.integers(1, 5, len(b)))
            s = neardup.signatures([x, y])
            gaps.append((s[0] == s[1]).mean() - neardup.similarity(x, y))
        assert abs(np.mean(gaps)) < 0.02 and np.max(np.abs(gaps)) < 0.14


def test_a_signature_doesnt_depend_on_its_company():
    sets = [set_of(prose(k, n)) for k, n in ((1, 3), (2, 60), (3, 4000), (4, 6))]
    together = neardup.signatures(sets)
    assert all((neardup.signatures([s])[0] == together[k]).all() for k, s in enumerate(sets))


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for family in range(12):
        base = prose(family * 5, 120)
        rows += [(len(rows) + k, edited(base, rng, share)) for k, share in enumerate([0, 0, 0.01, 0.02, 0.03, 0.04, 0.3])]
    rng.shuffle(rows)
    got = neardup.classes(documents(spark, [(i, t, None) for i, t in rows]))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == plain_classes(rows)
    assert sum(r.first for r in got.collect()) == len({c for _, c in plain_classes(rows)})


def test_a_chain_without_a_common_neighbour_is_one_class(spark):
    """Each text is like the next one only: no single hub shows that they belong together."""
    parts = prose(9, 400).split()
    rows = [(k, " ".join(parts[k * 10 : k * 10 + 200])) for k in range(15)]
    got = neardup.classes(documents(spark, [(i, t, None) for i, t in rows]))
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == plain_classes(rows)


def test_cases(spark):
    docs = cases(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.classes(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == plain_classes(rows)
    stay = neardup.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in stay.collect()) == [-1, 1, 2, 4, 5, 6, 9, 10, 12]
    assert neardup.classes(empty(spark)).count() == 0
    assert neardup.one_of_each(empty(spark)).count() == 0


def test_common_parts_of_sets():
    rng = np.random.default_rng(4)
    few = [np.unique(rng.integers(0, 400, rng.integers(1, 60))).astype(np.uint64) for _ in range(50)]
    many = [np.unique(rng.integers(0, 70, 60)).astype(np.uint64) for _ in range(40)]
    for a, b in ((few, many), (many, many), (few, few[:3])):
        assert (neardup.common_parts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_a_large_family_around_the_threshold(spark):
    """Many copies of one text, most of them less alike than 0.8 to one another, in small blocks."""
    rng = random.Random(8)
    base = prose(2, 100)
    rows = [(k, edited(base, rng, rng.choice([0.01, 0.02, 0.03, 0.04]))) for k in range(150)]
    got = neardup.classes(documents(spark, [(i, t, None) for i, t in rows]), block_texts=16)
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == plain_classes(rows)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 3), (7, 8), (10, 11), (11, 12), (12, 10), (12, 20)], "a long, b long")
    found = {}
    for r in components(links).collect():
        found.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 7, 8], [10, 11, 12, 20]]
    assert components(links.limit(0)).count() == 0


def test_words_of_a_long_text_are_those_of_its_parts():
    text = (" ".join(prose(k, 300) for k in range(800))).encode()
    assert len(text) > words.CHUNK_BYTES
    whole = words.hashes([text])[0]
    parts = [g for _, group in words.by_text([text, b"a b"]) for g in group]
    assert (parts[0] == whole).all() and len(parts[1]) == 2


def test_small_tables_stay_in_few_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(a, a + 1) for a in range(0, 40, 2)] + [(0, 2), (0, 4)], "a long, b long")
        found = components(links)
        assert found.rdd.getNumPartitions() == 1
        assert len({r.label for r in found.collect()}) == 18
        members = spark.createDataFrame([(k % 9, k) for k in range(60)], "key long, node long")
        met, hubs = neardup._meetings(members, 60)
        assert met.count() == 60 and hubs.count() == 9
        assert len(met.inputFiles()) == len(hubs.inputFiles()) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches_of_texts_are_small_only_while_they_are_asked_for(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 5000, 1, 1).withColumnRenamed("id", "n").mapInArrow(sizes, "n long")
    assert max(r.n for r in kept(rows, "batches", 700).collect()) == 700
    assert spark.conf.get(key) == before
