import re
from collections import Counter, defaultdict

import pytest

from cuelake.llm import divergence
from tests.llm.tables import cases, documents, empty, prose


def plain(rows, min_docs, top=10):
    """Plain loops over every language, source, other source and term."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    group, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = term.findall((text or "").translate(lower))
        group[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang, docs in held.items():
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {s: {t: c[t] for t in kept} for (g, s), c in group.items() if g == lang}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def gap(p, q):
            return (p - q) * (p - q) // (p + q)

        for source, c in counts.items():
            pairs = [(sum(gap(share(c, t), share(d, t)) for t in kept), s) for s, d in counts.items() if s != source]
            terms = [(gap(share(c, t), share(whole, t)), t) for t in kept if c[t] > 0 and share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out.extend((lang, source, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)


ROWS = [
    (f"{prose(k % 7, 30 + k)} ÉTÉ été I{chr(0x130)} x{k % 5}y\n{'Zed ' * (k % 4)}", ["en", "fr", None][k % 3], [f"s{k % 5}", "", None, "s1"][k % 4])
    for k in range(60)
] + [("", "en", "no words"), (None, "de", "alone"), (None, "de", "second"), ("rare words only", "it", "a"), ("other", "it", "b")]


@pytest.mark.parametrize(("min_docs", "bits"), [(1, 64), (4, 64), (3, 4), (10, 8)])
def test_equals_plain_loops_also_where_digests_meet(spark, min_docs, bits):
    got = rows_of(divergence.divergence(table(spark, ROWS), min_docs, 10, bits))
    assert got == plain(ROWS, min_docs)


def test_blocks_chunks_and_flushes_change_nothing(spark, monkeypatch):
    for name, value in (("CHUNK", 2), ("BLOCK_ENTRIES", 7), ("HELD_TERMS", 20), ("PIECE", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.divergence(table(spark, ROWS[:40]), 3)) == plain(ROWS[:40], 3)


def test_cases(spark):
    docs = cases(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert rows_of(divergence.divergence(docs, 1)) == plain(rows, 1)
    assert divergence.divergence(empty(spark)).count() == 0
    tied = [("one two three four", "en", "a"), ("zwölf", "en", "b")] * 12
    df = documents(spark, [(1, t, g) for t, g, _ in tied]).drop("source", "group_key")
    assert rows_of(divergence.divergence(df.withColumn("source", df.text), 10, top=2)) == plain([(t, g, t) for t, g, _ in tied], 10, 2)
