import hashlib
from collections import Counter

import pytest

from cuelake.llm import linedup
from tests.llm.tables import cases, documents, empty


def plain(rows, min_docs, least_chars=1):
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").encode().split(b"\n")})
    out = []
    for doc_id, text in rows:
        lines = (text or "").encode().split(b"\n")
        stay = [x for x in lines if len(key(x).decode()) < least_chars or count[key(x)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest()))
    return sorted(out, key=repr)


def report(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (4, 3), (9, 2), (6, 10)])
def test_counts_are_the_same_however_the_table_is_batched(spark, batches, fan_in):
    rows = [
        (k, "\n".join([f"only {k}", "  In All\t", "É of all", *[f"of {m}" for m in (2, 3, 5) if k % m == 0], *["twice here"] * (k % 2 * 2), ""]))
        for k in range(30)
    ]
    df = documents(spark, [(i, t, None) for i, t in rows])
    for bar in (5, 10, 15):
        assert report(linedup.line_report(df, bar, 1, batches, fan_in)) == plain(rows, bar)


def test_least_chars_are_code_points(spark):
    rows = [(k, "éé\nabc\nx") for k in range(3)]
    df = documents(spark, [(i, t, None) for i, t in rows])
    for least in (1, 2, 3, 4):
        assert report(linedup.line_report(df, 3, least)) == plain(rows, 3, least)


def test_cases(spark):
    docs = cases(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert report(linedup.line_report(docs, 2)) == plain(rows, 2)
    rewritten = linedup.without_common_lines(docs, 2)
    assert rewritten.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in rewritten.collect()), key=repr)
    gone = {t for _, t in rows if sum(t == u for _, u in rows) > 1 and t}
    want = [(i, "" if t in gone else t, None if t is None else 0 if t in gone else len(t)) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert linedup.line_report(empty(spark)).count() == 0
    assert linedup.without_common_lines(empty(spark)).count() == 0
