import random

from cuelake.llm import langid
from tests.llm.tables import cases, documents, empty

SYLLABLES = {"aa": "an ou th er st in re on ed".split(), "bb": "sch ei ung keit ver ge ich".split(), "cc": "eau aux oi é tion que".split()}


def text(lang, rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n=240, seed=1):
    rng = random.Random(seed)
    return [(k, text(lang := rng.choice("aa bb cc".split()), rng), lang) for k in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    got = langid.languages(documents(spark, rows())).collect()
    truth = {k: lang for k, _, lang in rows()}
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in held)
    assert sum(r.rejected for r in held) < 0.2 * len(held)
    odd = documents(spark, [*rows(), (1000, "zyx kwq vvv qqq jjj xxk wqz", None)])
    assert [r.rejected for r in langid.languages(odd).collect() if r.doc_id == 1000] == [True]


def test_held_out_labels_are_never_learned(spark):
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(documents(spark, rows())).collect()}
    df = documents(spark, rows())
    hidden = df.withColumn("lang", langid.F.when(langid.remainder("doc_id", 4) == 2, "zz").otherwise(df.lang))
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(hidden).collect()} == plain


def test_counts_of_a_long_text_are_those_of_its_parts(monkeypatch):
    data = text("cc", random.Random(3), 500).encode()
    whole = langid.count_grams([data])
    parts = sum(langid.np.bincount(b, minlength=langid.BUCKETS) for b in langid._buckets(data, 37))
    assert (whole[0] == parts).all()


def test_cases(spark):
    got = langid.languages(cases(spark)).collect()
    assert len(got) == 13
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 9) or (r.doc_id is None and r.score == 0.0))
    assert langid.languages(empty(spark)).count() == 0
    assert langid.languages(documents(spark, [(1, "text", None)])).first().lang_pred == "und"
