import corpus_pipeline
from cuelake.llm import linedup, neardup, tiling, toxicity
from cuelake.llm.jobs import LLM_ORACLE, LLM_QUERIES
from tests.llm.test_packing import check
from tests.llm.test_packing import tokenizer as tokenizer  # noqa: PLC0414 - a fixture

SF = "/root/testdata/sf0.001"


def test_each_stage_over_all_rows_before_it(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.kept(stage(spark, docs, SF), "stage")
        before = {r.doc_id: r.text for r in docs.collect()}
        if name != "packing":
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            net = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in toxicity.score_texts(docs, net).collect() if r.score < 0.7}
            assert len(after) > 0.8 * rows
        elif name == "line dedup":
            report = {r.doc_id: r for r in linedup.line_report(docs).collect()}
            assert set(after) == set(before)
            for i, text in after.items():
                gone = report[i].n_lines - report[i].n_dropped
                assert len(text.split("\n")) == max(1, gone) and (report[i].n_dropped or text == before[i])
        elif name == "near dedup":
            of = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
            assert set(after) == set(of.values())
        elif name == "decontamination":
            leaks = {r.doc_id for r in tiling.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaks
        else:
            check(out.collect(), list(before.items()), tokenizer, 1024)
        docs = out


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLE) <= set(LLM_QUERIES)
    # these are held against plain versions or held-out labels in their own modules of this folder
    assert {int(name[2:].split("_")[0]) for name in set(LLM_QUERIES) - set(LLM_ORACLE)} == {2, 3, 5, 6, 7, 10, 12, 13}
