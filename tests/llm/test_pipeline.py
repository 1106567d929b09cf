"""The pipeline stage by stage, each against a plain version on its own input."""

import pytest

import corpus_pipeline
from adtally.llm.registered import QUERIES
from test_join import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), [("documents", None)]
    out[0] = ("documents", docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    columns = stages[0][1].columns
    assert all(frame.columns == columns for _, frame in stages[:-1])
    counts = [frame.count() for _, frame in stages[:4]]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[2][1].collect()]
    want = sorted(n for n, _, least in brute(before) if n == least)
    assert sorted(r.doc_id for r in stages[3][1].collect()) == want


def test_the_mix_holds_whole_documents(stages):
    before = {r.doc_id: r.text for r in stages[3][1].collect()}
    after = stages[4][1].collect()
    assert all(before[r.doc_id] == r.text for r in after)
    assert max(sum(r.doc_id == n for r in after) for n in before) <= 3


def test_every_document_of_the_mix_is_packed(stages):
    mix = stages[4][1].groupBy("doc_id").count().collect()
    pieces = stages[5][1].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    copies = {r.doc_id: r["count"] for r in mix}
    assert {r.doc_id: r["sum(length)"] for r in pieces} == {r.doc_id: copies[r.doc_id] * r["max(doc_tokens)"] for r in pieces}
    assert all(len(r.ids) == r.length for r in stages[5][1].select("ids", "length").collect())


def test_repeated_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    text = "one two three four five six seven eight"
    rows = [(2, text), (2, text), (1, text), (None, text), (3, None), (None, None)]
    frame = spark.createDataFrame([(n, t, None, None, None) for n, t in rows], schema)
    kept = corpus_pipeline.one_of_similar(spark, frame, FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, text), (0, text), (3, ""), (0, "")])
    assert corpus_pipeline.mix_sources(spark, frame.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.pack_sequences(spark, frame.limit(0), FOLDER).count() == 0


def test_the_registered_pipeline(spark):
    assert QUERIES["pipeline"](spark, FOLDER).count() > 0
