from __future__ import annotations

import pytest

import corpus_pipeline
from helixframe.llm import secrets, toxicity
from helixframe.llm.common import materialise, table
from tests.llm import test_decontaminate, test_jaccard, test_secrets


@pytest.fixture(scope="module")
def stages(spark, small):
    """Each stage's input and output, written between stages as in a run."""
    docs, out = table(spark, small, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = materialise(stage(spark, docs, small), f"test-stage-{k}")
        out.append((name, docs, made))
        docs = made
    return out


def test_every_stage_but_the_last_returns_documents(stages):
    assert [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    first = stages[0][1]
    for _, _, made in stages[:-1]:
        assert made.dtypes == first.dtypes


def test_toxic_documents_go(spark, small, stages):
    _, docs, kept = stages[0]
    model = toxicity.train(docs, table(spark, small, "labels"))
    scored = toxicity.score_documents(docs, model)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.filter("predicted = 0").collect()}


def test_one_of_each_class_stays(stages):
    _, docs, kept = stages[1]
    classes = test_jaccard.brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in classes})


def test_contaminated_documents_go(spark, small, stages):
    _, docs, kept = stages[2]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    want = {r.doc_id for r in docs.collect() if not test_decontaminate.brute(r.text, items)[4]}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < docs.count()


def test_secrets_are_replaced(stages):
    _, docs, clean = stages[3]
    before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, clean))
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert r.text == secrets.redact(before[k].text) and r.n_chars == len(r.text)
        assert test_secrets.brute(r.text)[0] == (0, 0, 0)


def test_run_is_the_chain_of_stages(spark, small, stages):
    columns = ["doc_id", "n_tokens", "domain", "rate"]
    run = corpus_pipeline.run(spark, small).select(columns)
    assert sorted(map(str, run.collect())) == sorted(map(str, stages[-1][2].select(columns).collect()))


def test_odd_documents_pass(spark, small, edges, tmp_path):
    """Nulls, repeats and clashing columns through every stage; an empty table too."""
    for t in ("labels", "benchmark"):
        table(spark, small, t).write.parquet(f"{tmp_path}/{t}.parquet")
    for docs in (edges, edges.limit(0)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, str(tmp_path)), "test-odd")
            assert docs.columns == names, name
            assert docs.filter("score <> 'clash' or n_words <> 'clash' or spans <> 'clash'").count() == 0, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()
    assert docs.count() == 0
