"""The pipeline's middle stages beside plain Python on the smallest table."""

from tessera.llm.common import read
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_dedup import classes
from tests.llm.test_substring_dedup import brute as cut


def check(spark, sf_dir, pipeline):
    stage = dict(pipeline.STAGES)
    docs = read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = stage["near_dedup"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in classes(rows)})
    texts = {r.doc_id: r.text for r in stage["substring_dedup"](spark, docs, sf_dir).collect()}
    own = dict(rows)
    assert texts == {i: k if n else own[i] for i, _, n, k in cut(rows, 13)}
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    clean = {r.doc_id for r in stage["decontamination"](spark, docs, sf_dir).select("doc_id").collect()}
    assert clean == set(own) - {d for d, _ in leaks(rows, items)}
