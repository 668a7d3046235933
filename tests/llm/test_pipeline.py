import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    from tessera.llm.common import materialise, read

    docs = read(spark, sf_dir, "documents")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    for name, stage in pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        columns = docs.columns
        docs = materialise(stage(spark, docs, sf_dir))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name != "bpe":
            assert docs.columns == columns
        if name in ("substring_dedup", "bpe"):
            assert after == before
    assert docs.count() == len(after) > 100


def test_stages_agree_with_brute_force(spark, sf_dir):
    from tests.llm import brute_stages

    brute_stages.check(spark, sf_dir, pipeline)
