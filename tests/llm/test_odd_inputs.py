"""Clashing and dotted names, null ids, repeated rows, empty tables: through every operator and stage that keeps columns."""

import public_tokenizers
import pytest

from tessera.llm import decontamination, html_text, license_scan, lm_scoring, near_dedup, substring_dedup, token_counts, toxicity
from tessera.llm.bpe import encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
NAMES = ["doc_id", "text", "lang", "a.b", "__id", "__hash", "label", "toxicity", "license", "n_words", "body", "c0", "node", "key", "ids", "item_id", "n_chars"]


@pytest.fixture(scope="module")
def odd(spark):
    row = lambda i, t: (i, t, "en", *[f"x{k}" for k in range(len(NAMES) - 4)], 7)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [row(1, base), row(2, base + " tail"), row(2, base + " tail"), row(None, base), row(None, None), row(3, None), row(4, ""), row(5, "one two"), row(6, "long " * 40_000), row(7, "un test")]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES)).repartition(2)


def _kept(out, odd, *new):
    want = [n if n not in new else n + "_in" for n in NAMES] + list(new)
    assert out.columns == want
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r[k] == f"x{k - 3}" for r in rows for k in range(3, len(NAMES) - 1))
    return rows


def test_columns_stay(odd):
    _kept(encode_decode(odd, PATH), odd, "n_tokens", "ids", "decoded")
    _kept(substring_dedup.remove_repeats(odd), odd, "n_words", "n_removed", "kept_text")
    _kept(license_scan.scan(odd), odd, "digest", "license", "notices")
    _kept(toxicity.score(odd, toxicity.Model()), odd, "toxicity")
    _kept(html_text.extract(odd.withColumnRenamed("text", "html").withColumnRenamed("body", "text").withColumnRenamed("html", "body"), html_column="body").select("*").toDF(*[n + ("_in" if n in ("text", "n_chars") else "") for n in NAMES], "text", "n_chars"), odd, "text", "n_chars")


def test_a_text_column_of_another_name(odd):
    other = odd.withColumnRenamed("body", "bodies").withColumnRenamed("text", "body").withColumnRenamed("bodies", "text")
    assert {r.n_tokens for r in encode_decode(other, PATH, text="body").collect()} == {r.n_tokens for r in encode_decode(odd, PATH).collect()}
    assert sorted(r.n_removed for r in substring_dedup.remove_repeats(other, text="body").collect()) == sorted(r.n_removed for r in substring_dedup.remove_repeats(odd).collect())
    assert html_text.extract(other, html_column="body").count() == odd.count()
    assert html_text.extract(odd, html_column="text").columns == [n if n not in ("text", "n_chars") else n + "_in" for n in NAMES] + ["text", "n_chars"]


def test_rows_stay_whole_where_some_go(odd, spark):
    kept = near_dedup.keep_first(odd)
    assert kept.columns == NAMES and {r["doc_id"] for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 7}
    items = spark.createDataFrame([(1, "one two", "z"), (None, None, "z")], "item_id long, text string, doc_id string")
    left = decontamination.drop_contaminated(odd, items)
    assert left.columns == NAMES and left.filter("doc_id = 5").count() == 0 and left.count() == odd.count() - 1
    assert lm_scoring.backoff_scores(odd).count() == token_counts.token_counts(odd, public_tokenizers.path("byte_bpe_50k.json")).count() == odd.count()
    labels = odd.selectExpr("doc_id", "int(doc_id % 2) AS toxic", "label", "text")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == odd.count()


def test_every_stage(odd, spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = odd.filter("doc_id is not null").selectExpr("doc_id", "int(0) AS toxic", "label")
    empty = {"labels": labels.limit(0), "benchmark": spark.createDataFrame([], "item_id long, text string")}
    full = {"labels": labels, "benchmark": spark.createDataFrame([(1, "one two")], "item_id long, text string")}
    for name, tables in (("empty", empty), ("full", full)):
        sf = f"{tmp_path}/{name}"
        for t, df in tables.items():
            df.write.parquet(f"{sf}/{t}.parquet")
        for docs in (odd, odd.limit(0)):
            for _, stage in pipeline.STAGES:
                before = docs
                docs = stage(spark, docs, sf)
                if stage is not pipeline.encode:
                    assert docs.columns == NAMES
                    docs.write.mode("overwrite").parquet(f"{sf}/{id(docs)}")
                    docs = spark.read.schema(docs.schema).parquet(f"{sf}/{id(docs)}")
                    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if docs.count():
                assert {1, 3, 4, 6, 7} <= {r.doc_id for r in docs.collect()} and (docs.filter("doc_id = 5").count() == 0) == (name == "full")
