from collections import Counter
from math import log

import pytest

from tessera.llm.lm_scoring import ALPHA, backoff_scores, ngram_counts


def brute(rows, corpus=None):
    """corpus None: all other rows."""
    split = lambda t: (t or "").encode().split()
    grams = lambda t: Counter(tuple(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    every = Counter()
    for _, t in rows if corpus is None else corpus:
        every.update(grams(split(t)))
    total = sum(n for g, n in every.items() if len(g) == 1)
    out = []
    for i, text in rows:
        t = split(text)
        own = grams(t) if corpus is None else Counter()
        n = total - (len(t) if corpus is None else 0)
        c = lambda *g: every[g] - own[g]  # noqa: B023, E731
        score = 0.0
        for k, w in enumerate(t):
            for back, size in enumerate(range(min(k, 2), -1, -1)):
                g = tuple(t[k - size : k + 1])
                if c(*g) or not size:
                    score += back * log(ALPHA) + (log(c(*g) / (c(*g[:-1]) if size else n)) if c(*g) else -log(n + 1))
                    break
        out.append((i, len(t), round(score, 5)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, round(r.score, 5)) for r in df.collect()), key=repr)


def same(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-3)


def test_scores_by_the_other_documents(docs, rows):
    same(got(backoff_scores(docs)), brute(rows))


def test_ngrams_that_the_corpus_lacks_back_off(docs, rows, spark):
    corpus = rows[:12]
    same(got(backoff_scores(docs, spark.createDataFrame(corpus, "doc_id long, text string"))), brute(rows, corpus))


def test_a_hot_word_is_spread(spark):
    rows = [(i, " ".join(["the", f"x{i % 7}"] * 50)) for i in range(40)]
    same(got(backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows))


def test_empty(none):
    assert got(backoff_scores(none)) == []


def test_the_number_of_buckets_changes_nothing(docs, rows):
    same(got(backoff_scores(docs, buckets=300)), brute(rows))


def test_count_tables(docs, rows):
    n = sum(max(0, len((t or "").split()) - k) for _, t in rows for k in range(3))
    table = ngram_counts(docs)
    assert table.agg({"n": "sum"}).first()[0] == n
    assert table.select("gram").distinct().count() == table.count()


def test_what_travels_grows_with_the_items_not_with_the_buckets():
    """Bytes of questions and answers of one small block, from 8 to 4096 buckets."""
    import pyarrow as pa

    from tessera.llm import lm_scoring, token_counts

    texts = [" ".join(f"w{hash((i, j)) % 4000}" for j in range(120)) for i in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts), pa.array([0] * 3000)], names=["doc_id", "text", "part"])
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    for send, answer in ((lambda n: lm_scoring._send(iter([batch]), 3, 48, n, True), lm_scoring._answer), (lambda n: token_counts._send(iter([batch]), path, n), lambda it: token_counts._count(it, path))):
        sizes = []
        for n in (8, 64, 512, 4096):
            asked = list(send(n))
            told = list(answer(iter(asked)))
            values = sum(len(v) for b in told for v in b.column("values").to_pylist() if v) + 40 * sum(b.num_rows for b in told)
            sizes.append(sum(b.nbytes for b in asked) + values)
        assert sizes[2] < 1.5 * sizes[0], sizes
        assert sizes[3] - sizes[0] < 220 * 4096, sizes  # a row for each bucket
