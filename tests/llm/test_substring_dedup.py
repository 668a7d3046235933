
import pytest

from tessera.llm.substring_dedup import remove_repeats


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [13, 4, 20])
def test_removes_what_brute_force_removes(docs, rows, window):
    out = remove_repeats(docs, window)
    assert set(docs.columns) < set(out.columns) and out.columns[-3:] == ["n_words", "n_removed", "kept_text"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=repr) == brute(rows, window)


def test_a_common_passage_over_many_blocks(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df).collect()), key=repr) == brute(rows, 13)


def test_texts_of_one_word(spark):
    rows = [(1, "same " * 70_000), (2, "same " * 70_000 + "x"), (3, "x " + "same " * 20)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 70_000, 0), (2, 70_001, 70_000), (3, 21, 20)]


def test_empty(none):
    assert remove_repeats(none).collect() == []
