import random
import re

import pyarrow as pa
import pytest

from tessera.llm.decontamination import drop_contaminated, find_items


def runs(text):
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items, least=0.8):
    out = set()
    for i, t in items:
        q = runs(t)
        for d, x in docs:
            if q and len(q & runs(x)) >= least * len(q):
                out.add((d, i))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases():
    r = random.Random(2)
    text = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([3, 5, 6, 9, 12, 13, 20, 33, 47, 64, 90, 300] * 3)]
    docs = []
    for i in range(120):
        own = text(r.choice([0, 2, 30, 300, 4000]))
        if i % 2:
            item = list(r.choice(items)[1])
            if i % 4 == 1 and len(item) > 40:
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(own) + 1)
            own[at:at] = item
        docs.append((i, " ".join(own).upper() + "!" if i % 3 else ", ".join(own)))
    docs += [(500, None), (None, " ".join(items[7][1])), (501, "")]
    items = [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (0, " ".join(items[0][1]))]
    return docs, items


def test_finds_what_brute_force_finds(spark, cases):
    docs, items = cases
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    assert sorted({(r.doc_id, r.item_id) for r in rows}, key=repr) == brute(docs, items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    assert all(r.containment == r.n_shared / r.n_runs >= 0.8 for r in rows)


def test_short_and_repetitive_items_are_never_missed():
    from tessera.llm import decontamination

    r = random.Random(7)
    items = [(i, " ".join(f"i{i}v{j}" for j in range(5 + i % 8))) for i in range(800)] + [(800 + i, " ".join(f"p{i}q{j % 11}" for j in range(60))) for i in range(50)]
    docs = [(i, " ".join([t] + [f"z{r.randrange(5000)}" for _ in range(40)])) for i, t in items]
    batch, texts = (pa.record_batch([pa.array([i for i, _ in x]), pa.array([t for _, t in x]), pa.array([i for i, _ in x])], names=["doc_id", "text", "text_hash"]) for x in (docs, items))
    index = decontamination.Index(texts.column(1), 0.8)
    found = [f for b in decontamination._find(iter([batch]), index, texts.column(0), 0.8) for f in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    assert sorted(found) == [(i, i) for i, _ in items]


def test_items_in_several_groups(spark, cases, monkeypatch):
    from tessera.llm import decontamination

    monkeypatch.setattr(decontamination, "GROUP_ITEMS", 10)
    docs, items = cases
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted({(r.doc_id, r.item_id) for r in found.collect()}, key=repr) == brute(docs, items)


def test_drops_the_documents(spark, docs, cases):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    one = spark.createDataFrame([(1, "x y z one two three four five six seven"), (2, "clean words only")], "doc_id long, text string")
    assert [r.doc_id for r in drop_contaminated(one, spark.createDataFrame([(9, "one two three four five six")], "item_id long, text string")).collect()] == [2]


def test_empty(none, spark, docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_items(none, items).collect() == []
    assert find_items(docs, items.limit(0)).collect() == []


def test_a_large_benchmark_goes_in_groups(spark, monkeypatch):
    """50,000 items: what the driver holds at once is bounded by a group."""
    from tessera.llm import decontamination

    held = []
    own = decontamination.column
    monkeypatch.setattr(decontamination, "column", lambda t, n: held.append(t.num_rows) or own(t, n))
    items = spark.range(50_000).selectExpr("id AS item_id", "concat_ws(' ', 'item', id, id + 1, id * 7, 'of', id % 13, 'words') AS text")
    docs = spark.createDataFrame([(i, f"before item {i} {i + 1} {i * 7} of {i % 13} words after") for i in range(0, 50_000, 5000)] + [(-1, "nothing here")], "doc_id long, text string")
    got = decontamination.find_items(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(0, 50_000, 5000)]
    assert len(held) >= 10 and max(held) < 1.2 * decontamination.GROUP_ITEMS
