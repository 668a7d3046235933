import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import near_dedup
from tessera.llm.common import U64, mix
from tessera.llm.near_dedup import bag_minhash, components, keep_first, near_duplicates


def classes(rows, least=0.8):
    """Class of each row's text: the smallest doc_id of its connected component."""
    bags = {}
    for _, t in rows:
        w = (t or "").encode().split()
        if w:
            bags[tuple(w)] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    keys = list(bags)
    parent = {k: k for k in keys}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values()):
                parent[find(a)] = find(b)
    least_id = defaultdict(lambda: None)
    for i, t in rows:
        w = tuple((t or "").encode().split())
        if w and i is not None:
            k = find(w)
            least_id[k] = i if least_id[k] is None else min(i, least_id[k])
    return sorted(((i, least_id[find(tuple(t.encode().split()))] if (t or "").split() else i) for i, t in rows), key=repr)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = mix(np.arange(1, 300, dtype=U64))
    a, b = rng.integers(0, 9, 299), rng.integers(0, 9, 299)
    a[:150], b[:150] = 5, 5
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    e = np.concatenate([elements[a > 0], elements[b > 0]])
    o = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    s = bag_minhash(e, o, np.concatenate([a[a > 0], b[b > 0]]), 2, 8192)
    assert (s[0] == s[1]).mean() == pytest.approx(truth, abs=0.03)


def test_classes(docs, rows):
    got = near_duplicates(docs)
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=repr) == classes(rows)


@pytest.mark.parametrize("runs", [1 << 19, 500])
def test_large_groups_of_copies(spark, monkeypatch, runs):
    monkeypatch.setattr(near_dedup, "BLOCK_RUNS", runs)
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for i in range(40):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(100)] = f"x{r.random()}"
            rows.append((g * 1000 + i, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((x.doc_id, x.class_id) for x in got.collect()), key=repr) == classes(rows)


def test_links_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(60):
        own = [f"w{j}" for j in range(100)]
        for at in r.sample(range(20), 1 if i % 3 else 3):  # by its own and by a shared word
            own[5 * at] = f"x{r.randrange(4)}" if i % 2 else f"y{i}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for runs in (1 << 19, 1000, 200):
        monkeypatch.setattr(near_dedup, "BLOCK_RUNS", runs)
        found.append(sorted((x.doc_id, x.class_id) for x in near_duplicates(docs, bands=1, rows=1, similarity=0.88).collect()))
    assert found[0] == found[1] == found[2]
    assert 1 < len({c for _, c in found[0]}) < 60


def test_a_bucket_of_many_classes(spark):
    """5000 texts in one bucket (a single band of one row that all share), 500 classes."""
    r = random.Random(3)
    rows = []
    for i in range(5000):
        own = [f"c{i % 500}w{j}" for j in range(20)]
        own[-1] = f"x{r.randrange(3)}"
        rows.append((i, " ".join(["same"] * 200 + own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, rows=1, similarity=0.97)
    want = {}
    for i, _ in rows:
        want.setdefault(i % 500, i)
    found = {x.doc_id: x.class_id for x in got.collect()}
    # a band of one row misses those of another first point; what shares it is settled
    assert all(want[i % 500] <= c and c % 500 == i % 500 for i, c in found.items())
    assert len(set(found.values())) < 1000


def test_one_document_of_each_class_stays(docs, rows):
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    want = dict(classes([r for r in rows if r[0] is not None]))
    ids = sorted(r.doc_id for r in kept.filter("doc_id is not null").collect())
    assert ids == sorted({c for c in want.values()})


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 540)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_empty(none):
    assert near_duplicates(none).collect() == []
    assert keep_first(none).collect() == []
