"""Near-duplicate classes of documents by BagMinHash signatures.

A document is the multiset of its runs of five words. Signatures: the weight axis of a run is cut at
0, 1, 2, 4, 8, ...; each interval holds a Poisson process in time whose rate is the interval's width,
seeded by run and interval only, and a point of it is placed evenly within its interval, at a whole
weight. A document sees the points below its own weight; every point belongs to one of the
signature's components, which keeps the time of its first. Two documents agree in a component with the
probability of their weighted Jaccard similarity. Points are made in order of time until each component
of a document is filled, so most runs of a long document give one point or none.

Signatures are banded; documents that share a band are candidates. In the first FIRST bands each bucket's
members meet a few pivots (those that share the most), which links copies by the thousand at a few comparisons
each. Of all bands, the buckets that then hold more than one linked class are settled exactly, by one rule at every
size: a bucket is dealt by blocks of so many runs, and the members outside the bucket's largest class, in parts, meet
every block, by sketches of the whole signatures first; those that agree with another class, in a bucket that is the
first they share, meet again by exact multiset overlap. Classes are the connected components of these
links; class_id is the smallest doc_id of a class.

Defined cases: a text of one to four words is one run; texts without words (null, empty, blank) are a
class of their own each; rows that repeat belong to one class; a null doc_id is kept and never names a
class unless all of it are null; a text longer than a block is signed alone and whole; other columns, whatever their
names, take no part in `near_duplicates` and stay in `keep_first`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, U64, _BASE, blocks, column, few_files, mapped, materialise, mix, plain, position_in_group, powers, shingles, word_hashes

#: With 26 bands of 5, two documents of similarity 0.8 share no band with a chance of 3.3e-5.
BANDS, ROWS = 26, 5
#: Bands that are looked at first.
FIRST = 8
#: Pivots of a bucket; most runs of the texts of a block, and most texts.
PIVOTS, BLOCK_RUNS, BLOCK_TEXTS = 2, 1 << 19, 512
#: Parts of a node's edges, and of a class, where they meet its label.
SALTS = 8
#: Places of a coarse filter by hash, the most rows that are broadcast.
SLOTS = 1 << 19
#: Sketches of less agreement aren't compared; for a similarity of 0.8 a chance of 1e-8.
AGREE = 0.6


def bag(elements: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct elements of each owner, whose they are, and their multiplicities."""
    if not len(elements):
        return elements, owner, owner
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    new = np.flatnonzero(np.append(True, (np.diff(e) != 0) | (np.diff(o) != 0)))
    return e[new], o[new], np.diff(np.append(new, len(e)))


def bag_minhash(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures of n multisets (distinct elements with whole weights): the first point in time of each component."""
    out = np.full(n * size, np.inf)
    total = np.bincount(owner, weights=weights, minlength=n)
    # one process for each interval of weights that reaches below the element's weight
    levels = np.ceil(np.log2(weights)).astype(np.int64) + 1 if len(weights) else np.empty(0, np.int64)
    item = np.repeat(np.arange(len(elements)), levels)
    level = position_in_group(levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1).astype(np.float64)
    limit = weights[item]
    doc = owner[item]
    seed = mix(elements[item] + level.astype(U64) * U64(_BASE))
    with np.errstate(divide="ignore"):
        unit = size / total  # mean time between points of a component
    until = unit * (np.log(size) + 2)
    time = np.zeros(len(item))
    step = U64(0xD1B54A32D192ED03)
    drawn = np.zeros(len(item), np.int64)

    def draw(some: np.ndarray) -> np.ndarray:
        drawn[some] += 1
        bits = mix(seed[some] + drawn[some].astype(U64) * step)
        time[some] -= np.log(((bits >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / width[some]
        return bits

    draw(np.arange(len(item)))
    waiting = np.arange(len(item))
    open_docs = total > 0
    while len(waiting):
        live = waiting[time[waiting] <= until[doc[waiting]]]
        while len(live):
            bits = mix(mix(seed[live] + drawn[live].astype(U64) * step) ^ U64(0xA0761D6478BD642F))
            part = ((bits >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            inside = low[live] + ((bits & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[live]).astype(np.int64) < limit[live]
            np.minimum.at(out, doc[live[inside]] * size + part[inside], time[live[inside]])
            draw(live)
            live = live[time[live] <= until[doc[live]]]
        open_docs &= np.isinf(out.reshape(n, size)).any(1)
        until[open_docs] += 2 * unit[open_docs]
        waiting = waiting[open_docs[doc[waiting]]]
    return out.reshape(n, size)


def _sign(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        text = column(block, "text")
        words, counts = word_hashes(text)
        begins = np.append(0, np.cumsum(counts))
        terms = words * powers(_BASE, int(counts.max(initial=0)) + 1)[position_in_group(counts)]
        sums = np.append(U64(0), np.cumsum(terms))
        node = mix(sums[begins[1:]] - sums[begins[:-1]] + counts.astype(U64)).view(np.int64)
        runs, n_runs = shingles(text, width)
        elements, owner, weights = bag(runs, np.repeat(np.arange(len(counts)), n_runs))
        times = bag_minhash(elements, owner, weights, len(counts), bands * rows).view(U64)
        keys = np.zeros((len(counts), bands), U64)
        for r in range(rows):
            keys = keys * U64(_BASE) + times[:, r::rows][:, :bands]
        keys = mix((keys + np.arange(1, bands + 1, dtype=U64) * U64(0xD1B54A32D192ED03)).ravel()).view(np.int64)
        size = bands * rows
        sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(counts), [None, pa.py_buffer((mix(times.ravel()) >> U64(56)).astype(np.uint8).tobytes())])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands), pa.int32()), pa.array(keys))
        empty = pa.array(counts == 0)
        yield pa.record_batch(
            [column(block, "doc_id"), column(block, "text_hash"), pa.array(node, mask=counts == 0), pa.array(n_runs, pa.int32()), lists, sketch.cast(pa.binary()), empty],
            names=["doc_id", "text_hash", "node", "runs", "bands", "sketch", "empty"],
        )


def _compare(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            n = some.num_rows
            sides = []
            for name in ("text_a", "text_b"):
                runs, counts = shingles(some.column(some.schema.get_field_index(name)), width)
                sides.append(bag(runs, np.repeat(np.arange(n), counts)))
            e, o, w = (np.concatenate([s[i] for s in sides]) for i in range(3))
            order = np.lexsort((e, o))
            e, o, w = e[order], o[order], w[order]
            twice = np.flatnonzero((e[1:] == e[:-1]) & (o[1:] == o[:-1]))
            shared = np.bincount(o[twice], weights=np.minimum(w[twice], w[twice + 1]), minlength=n)
            total = np.bincount(o, weights=w, minlength=n)
            jaccard = np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)
            keep = np.flatnonzero(jaccard >= similarity)
            yield pa.record_batch([some.column(0).take(pa.array(keep)), some.column(1).take(pa.array(keep)), pa.array(jaccard[keep])], names=["a", "b", "similarity"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= least))


def _bags(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The runs of each text, a repeated run as so many different elements."""
    for batch in batches:
        runs, counts = shingles(batch.column(1), width)
        e, o, w = bag(runs, np.repeat(np.arange(len(counts)), counts))
        expanded = mix(np.repeat(e, w) + position_in_group(w).astype(U64) * U64(_BASE))
        ends = np.cumsum(np.bincount(np.repeat(o, w), minlength=len(counts)))
        data = [expanded[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]
        yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["node", "bag"])


def _agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket and block that agree by sketches with a row of another class, and share no earlier band with it.

    Rows come sorted by bucket and block, the block's members first.
    """
    schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("asks", pa.bool_()), ("node", pa.int64()), ("label", pa.int64())])
    key, held, out = None, [], []
    sketches = bands = labels = wanted = None

    def members() -> None:
        if wanted is not None:
            out.extend((*key, False, held[i]["node"], held[i]["label"]) for i in np.flatnonzero(wanted).tolist())

    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["block"], row["part"]) != key:
                members()
                key, held, wanted = (row["key"], row["block"], row["part"]), [], None
            if not row["asks"]:
                held.append(row)
                continue
            if not held:
                continue
            if wanted is None:
                sketches = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint8).reshape(len(held), -1)
                bands = np.array([r["bands"] for r in held])
                labels = np.array([r["label"] for r in held])
                wanted = np.zeros(len(held), bool)
            some = np.flatnonzero(labels != row["label"])
            some = some[(sketches[some] == np.frombuffer(row["sketch"], np.uint8)).mean(1) >= least]
            if len(some):
                some = some[np.array(row["bands"])[(bands[some] == np.array(row["bands"])).argmax(1)] == row["key"]]
            if len(some):
                wanted[some] = True
                out.append((*key, True, row["node"], row["label"]))
        if out:
            yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
    members()
    if out:
        yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _cross(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of the asking rows to the other classes of each block, but for those that join what links of the block have joined.

    Rows come sorted by bucket and block, the block's members first.
    """
    least = AGREE * similarity / 0.8
    key, held, out = None, [], []
    nodes = roots = sketches = np.empty(0)
    joined: dict[int, int] = {}

    def root(label: int) -> int:
        while label in joined:
            label = joined[label]
        return label

    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["block"], row["part"]) != key:
                key, held, joined = (row["key"], row["block"], row["part"]), [], {}
            if not row["asks"]:
                held.append(row)
                nodes = np.empty(0)
                continue
            if not held:
                continue
            if not len(nodes):
                nodes, roots = (np.array([r[k] for r in held]) for k in ("node", "label"))
                sketches = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint8).reshape(len(held), -1)
            mine = root(row["label"])
            some = np.flatnonzero(roots != mine)
            some = some[(sketches[some] == np.frombuffer(row["sketch"], np.uint8)).mean(1) >= least]
            if not len(some):
                continue
            own = np.sort(np.frombuffer(row["bag"], U64))
            bags = [np.frombuffer(held[i]["bag"], U64) for i in some]
            sizes = np.array(list(map(len, bags)))
            elements = np.concatenate(bags)
            same = own[np.minimum(np.searchsorted(own, elements), len(own) - 1)] == elements
            shared = np.bincount(np.repeat(np.arange(len(some)), sizes), weights=same, minlength=len(some))
            jaccard = shared / (len(own) + sizes - shared)
            for h in np.flatnonzero(jaccard >= similarity).tolist():
                other = int(roots[some[h]])
                if other != mine:
                    node = int(nodes[some[h]])
                    out.append((min(row["node"], node), max(row["node"], node), jaccard[h]))
                    joined[other] = mine
                    roots[roots == other] = mine
        if out:
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])
            out = []


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """node, label for every node of links (a, b): the smallest node of its connected component."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), files)
    # a node with thousands of edges, or a class of thousands, is dealt in parts
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    edges = edges.select("a", "b", salt("a"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label", salts).hint("merge"), ["b", "salt"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"), salt("node"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"), salts)
        new = materialise(new.join(jump.hint("merge"), ["label", "salt"], "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label")), files)
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels


def _pivots(of: DataFrame) -> DataFrame:
    best = of.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(F.max(F.struct("pull", "node")).alias("best"))
    return best.select("key", F.col("best.node").alias("pivot"))


def _with_pull(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("node").agg(F.sum("n").alias("pull")), "node")


def _mixed(nodes: DataFrame, labels: DataFrame, files: int) -> DataFrame:
    """The rows of buckets that hold more than one class, with their label, the bucket's largest class, its blocks, and the parts of what is outside that class."""
    named = nodes.select("node", "runs", "bands").join(labels, "node", "left").select("node", "runs", F.coalesce("label", "node").alias("label"), F.explode("bands").alias("key"))
    bucket = Window.partitionBy("key")
    named = named.select("*", F.min("label").over(bucket).alias("lo"), F.max("label").over(bucket).alias("hi")).filter("lo <> hi")
    named = materialise(named.select("key", "node", "label", "runs"), files)
    parts = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("runs").alias("runs"))
    split = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / BLOCK_TEXTS).cast("int").alias("n_parts"), F.greatest(F.ceil(F.sum("runs") / BLOCK_RUNS), F.ceil(F.sum("n") / BLOCK_TEXTS)).cast("int").alias("n_blocks"))
    return named.join(split, "key").select("key", "node", "label", "main", "n_blocks", "n_parts")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id and is_first (the row stands for its class) of each row; class_key, a class's own key; text_hash."""
    own, at, _ = plain(docs)
    base = own.select(F.col(at(doc_id)).cast("long").alias("doc_id"), F.col(at(text)).alias("text"), F.xxhash64(at(text)).alias("text_hash"))
    files = few_files(docs)
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.hold(base.transform(mapped, lambda it: _sign(it, width, bands, rows), "doc_id long, text_hash long, node long, runs int, bands array<long>, sketch binary, empty boolean"))
        nodes = signed.filter("not empty").groupBy("node").agg(F.min(F.struct("text_hash", "runs", "bands", "sketch")).alias("own")).select("node", "own.*")
        nodes = scratch.hold(nodes)
        first = nodes.select("node", F.explode(F.slice("bands", 1, FIRST)).alias("key"))
        shared = first.select("key", "node", F.count("*").over(Window.partitionBy("key")).alias("n")).filter("n > 1")
        shared = _with_pull(materialise(shared, files))
        pairs = shared.join(_pivots(shared), "key").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        tested = _likely(nodes, pairs.distinct(), similarity, files)
        links = materialise(_overlapping(scratch.hold(_texts(base, nodes, tested)), tested, width, similarity), files)
        labels = components(links, files)
        mixed = _mixed(nodes, labels, files)
        if not mixed.isEmpty():
            more = materialise(_settle(scratch, base, nodes, mixed, width, similarity), files)
            if not more.isEmpty():
                labels = components(links.union(more), files)
        return scratch.result(_classes(signed, labels), files)


def _classes(signed: DataFrame, labels: DataFrame) -> DataFrame:
    classes = signed.join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("class_key"))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = classes.filter("class_key is not null").groupBy("class_key").agg(F.min(own).alias("first"), F.count("*").alias("n"))
    # only classes of several rows are joined back, in eight salted copies
    salts = F.explode(F.array(*[F.lit(i) for i in range(8)]))
    several = first.filter("n > 1").select("class_key", "first", salts.alias("salt"))
    salted = classes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(8)).cast("int"))
    out = salted.join(several.hint("merge"), ["class_key", "salt"], "left")
    best = F.coalesce("first", own)
    return out.select("doc_id", best["doc_id"].alias("class_id"), (best["doc_id"].eqNullSafe(F.col("doc_id")) & best["text_hash"].eqNullSafe(F.col("text_hash"))).alias("is_first"), "class_key", "text_hash")


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(values.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _likely(nodes: DataFrame, pairs: DataFrame, similarity: float, files: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree as those of similar texts do."""
    least = AGREE * similarity / 0.8
    return materialise(_with_both(pairs, nodes, "sketch").transform(mapped, lambda it: _similar(it, least), "a long, b long"), files)


def _texts(base: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the nodes in pairs. Equal texts fold to one before they are dealt out.

    Texts whose hash falls in none of SLOTS places that wanted ones fall in stay where they are; that table has SLOTS rows at most.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "text_hash").join(wanted, "node", "left_semi")
    slot = F.pmod(F.col("text_hash"), F.lit(SLOTS))
    slots = wanted.select(slot.alias("slot")).distinct()
    once = base.filter("text is not null").join(F.broadcast(slots), slot == F.col("slot"), "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    return once.join(wanted, "text_hash").select("node", "text")


def _overlapping(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose texts overlap by similarity or more."""
    return _with_both(pairs, texts, "text").transform(mapped, lambda it: _compare(it, width, similarity), "a long, b long, similarity double")


def _settle(scratch: Scratch, base: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between the classes of the buckets in rows, of any size."""
    dealt = rows.join(nodes.select("node", "sketch", "bands"), "node")
    whole = ["key", "node", "label", "sketch", "bands"]
    members = dealt.select(*whole, F.pmod(F.xxhash64("node"), "n_blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    asking = dealt.filter("label <> main").select(*whole, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), "n_parts").cast("int").alias("part"), F.lit(True).alias("asks"))
    order = ["key", "block", "part", "asks"]
    least = AGREE * similarity / 0.8
    agree = members.union(asking).repartition(*order[:3]).sortWithinPartitions(*order).transform(mapped, lambda it: _agreeing(it, least), "key long, block int, part int, asks boolean, node long, label long")
    agree = scratch.hold(agree)
    bags = _texts(base, nodes, agree.select(F.col("node").alias("a"), F.col("node").alias("b"))).transform(mapped, lambda it: _bags(it, width), "node long, bag binary")
    sent = agree.join(nodes.select("node", "sketch"), "node").join(bags, "node").repartition(*order[:3]).sortWithinPartitions(*order)
    return sent.transform(mapped, lambda it: _cross(it, similarity), "a long, b long, similarity double").distinct()


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id. Rows without words all stay."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    gone = found.filter("not is_first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own, at, back = plain(docs)
    columns, own = own.columns, own.withColumn("__text", F.xxhash64(at(text)))
    left = own.join(gone, F.col(at(doc_id)).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_anti")
    blank = F.coalesce(F.length(F.regexp_replace(at(text), r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0
    left = left.withColumn("__row", F.when(blank, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return back(left.dropDuplicates([at(doc_id), "__text", "__row"]).select(*columns))
