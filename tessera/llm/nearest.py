"""Approximate nearest neighbours by cross-polytope hashing.

A cross-polytope function turns the unit vectors by three rounds of random signs and a fast Hadamard transform and
names the nearest signed axis. Each of TABLES tables has `functions` of them in a row, more as the vectors grow: a
vector is filed under its axis of each. A query's closeness to a cell is the sum of its own closeness to the cell's
axes, and it looks into every cell, of all tables, whose closeness reaches one threshold: the best-ranked probes
of all tables together. There the candidates are scored exactly, by inner products of the original vectors
in double precision, and each query's best leave the cell's part.

The threshold is fitted: FIT_QUERIES queries (those of least hash) are compared to all vectors, and of their true
neighbours the share RECALL must lie in cells of at least that closeness. `fitted` returns it with the recall on these.

A part holds the cells of a table with the same first axis; a query goes to the parts of which a cell may reach
the threshold. Parts larger than PART_ROWS are split, and the queries that look there go to every split; the sizes of
all parts are one number for each table and axis. Queries that end with fewer neighbours than there are (in
tiny tables) are compared to all.

Of equal vectors the k + 1 of least id are filed: no query can return others.

Defined cases: rows whose id or vector is null, or whose vector is zero or holds null or non-finite values, take no part;
a vector of another length than most has no inner product with them and takes no part; equal scores go to the smaller id; rows that repeat an id are
one candidate; other columns, whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, few_files, mapped, materialise, plain

TABLES = 10
#: Vectors above which a table has two functions, and three.
TWO, THREE = 1_000, 4_000_000
FIT_QUERIES, RECALL = 200, 0.96
#: Most vectors of a part.
PART_ROWS = 16_384
_SENT = "part long, is_query boolean, ids binary, vectors binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def axes(vectors: np.ndarray, table: int, function: int = 0, seed: int = 0) -> np.ndarray:
    """Each vector's closeness to the signed axes of a function: first the positive ones, then the negative."""
    width = 1 << max(1, int(np.ceil(np.log2(max(vectors.shape[1], 2)))))
    signs = np.random.default_rng([seed, table, function]).choice([-1.0, 1.0], (3, width))
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], 1)


def functions_for(n: int) -> int:
    """Functions of a table for n vectors."""
    return 1 + (n > TWO) + (n > THREE)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(1)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column(0).to_numpy(), flat.reshape(batch.num_rows, -1)


def _deal(batches: Iterator[pa.RecordBatch], functions: int, parts: dict[int, int], is_query: bool, least: float, kind: type) -> Iterator[pa.RecordBatch]:
    """Vectors by part; a query goes to all splits of the parts that it looks into."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = _vectors(batch)
        rows: list[tuple] = []
        for t in range(TABLES):
            near = axes(x, t)
            if is_query:
                rest = sum((axes(x, t, f).max(1) for f in range(1, functions)), np.zeros(len(x)))
                row, axis = np.nonzero(near + rest[:, None] >= least)
            else:
                row, axis = np.arange(len(x)), near.argmax(1)
            part = axis + t * near.shape[1]
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                p = int(part[own[0]])
                n = parts.get(p, 1)
                if is_query:
                    data = (ids[row[own]].tobytes(), x[row[own]].astype(kind).tobytes())
                    rows += [(p << 20 | k, True, *data) for k in range(n)]
                else:
                    split = ids[row[own]] % n
                    for k in np.unique(split).tolist():
                        at = row[own[split == k]]
                        rows.append((p << 20 | k, False, ids[at].tobytes(), x[at].astype(kind).tobytes()))
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "is_query", "ids", "vectors"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            _, x = _vectors(batch)
            for t in range(TABLES):
                near = axes(x, t)
                total = np.zeros(TABLES * near.shape[1], np.int64) if total is None else total
                total += np.bincount(near.argmax(1) + t * near.shape[1], minlength=len(total))
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["part", "n"])


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best distinct candidates, best first, and their ranks from 1."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.append(True, (np.diff(query) != 0) | (np.diff(vec) != 0))[: len(query)]
    query, vec, score = query[new], vec[new], score[new]
    starts = np.flatnonzero(np.append(True, np.diff(query) != 0)[: len(query)])
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query)))) + 1
    keep = rank <= k
    return query[keep], vec[keep], score[keep], rank[keep]


def _scored(query_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of the k best of these candidates for each of these queries, and what ties with the last."""
    scores = asked @ x.T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(query_ids), -np.inf)
    row, at = np.nonzero((scores >= least[:, None] - 1e-9) & (scores > -np.inf))
    return query_ids[row], ids[at], np.sum(asked[row] * x[at], axis=1)


def _search(batches: Iterator[pa.RecordBatch], functions: int, least: float, k: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The best candidates of each part for each query, and how many inner products that took. Rows come sorted by part, the vectors first."""
    part, held, asked = None, [], []
    ids = x = cell = cuts = None

    def rows(of: list) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([np.frombuffer(i, np.int64) for i, _ in of])
        return own, np.concatenate([np.frombuffer(v, kind) for _, v in of]).astype(np.float64).reshape(len(own), -1)

    def index() -> None:
        nonlocal ids, x, cell, cuts
        ids, x = rows(held)
        width = 2 << max(1, int(np.ceil(np.log2(max(x.shape[1], 2)))))
        cell = np.zeros(len(ids), np.int64)
        for f in range(1, functions):
            cell = cell * width + axes(x, (part >> 20) // width, f).argmax(1)
        order = np.argsort(cell, kind="stable")
        ids, x, cell = ids[order], x[order], cell[order]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(cell) != 0)), len(cell)).tolist()

    def found() -> Iterator[pa.RecordBatch]:
        if not held or not asked:
            return
        if ids is None:
            index()
        own, vectors = rows(asked)
        asked.clear()
        width = 2 << max(1, int(np.ceil(np.log2(max(x.shape[1], 2)))))
        t, first = divmod(part >> 20, width)
        near = [axes(vectors, t, f) for f in range(functions)]
        out, n = [], 0
        for b, e in zip(cuts[:-1], cuts[1:]):
            close, code = near[0][:, first].copy(), int(cell[b])
            for f in range(functions - 1, 0, -1):
                code, axis = divmod(code, width)
                close += near[f][:, axis]
            some = np.flatnonzero(close >= least)
            if len(some):
                n += len(some) * (e - b)
                out.append(_scored(own[some], vectors[some], ids[b:e], x[b:e], k))
        if out:
            query, vec, score, _ = _best(*(np.concatenate(c) for c in zip(*out)), k)
            work = np.zeros(len(query), np.int64)
            work[:1] = n
            yield pa.record_batch([pa.array(query), pa.array(vec), pa.array(score), pa.array(work)], names=["query_id", "vec_id", "score", "products"])

    n = 0
    for batch in batches:
        for p, q, i, v in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part or n >= 1024:
                yield from found()
                n = 0
            if p != part:
                part, held, asked, ids = p, [], [], None
            (asked if q else held).append((i, v))
            n += q * (len(i) // 8)
    yield from found()


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    got = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if got:
        query, vec, score, rank = _best(*(np.concatenate(c) for c in zip(*got)), k)
        yield pa.record_batch([pa.array(query), pa.array(rank.astype(np.int32)), pa.array(vec), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])


def _against_all(filed: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of every batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                query, vec, score, _ = _best(*_scored(ids, x, *_vectors(batch), k), k)
                yield pa.record_batch([pa.array(query), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return filed.transform(mapped, run, "query_id long, vec_id long, score double")


def _rows(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow().combine_chunks().to_batches()
    return _vectors(got[0]) if got else (np.empty(0, np.int64), np.empty((0, 1)))


def fitted(filed: DataFrame, queries: DataFrame, functions: int, k: int = 20, recall: float = RECALL) -> tuple[float, float]:
    """The closeness that cells must reach, and the recall that it gives for the queries of the sample."""
    some = queries.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES)
    ids, x = _rows(some)
    best = _against_all(filed, ids, x, k).repartition("query_id").transform(mapped, lambda it: _merge(it, k), "query_id long, rank int, vec_id long, score double")
    true = best.join(filed.withColumnRenamed("id", "vec_id"), "vec_id").select("query_id", "x")  # FIT_QUERIES * k rows
    own, y = _rows(true)
    if not len(own):
        return -np.inf, 1.0
    order = np.argsort(ids)
    q = x[order][np.searchsorted(ids[order], own)]
    row, top = np.arange(len(own)), np.full(len(own), -np.inf)
    for t in range(TABLES):
        close = sum(axes(q, t, f)[row, axes(y, t, f).argmax(1)] for f in range(functions))
        top = np.maximum(top, close)
    least = float(np.sort(top)[int((1 - recall) * len(top))]) - 1e-12
    return least, float((top >= least).mean())


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", functions: int | None = None, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by inner product for the rows where is_query holds.

    report, if given, takes the number of functions, the threshold, the recall on the sample, and products, the share of all (query, vector) pairs that were scored.
    """
    named, at, _ = plain(vectors.withColumn("__asks", is_query))
    x, exact = F.col("x"), dict(vectors.dtypes).get(embedding) != "array<float>"
    own = named.select(F.col(at(vec_id)).cast("long").alias("id"), F.col(at(embedding)).cast("array<double>" if exact else "array<float>").alias("x"), F.col(at("__asks")).alias("asks"))
    kind = np.float64 if exact else np.float32
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    own = own.filter(F.col("id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))
    usual = own.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    own = own.filter(F.size("x") == (usual["n"] if usual else 0))
    schema = "query_id long, rank int, vec_id long, score double"
    with Scratch(vectors.sparkSession) as scratch:
        copies = Window.partitionBy("x").orderBy("id")
        once = own.select("id", "x").distinct()  # repeated rows count once among the k + 1
        filed = materialise(once.select("id", "x", F.row_number().over(copies).alias("copy")).filter(F.col("copy") <= k + 1).select("id", "x"))
        queries = materialise(own.filter("asks").select("id", "x"))
        total = filed.select("id").distinct().count()
        functions = functions or functions_for(total)
        least, recall = fitted(filed, queries, functions, k)
        sizes = filed.transform(mapped, _sizes, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
        parts = {r["part"]: -(-r["n"] // PART_ROWS) for r in sizes.filter(F.col("n") > PART_ROWS).collect()}  # a row for each table and axis at most
        dealt = [f.transform(mapped, lambda it, q=q: _deal(it, functions, parts, q, least, kind), _SENT) for q, f in ((False, filed), (True, queries))]
        sent = dealt[0].union(dealt[1]).repartition("part").sortWithinPartitions("part", "is_query")
        found = scratch.hold(sent.transform(mapped, lambda it: _search(it, functions, least, k, kind), "query_id long, vec_id long, score double, products long"))
        best = found.select("query_id", "vec_id", "score").repartition("query_id").transform(mapped, lambda it: _merge(it, k), schema)
        best = scratch.result(best)
        if report is not None:
            n = queries.select("id").distinct().count()
            report |= {"functions": functions, "least": least, "recall": recall, "products": (found.agg(F.sum("products")).first()[0] or 0) / max(1, n * total)}
        full = best.groupBy("query_id").agg(F.max("rank").alias("n")).filter(F.col("n") >= min(k, total - 1)).select(F.col("query_id").alias("id"))
        few = materialise(queries.join(full, "id", "left_anti"), few_files(vectors))
        if total < 2 or few.isEmpty():
            return best
        again = few.transform(mapped, lambda it: _everywhere(it, kind), "part long, is_query boolean, ids binary, vectors binary")
        every = filed.transform(mapped, lambda it: _at_home(it, kind), "part long, is_query boolean, ids binary, vectors binary")
        wide = every.union(again).repartition("part").sortWithinPartitions("part", "is_query").transform(mapped, lambda it: _search(it, 1, -np.inf, k, kind), "query_id long, vec_id long, score double, products long")
        wide = wide.select("query_id", "vec_id", "score").repartition("query_id").transform(mapped, lambda it: _merge(it, k), schema)
        return scratch.result(best.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(wide))


#: Parts to which queries without enough neighbours, and all vectors, are dealt.
_HOMES = 64


def _everywhere(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, x = _vectors(batch)
            yield pa.record_batch([pa.array(np.arange(_HOMES)), pa.array([True] * _HOMES), pa.array([ids.tobytes()] * _HOMES), pa.array([x.astype(kind).tobytes()] * _HOMES)], names=["part", "is_query", "ids", "vectors"])


def _at_home(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, x = _vectors(batch)
            home = ids % _HOMES
            for p in np.unique(home).tolist():
                at = np.flatnonzero(home == p)
                yield pa.record_batch([pa.array([p]), pa.array([False]), pa.array([ids[at].tobytes()]), pa.array([x[at].astype(kind).tobytes()])], names=["part", "is_query", "ids", "vectors"])
