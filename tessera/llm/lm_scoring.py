"""Stupid-backoff scores of documents from the n-gram counts of a corpus, orders 1 to ORDER.

A word scores log(c(n-gram that ends in it) / c(the n-gram's first words)) if the corpus has the n-gram,
else log(alpha) more than by the n-gram shorter by a word; a single word scores log(c(word) / N), or
-log(N + 1) if the corpus lacks it. A document's score is the sum over its words. Where the corpus is the
scored table itself, a document's own n-grams are left out of all its counts, so backoff takes effect.

N-gram counts are tables partitioned by the n-gram's hash. A block of documents is exploded to its distinct
n-grams; each travels once to the bucket of its hash, with its count in the block. The bucket sums the counts,
joins them to the n-grams that blocks ask for, and the counts go back to the block, where the words are
scored and summed by document. A word that a third of the corpus consists of travels once a block.

A hash has 20 bits more than the number of the corpus' n-grams (48 at least, 64 at most), so at every size one n-gram
in a million is taken for another one; a block's hashes travel sorted, as their differences.

Defined cases: a null text has no words and scores 0; an empty corpus (or one that is the document alone) gives each
word -log(1) = 0, and log(alpha) for each order that it backs off; null ids and repeated rows are kept, and each of
several equal rows has the others in its corpus; a text longer than a block is a block of its own, scored whole;
other columns, whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    ANSWERED, ASKED, U64, answered, answers, ask, bucket_count, by_bucket, column, from_planes, mapped, numbered, pack, part, plain, planes, position_in_group, questions, steady, unpack, window_hashes, word_hashes,
)

ALPHA, ORDER = 0.4, 3
#: Text of a block.
BLOCK_BYTES = 4 << 20
_ORDERS = U64(0xD1B54A32D192ED03)


def _grams(words: np.ndarray, counts: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The sorted distinct n-grams of a block, for each order the place of the n-gram that ends at each word (-1: none), and how often each n-gram stands in the block."""
    place = position_in_group(counts)
    ends = [np.flatnonzero(place >= k) for k in range(order)]
    hashes = [(window_hashes(words, k + 1) + U64(k) * _ORDERS)[at - k] >> U64(64 - bits) for k, at in enumerate(ends)]
    distinct, code, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    begin, codes = 0, []
    for at in ends:
        own = np.full(len(words), -1, np.int64)
        own[at] = code[begin : begin + len(at)]
        begin += len(at)
        codes.append(own)
    return distinct, codes, n


def _items(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted n-grams and their counts."""
    return pack(grams[:1].tobytes(), planes(np.diff(grams)), planes(counts))


def _from_items(items: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, gaps, counts = unpack(items)
    return np.cumsum(np.append(np.frombuffer(first, U64), from_planes(gaps).view(U64)), dtype=U64), from_planes(counts)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' ids and words."""
    for block, table in numbered(batches, BLOCK_BYTES):
        words, counts = word_hashes(column(table, "text"))
        ids = column(table, "doc_id")
        distinct, inverse, uses = np.unique(words, return_inverse=True, return_counts=True)
        often = np.argsort(-uses, kind="stable")  # frequent words have small numbers
        rank = np.empty(len(distinct), np.int64)
        rank[often] = np.arange(len(distinct))
        head = pack(ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), planes(counts), distinct[often].tobytes(), planes(rank[inverse]))
        yield answers([(block, None, None, head)])


def _send(batches: Iterator[pa.RecordBatch], order: int, bits: int, n_buckets: int, counts_in: bool) -> Iterator[pa.RecordBatch]:
    for block, table in numbered(batches, BLOCK_BYTES):
        words, counts = word_hashes(column(table, "text"))
        grams, _, n = _grams(words, counts, order, bits)
        bucket = (grams >> U64(bits - 32)) * U64(n_buckets) >> U64(32)  # by ranges, so that they stay sorted
        n = n * counts_in
        del words
        yield questions(n_buckets, block, bucket, lambda a, b: _items(grams[a:b], n[a:b]), None)  # noqa: B023


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a bucket's n-grams outside the block, for each block that asks."""
    asked, grams, counts = [], [], []
    for batch in batches:
        for _, block, begin, items, _ in zip(*(c.to_pylist() for c in batch.columns)):
            own, n = _from_items(items)
            grams.append(own)
            counts.append(n)
            asked.append((block, begin, len(own)))
    if asked:
        every, counts = np.concatenate(grams), np.concatenate(counts)
        del grams
        _, inverse = np.unique(every, return_inverse=True)
        del every
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        out, at = [], 0
        for block, begin, n in asked:
            if block >= 0:
                out.append((block, begin, planes(total[inverse[at : at + n]] - counts[at : at + n]), None))
            at += n
            if len(out) == 64:
                yield answers(out)
                out = []
        if out:
            yield answers(out)


def _finish(batches: Iterator[pa.RecordBatch], order: int, bits: int, total: int, alpha: float, leave_out: bool) -> Iterator[pa.RecordBatch]:
    for head, found in answered(batches):
        ids, nulls, counts, distinct, codes = unpack(head)
        counts = from_planes(counts)
        words = np.frombuffer(distinct, U64)[from_planes(codes)]
        _, places, here = _grams(words, counts, order, bits)
        if leave_out:
            found = found + here
        owner = np.repeat(np.arange(len(counts)), counts)
        n = np.full(len(words), total) - (counts[owner] if leave_out else 0)
        score = below = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, place in enumerate(places):
                at = np.flatnonzero(place >= 0)
                c = np.zeros(len(words), np.int64)
                c[at] = found[place[at]]
                if leave_out and len(at):
                    _, inverse, own = np.unique(owner[at] << 32 | place[at], return_inverse=True, return_counts=True)
                    c[at] -= own[inverse]
                if k == 0:
                    score = np.where(c > 0, np.log(c) - np.log(n), -np.log(n + 1))
                else:
                    context = np.append(0, below[:-1])
                    score = np.where(place < 0, score, np.where(c > 0, np.log(c) - np.log(context), np.log(alpha) + score))
                below = c
        sums = np.bincount(owner, weights=score, minlength=len(counts))
        yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool)), pa.array(counts), pa.array(sums)], names=["doc_id", "n_words", "score"])


def _base(of: DataFrame, doc_id: str | None, text: str) -> DataFrame:
    own, at, _ = plain(of)
    ids = F.col(at(doc_id)).cast("long") if doc_id else F.lit(0).cast("long")
    return own.select(ids.alias("doc_id"), F.col(at(text)).alias("text"), part())


def _size(of: DataFrame) -> int:
    """Words of all texts."""
    return of.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")).first()[0] or 0


def _bits(total: int, order: int) -> int:
    return min(64, max(48, 20 + (total * order).bit_length()))


def ngram_counts(corpus: DataFrame, order: int = ORDER, text: str = "text", buckets: int | None = None) -> DataFrame:
    """The count tables as a frame: bucket, gram (its hash) and n, partitioned by bucket."""
    n, bits = buckets or bucket_count(corpus), _bits(_size(_base(corpus, None, text)), order)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b, *_from_items(x)) for batch in batches for b, x in zip(batch.column("bucket").to_pylist(), batch.column("items").to_pylist())]
        if held:
            distinct, inverse = np.unique(np.concatenate([g for _, g, _ in held]), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([c for *_, c in held])).astype(np.int64)
            yield pa.record_batch([pa.array(np.full(len(distinct), held[0][0], np.int32)), pa.array(distinct.view(np.int64)), pa.array(total)], names=["bucket", "gram", "n"])

    asked = _base(corpus, None, text).transform(mapped, lambda it: _send(it, order, bits, n, True), ASKED)
    return by_bucket(asked, n).transform(mapped, tables, "bucket int, gram long, n long")


def backoff_scores(docs: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_words and score of each row of docs by the counts of corpus (all other rows of docs, if none is given)."""
    base = _base(steady(docs), doc_id, text)
    source = base if corpus is None else _base(corpus, None, text)
    n, alone = buckets or bucket_count(base if corpus is None else base.union(source)), corpus is None
    total = _size(source)
    bits = _bits(total, order)
    asked = base.transform(mapped, lambda it: _send(it, order, bits, n, alone), ASKED)
    if not alone:
        others = source.transform(mapped, lambda it: _send(it, order, bits, n, True), ASKED)
        asked = asked.union(others.withColumn("block", F.lit(-1).cast("long")))
    return ask(asked, n, _answer, lambda it: _finish(it, order, bits, total, alpha, alone), "doc_id long, n_words long, score double", base.transform(mapped, _heads, ANSWERED))
