"""Removal of passages that repeat across documents, by seed and extend.

Seeds: a document is winnowed, that is, of every SEEDS consecutive runs of SEED_WORDS words the one of
least hash is its anchor, so that each window of `window` words has one anchor and equal windows have
equal anchors wherever they stand. Consecutive windows with the same anchor travel as one run: the
anchor, and a fingerprint for each position to which a match may extend left or right of it. Documents
meet at their anchors; there each window is matched with the same window of the smallest doc_id, and
windows matched side by side merge to maximal repeats.

A block of documents settles its own repeats before the exchange and sends each window once, so a
passage that a third of all documents share reaches its bucket once a block.

Windows are the same if a 64-bit hash of the whole window and one of its anchor agree (in the exchange: the
anchor's 64 bits and 32 of the window's).

Defined cases: a null text has no words; a row with a null doc_id neither loses words nor takes them
from others; rows that repeat a doc_id are one document's copies and take nothing from each other;
a text longer than a block is a block of its own, matched whole; an empty table gives an empty result; other
columns are kept as they are (one that has an output's name as that name and `_in`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, blocks, bucket_count, by_bucket, column, mapped, mix, plain, position_in_group, ranges, schema_of, window_hashes, word_hashes

#: Words of an anchor. With windows of 13 words, 8 anchors' places in each.
SEED_WORDS = 6
#: Most windows of a run (its length travels in 16 bits); a text that repeats one word has longer ones.
LONGEST_RUN = 1 << 15
_SENT = "bucket int, doc_id long, text_hash long, begin int, end int, doc_ids binary, text_hashes binary, n_runs binary, starts binary, lengths binary, anchors binary, prints binary"
_FOUND = "doc_id long, text_hash long, begin int, end int"


def _anchored(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's first word, document, anchor and hash."""
    if len(words) < window:
        none = np.empty(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    owner = np.repeat(np.arange(len(counts)), counts)
    least = window_hashes(words, min(SEED_WORDS, window))
    seeds = window - min(SEED_WORDS, window) + 1
    span = 1
    while span < seeds:
        step = min(span, seeds - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    whole = window_hashes(words, window)
    at = np.flatnonzero((position_in_group(counts) + window <= counts[owner])[: len(whole)])
    return at, owner[at], least[at], whole[at]


def _send_runs(batches: Iterator[pa.RecordBatch], window: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())] + [(n, pa.binary()) for n in ("doc_ids", "text_hashes", "n_runs", "starts", "lengths", "anchors", "prints")])
    for block in blocks(batches):
        block = block.sort_by("doc_id")
        ids = column(block, "doc_id").to_numpy()
        texts = column(block, "text_hash").to_numpy()
        words, counts = word_hashes(column(block, "text"))
        at, owner, anchor, whole = _anchored(words, counts, window)
        if not len(at):
            continue
        begins = np.cumsum(counts) - counts
        order = np.argsort(whole, kind="stable")
        new = np.append(True, (np.diff(whole[order]) != 0) | (np.diff(anchor[order]) != 0))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
        repeated = ids[owner[first]] < ids[owner]
        del order, new, first
        # settled here: an earlier document of the block has it
        lo, n = _side_by_side(at, owner, repeated)
        doc = owner[lo]
        yield _table(schema, bucket=np.full(len(lo), -1, np.int32), doc_id=ids[doc], text_hash=texts[doc], begin=(at[lo] - begins[doc]).astype(np.int32), end=(at[lo] + n - 1 + window - begins[doc]).astype(np.int32))
        # the rest travel in runs of the same anchor
        lo, n = _side_by_side(at, owner, ~repeated, anchor)
        bucket = (anchor[lo] % U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        lo, n, bucket = lo[order], n[order], bucket[order]
        doc, cuts = owner[lo], np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(lo))
        prints = (whole >> U64(32)).astype(np.uint32)
        del whole, words
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            docs, runs = np.unique(doc[a:b], return_counts=True)  # runs of a bucket keep the order of documents
            rows.append((int(bucket[a]), ids[docs].tobytes(), texts[docs].tobytes(), runs.astype(np.int32).tobytes(), (at[lo[a:b]] - begins[doc[a:b]]).astype(np.int32).tobytes(), n[a:b].astype(np.uint16).tobytes(), anchor[lo[a:b]].tobytes(), prints[ranges(lo[a:b], n[a:b])].tobytes()))
        if rows:
            cols = list(zip(*rows))
            yield _table(schema, bucket=np.array(cols[0], np.int32), **{k: pa.array(v, pa.binary()) for k, v in zip(schema.names[5:], cols[1:])})


def _side_by_side(at: np.ndarray, owner: np.ndarray, keep: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the longest runs of kept windows that follow each other in a document (with the same anchor)."""
    kept = np.flatnonzero(keep)
    if not len(kept):
        return kept, kept
    breaks = (np.diff(at[kept]) != 1) | (np.diff(owner[kept]) != 0)
    if same is not None:
        breaks |= (np.diff(same[kept]) != 0) | (at[kept[1:]] % LONGEST_RUN == 0)
    starts = np.append(0, np.flatnonzero(breaks) + 1)
    return kept[starts], np.diff(np.append(starts, len(kept)))


def _table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _match(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket's windows, those that a smaller doc_id has too, as stretches of words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])
    held: dict[str, list] = {k: [] for k in ("doc_ids", "text_hashes", "n_runs", "starts", "lengths", "anchors", "prints")}
    kinds = {"doc_ids": np.int64, "text_hashes": np.int64, "n_runs": np.int32, "starts": np.int32, "lengths": np.uint16, "anchors": U64, "prints": np.uint32}
    for batch in batches:
        for k, kind in kinds.items():
            held[k] += [np.frombuffer(x.as_py(), kind) for x in batch.column(k)]
    if not held["starts"]:
        return
    got = {k: np.concatenate(held.pop(k)) for k in list(held)}
    lengths = got["lengths"].astype(np.int64)
    doc = np.repeat(np.arange(len(got["doc_ids"])), got["n_runs"])  # of each run
    anchors, prints = got.pop("anchors"), got.pop("prints")
    run = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    key = mix(anchors[run] + prints.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, np.diff(key) != 0)
    for other in (anchors[run[order]], prints[order]):
        new[1:] |= np.diff(other) != 0
    del key, prints, other
    new = np.flatnonzero(new)
    ids = got["doc_ids"][doc[run]]
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], new), np.diff(np.append(new, len(order))))
    del order, new
    repeated = least < ids
    del least, ids
    at = ranges(got["starts"].astype(np.int64), lengths)
    lo, n = _side_by_side(at, run, repeated)
    for a in range(0, len(lo), 100_000):
        x, k = lo[a : a + 100_000], n[a : a + 100_000]
        yield pa.record_batch([pa.array(got["doc_ids"][doc[run[x]]]), pa.array(got["text_hashes"][doc[run[x]]]), pa.array(at[x].astype(np.int32)), pa.array((at[x] + k - 1 + window).astype(np.int32))], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], text_column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, begins, ends = (batch.column(batch.schema.get_field_index(c)) for c in (text_column, "__begins", "__ends"))
        n_words, n_removed, kept = [], [], []
        for text, lo, hi in zip(texts, begins, ends):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if lo.is_valid and len(lo):
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, lo.values.to_numpy(), 1)
                np.add.at(edges, hi.values.to_numpy(), -1)
                stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                n_removed.append(len(words) - len(stay))
                words = [words[i] for i in stay.tolist()]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode())
        names = [n for n in batch.schema.names if n not in ("__begins", "__ends")]
        yield pa.record_batch([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])


def repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of each document that windows of a smaller doc_id cover: doc_id, text_hash, begins, ends (words, half open)."""
    n = bucket_count(docs)
    own, at, _ = plain(docs)
    base = own.select(F.col(at(doc_id)).cast("long").alias("doc_id"), F.col(at(text)).alias("text"), F.xxhash64(at(text)).alias("text_hash")).filter("doc_id is not null")
    sent = base.transform(mapped, lambda it: _send_runs(it, window, n), _SENT)
    # What a block has settled rides in the same exchange, dealt over all buckets, so that texts are read and hashed once.
    sent = sent.withColumn("bucket", F.when(F.col("bucket") < 0, F.pmod(F.col("doc_id"), F.lit(n)).cast("int")).otherwise(F.col("bucket")))
    found = by_bucket(sent, n).transform(mapped, lambda it: _settled_and_matched(it, window), _FOUND)
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))


def _settled_and_matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    later = []
    for batch in batches:
        settled = batch.filter(batch.column("doc_id").is_valid())
        if settled.num_rows:
            yield settled.select(["doc_id", "text_hash", "begin", "end"])
        runs = batch.filter(batch.column("starts").is_valid())
        if runs.num_rows:
            later.append(runs)
    yield from _match(iter(later), window)


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text: its words without those that a smaller doc_id has in the same window."""
    found = repeats(docs, window, doc_id, text).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("begins").alias("__begins"), F.col("ends").alias("__ends"))
    own, at, back = plain(docs)
    joined = own.join(found, (F.col(at(doc_id)).cast("long") == F.col("__id")) & (F.xxhash64(at(text)) == F.col("__hash")), "left").drop("__id", "__hash")
    return back(joined.transform(mapped, lambda it: _cut(it, at(text)), schema_of(own, "n_words long", "n_removed long", "kept_text string")))
