"""Search for benchmark items inside documents by size-partitioned MinHash containment.

Words are lower-cased and cut at white space and ASCII punctuation; sets are of runs of five words. Items
are parted by the number of their runs, at powers of two. For the items of a part, up to u runs long, a
document is cut to pieces of u / 2 runs, and each three pieces in a row are a set as large as the part asks
for: an item that stands in the document lies within one of them, so its share of that set is a quarter at
least, however long the document is. Items and sets have a minimum for each of HASHES hash functions; an
item is a candidate where one minimum agrees, and then the share of its runs that the whole document holds
is counted exactly. An item of up to EXACT distinct runs, or whose distinct runs fill less than half its part, is looked
up by so many of its runs that a document which holds the share holds one of them; that misses none.

Items go to all tasks in groups of about GROUP_ITEMS and GROUP_BYTES at most, as texts that each task indexes; a larger
benchmark takes a pass over the documents for each group, and the driver holds one group at a time.

Defined cases: an item or document of one to four words has one run, all its words; null texts hold
nothing; equal benchmark rows count once; repeated rows of documents are each reported; null ids are
kept; a text longer than a block is a block of its own, searched whole; other columns, whatever their names, take no
part in `find_items` and stay in `drop_contaminated`; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PUNCTUATION, U64, _BASE, blocks, column, mapped, materialise, mix, plain, ranges, shingles

WIDTH = 5
#: A set of 1.5 u runs is missed by an item of u / 2 runs, of which it holds 0.8, with a chance of 1e-6.
HASHES = 48
#: Items of up to so many distinct runs are looked up by their runs.
EXACT = 8
GROUP_ITEMS, GROUP_BYTES = 10_000, 16 << 20
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingles(pc.utf8_lower(texts), WIDTH, PUNCTUATION)


def _distinct(runs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.append(True, (np.diff(runs) != 0) | (np.diff(owner) != 0))[: len(runs)]
    return runs[new], owner[new]


class Index:
    """The items of a group: their distinct runs, by part and hash function the sorted minima, and the sorted runs that are looked up."""

    def __init__(self, texts: pa.Array, least: float) -> None:
        runs, counts = _runs(texts)
        self.runs, owner = _distinct(runs, np.repeat(np.arange(len(counts)), counts))
        self.counts = np.bincount(owner, minlength=len(counts))
        self.begins = np.cumsum(self.counts) - self.counts
        part = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
        exact = (self.counts <= EXACT) | (2 * self.counts < 1 << part)
        some = np.flatnonzero(exact & (self.counts > 0))
        n = self.counts[some] - np.maximum(np.ceil(least * self.counts[some] - 1e-9).astype(np.int64), 1) + 1
        keys, whose = self.runs[ranges(self.begins[some], n)], np.repeat(some, n)
        order = np.argsort(keys, kind="stable")
        self.keys, self.whose = keys[order], whose[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & U64(0xFFFF)).astype(np.int64)] = True
        self.parts = []
        for p in np.unique(part[~exact]).tolist():
            items = np.flatnonzero((part == p) & ~exact)
            own = self.runs[ranges(self.begins[items], self.counts[items])]
            starts = np.cumsum(self.counts[items]) - self.counts[items]
            minima = np.stack([np.minimum.reduceat(own * f, starts) for f in _FACTORS])
            order = np.argsort(minima, axis=1, kind="stable")
            values = np.take_along_axis(minima, order, 1)
            maybe = np.zeros((HASHES, 1 << 16), bool)
            np.put_along_axis(maybe, (values & U64(0xFFFF)).astype(np.int64), True, 1)
            self.parts.append((p, values, items[order], maybe))


def _find(batches: Iterator[pa.RecordBatch], index: Index, ids: pa.Array, least: float) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        runs, counts = _runs(column(block, "text"))
        if not len(runs):
            continue
        # pieces of each level: begin within the level below, and owner
        levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n_below, lowest = counts, index.parts[0][0] - 1 if index.parts else 0
        for p, *_ in index.parts:
            size = 1 << (p - 1 - lowest) if levels else 1 << (p - 1)
            n = -(-n_below // size)
            owner = np.repeat(np.arange(len(counts)), n)
            first = np.cumsum(n_below) - n_below
            levels[p] = (np.repeat(first, n) + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * size, owner)
            n_below, lowest = n, p - 1
        at = np.flatnonzero(index.maybe[runs.astype(np.uint16)])
        lo = np.searchsorted(index.keys, runs[at], "left")
        n = np.searchsorted(index.keys, runs[at], "right") - lo
        found_docs, found_items = [], []
        if n.any():
            found_docs.append(np.repeat(np.repeat(np.arange(len(counts)), counts)[at], n))
            found_items.append(index.whose[ranges(lo, n)])
        scaled = np.empty_like(runs)
        for i, factor in enumerate(_FACTORS):
            np.multiply(runs, factor, out=scaled)
            below = scaled
            for p, values, items, maybe in index.parts:
                starts, owner = levels[p]
                below = np.minimum.reduceat(below, starts)
                sets = below.copy()  # a piece with the next two of its document
                for step in (1, 2):
                    same = owner[step:] == owner[:-step]
                    np.minimum(sets[:-step], np.where(same, below[step:], U64(0xFFFFFFFFFFFFFFFF)), out=sets[:-step])
                at = np.flatnonzero(maybe[i][sets.astype(np.uint16)])
                lo = np.searchsorted(values[i], sets[at], "left")
                n = np.searchsorted(values[i], sets[at], "right") - lo
                if n.any():
                    found_docs.append(np.repeat(owner[at], n))
                    found_items.append(items[i][ranges(lo, n)])
        if not found_docs:
            continue
        pair = np.unique(np.concatenate(found_docs) * len(index.counts) + np.concatenate(found_items))
        doc, item = pair // len(index.counts), pair % len(index.counts)
        some = np.unique(doc)
        begins = np.cumsum(counts) - counts
        held = np.unique(mix(runs[ranges(begins[some], counts[some])] + np.repeat(some, counts[some]).astype(U64) * U64(_BASE)))
        for a in range(0, len(pair), 20_000):
            d, t = doc[a : a + 20_000], item[a : a + 20_000]
            n = index.counts[t]
            asked = mix(index.runs[ranges(index.begins[t], n)] + np.repeat(d, n).astype(U64) * U64(_BASE))
            at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
            shared = np.add.reduceat((held[at] == asked).astype(np.int64), np.cumsum(n) - n)
            keep = np.flatnonzero(shared >= least * n - 1e-9)
            docs = pa.array(d[keep])
            yield pa.record_batch(
                [column(block, "doc_id").take(docs), column(block, "text_hash").take(docs), ids.take(pa.array(t[keep])), pa.array(shared[keep]), pa.array(n[keep]), pa.array(shared[keep] / n[keep])],
                names=["doc_id", "text_hash", "item_id", "n_shared", "n_runs", "containment"],
            )


def find_items(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_runs, containment (and text_hash of the document) where a document holds `least` of an item's runs."""
    named, of, _ = plain(benchmark)
    items = named.select(F.col(of(item_id)).cast("long").alias("item_id"), F.col(of(item_text)).alias("text")).distinct()
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-size[0] // GROUP_ITEMS), -(-(size[1] or 0) // GROUP_BYTES))
    own, at, _ = plain(docs)
    base = own.select(F.col(at(doc_id)).cast("long").alias("doc_id"), F.col(at(text)).alias("text"), F.xxhash64(at(text)).alias("text_hash"))
    out = None
    for g in range(groups):
        group = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).toArrow()
        texts, ids = column(group, "text"), column(group, "item_id")
        part = base.transform(mapped, lambda it, texts=texts, ids=ids: _find(it, Index(texts, least), ids, least), "doc_id long, text_hash long, item_id long, n_shared long, n_runs long, containment double")
        part = materialise(part) if groups > 1 else part
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold an item."""
    found = find_items(docs, benchmark, least, doc_id, text).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own, at, back = plain(docs)
    return back(own.join(found, F.col(at(doc_id)).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(at(text)) == F.col("__hash")), "left_anti"))
