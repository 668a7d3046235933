"""Token counts of whole texts, without token ids.

A block of documents is cut to pre-tokens; each distinct pre-token of the block goes once to the bucket
of its hash. There the pieces of a pre-token are counted once. The counts go back to the block and are
joined to its frequencies of pre-tokens by document, which are summed. A frequent pre-token travels once a
block, however often it occurs, and what travels doesn't depend on the number of buckets.

Defined cases: a null text counts as an empty one (0 bytes, 0 tokens); a null doc_id is kept; repeated
rows give a row each; a text longer than a block is a block of its own, counted whole; other columns, whatever
their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASKED, answered, answers, ask, bucket_count, column, from_planes, mapped, numbered, pack, part, plain, planes, questions, steady, unpack

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text of a block, and of a bucket, whose distinct pre-tokens a task remembers.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20


@functools.cache
def tokenizer(path: str):
    """A tokenizer of the tokenizers library, read once a process, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(path)
    got.no_truncation()
    got.no_padding()
    return got


@functools.cache
def _specials(path: str) -> regex.Pattern | None:
    words = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, words)) + ")") if words else None


def pre_tokens(text: str, path: str, find=regex.compile(PATTERN).findall) -> list[str]:
    """The pre-tokens of a text; a special string stands as one."""
    special = _specials(path)
    if special is None or not special.search(text):
        return find(text)
    parts = special.split(text)  # text and special string by turns
    return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else find(part))]


def _send(batches: Iterator[pa.RecordBatch], path: str, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for block, table in numbered(batches, BLOCK_BYTES):
        texts = [t or "" for t in column(table, "text").to_pylist()]
        found = [pre_tokens(t, path) for t in texts]
        owner = np.repeat(np.arange(len(found)), list(map(len, found)))
        code, distinct = pd.factorize(np.array([x for f in found for x in f] + [None], object)[:-1])
        del found
        home = (pd.util.hash_array(distinct, categorize=False) % np.uint64(n_buckets)).astype(np.int64) if len(distinct) else np.empty(0, np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(distinct), np.int64)
        place[order] = np.arange(len(distinct))
        pieces = [distinct[i].encode() for i in order]
        pair, times = np.unique(owner << 32 | place[code], return_counts=True)
        ids = column(table, "doc_id")
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        head = pack(
            ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), planes(sizes),
            planes(np.bincount(pair >> 32, minlength=len(texts))), planes(pair & 0xFFFFFFFF), planes(times),
        )
        yield questions(n_buckets, block, home[order], lambda a, b: pack(planes(np.array(list(map(len, pieces[a:b])), np.int64)), b"".join(pieces[a:b])), head)  # noqa: B023


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The pieces of each distinct pre-token of a bucket, counted once, for each block that asks."""
    encode, known = tokenizer(path).encode_batch_fast, {}
    for batch in batches:
        out = []
        for _, block, begin, items, head in zip(*(c.to_pylist() for c in batch.columns)):
            if head is not None:
                out.append((block, None, None, head))
                continue
            sizes, data = unpack(items)
            ends = np.cumsum(from_planes(sizes)).tolist()
            pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
            new = [p for p in pieces if p not in known]
            if new:
                known.update(zip(new, (len(e) for e in encode([p.decode() for p in new], add_special_tokens=False))))
            out.append((block, begin, planes(np.array([known[p] for p in pieces], np.int64)), None))
        if out:
            yield answers(out)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for head, pieces in answered(batches):
        ids, nulls, sizes, uses, places, times = unpack(head)
        uses = from_planes(uses)
        sums = np.bincount(np.repeat(np.arange(len(uses)), uses), weights=pieces[from_planes(places)] * from_planes(times), minlength=len(uses))
        yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, bool)), pa.array(from_planes(sizes)), pa.array(sums.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, for the byte-level BPE vocabulary in a file of the tokenizers library."""
    n = buckets or bucket_count(docs, BUCKET_BYTES)
    own, at, _ = plain(steady(docs))
    base = own.select(F.col(at(doc_id)).cast("long").alias("doc_id"), F.col(at(text)).alias("text"), part())
    asked = base.transform(mapped, lambda it: _send(it, path, n), ASKED)
    each = ask(asked, n, lambda it: _count(it, path), _finish, "doc_id long, n_bytes long, n_tokens long")
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
