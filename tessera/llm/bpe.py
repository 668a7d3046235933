"""BPE encoding and decoding of whole texts with a word-ending vocabulary.

The merges of a pre-token are found in a segment tree over its adjacent pairs: a leaf holds the rank
and the place of the pair that starts there, a node the least of its two children, so the root is the
leftmost pair of lowest rank. A merge changes three leaves, each with the path above it, until the
root says that no pair can merge. The trees of all distinct pre-tokens of a block that have about the
same length are arrays side by side, and take one step of each at a time.

The file gives vocabulary, merges and special strings; its normal form (NFC, white space, lower case),
pre-token pattern, word ending and the decoding by single spaces are those of such files and are
checked when it is read.

Defined cases: a null text counts as an empty one, with no tokens and an empty decoded text; special
strings in a text become their tokens; repeated rows and null ids are kept; a text longer than a block is encoded
alone and whole; other columns stay (one that has an output's name as that name and `_in`); an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, column, mapped, plain, ranges, schema_of

NONE = np.int64(1) << 62
#: Cells of the trees that grow side by side.
TREE_CELLS = 1 << 18
_ODD_WHITE = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\s+")


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [out[b] for b in range(256)]


class Vocabulary:
    """Symbols, pair ranks and special strings of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf8") as f:
            said = json.load(f)
        model, ids = said["model"], said["model"]["vocab"]
        ending = model["end_of_word_suffix"]
        kinds = [x["type"] for x in said["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not ending or said["decoder"] is not None or kinds != ["NFC", "Replace", "Lowercase"] or model["ignore_merges"]:
            raise ValueError(f"{path} isn't a BPE vocabulary with word endings as this encoder takes it")
        self.cut = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.marks = {s[0] for s in self.special if s}
        names = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.inner = np.array([ids[c] for c in _byte_characters()], np.int64)
        self.last = np.array([ids[c + ending] for c in _byte_characters()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for pairs that don't merge (a symbol of -1 is no symbol)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens, one after another, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.array(list(map(len, raw)), np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        width = np.maximum(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 2)
        counts = np.ones(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width).tolist():
            some = np.flatnonzero(width == w)
            for i in range(0, len(some), max(1, TREE_CELLS // w)):
                one = some[i : i + max(1, TREE_CELLS // w)]
                grid = np.full((len(one), w), -1, np.int64)
                grid[np.repeat(np.arange(len(one)), sizes[one]), ranges(np.zeros(len(one), np.int64), sizes[one])] = symbols[ranges(ends[one] - sizes[one], sizes[one])]
                got = self._merge(grid)
                left = got >= 0
                counts[one] = left.sum(1)
                parts.append((one, got[left]))
        out = np.empty(int(counts.sum()), np.int64)
        begins = np.cumsum(counts) - counts
        for one, got in parts:
            out[ranges(begins[one], counts[one])] = got
        return out, counts

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge the rows of symbols (padded by -1 to a power of two); what a merge takes in becomes -1."""
        n, width = symbols.shape
        bits = width.bit_length() - 1
        place = np.arange(width)
        tree = np.full((n, 2 * width), NONE, np.int64)
        first = self.rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(first < NONE, first << bits | place[:-1], NONE)
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))  # the next symbol's place; the last column is a dummy
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        wide = np.concatenate([symbols, np.full((n, 1), -1, np.int64)], 1)

        def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + width
            tree[row, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at = root & (width - 1)
            taken = after[live, at]
            then = after[live, taken]
            wide[live, at] = self.merged[root >> bits]
            wide[live, taken] = -1
            after[live, at] = then
            before[live, np.minimum(then, width)] = at
            update(live, taken, np.full(len(live), NONE))
            follows = self.rank(wide[live, at], wide[live, np.minimum(then, width)])
            update(live, at, np.where(follows < NONE, follows << bits | at, NONE))
            prior = before[live, at]
            has = np.flatnonzero(prior >= 0)
            if len(has):
                row, p = live[has], prior[has]
                leads = self.rank(wide[row, p], wide[row, at[has]])
                update(row, p, np.where(leads < NONE, leads << bits | p, NONE))
            live = live[tree[live, 1] < NONE]
        return wide[:, :width]

    def chunks(self, text: str) -> list[str]:
        """A text as its stretches without white space, normalised; special strings as they stand, after a space."""
        parts = self.split(text) if any(m in text for m in self.marks) else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(" " + part)
                continue
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += plain.split() if not _ODD_WHITE.search(plain) else [x for x in _WHITE.split(plain) if x]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, how many each has, and each text decoded from its ids."""
        found = [self.chunks(t) for t in texts]
        sizes = np.array(list(map(len, found)), np.int64)
        code, distinct = pd.factorize(np.array([x for f in found for x in f] + [None], object)[:-1])
        cut = [[d] if d[0] == " " else self.cut(d) for d in distinct]
        n_cut = np.array(list(map(len, cut)), np.int64)
        which, pieces = pd.factorize(np.array([x for c in cut for x in c] + [None], object)[:-1])
        ids, counts = self.encode_words([p for p in pieces]) if len(pieces) else (np.empty(0, np.int64), np.empty(0, np.int64))
        begins = np.cumsum(counts) - counts
        for i, p in enumerate(pieces):
            if p[0] == " ":
                ids[begins[i]] = self.special[p[1:]]
                ids[begins[i] + 1 : begins[i] + counts[i]] = -1
        if (ids < 0).any():
            keep = ids >= 0
            counts = np.add.reduceat(keep.astype(np.int64), begins)
            ids, begins = ids[keep], np.cumsum(counts) - counts
        # pre-tokens to chunks, chunks to texts
        ids = ids[ranges(begins[which], counts[which])]
        chunk_n = np.zeros(len(distinct), np.int64)
        np.add.at(chunk_n, np.repeat(np.arange(len(distinct)), n_cut), counts[which])
        chunk_at = np.cumsum(chunk_n) - chunk_n
        names, listed = self.names, ids.tolist()
        decoded = [" ".join([names[i] for i in listed[a : a + n]]) for a, n in zip(chunk_at.tolist(), chunk_n.tolist())]
        ends = np.cumsum(sizes)
        codes = code.tolist()
        out = [" ".join([decoded[c] for c in codes[e - n : e]]) for e, n in zip(ends.tolist(), sizes.tolist())]
        each = np.append(0, np.cumsum(chunk_n[code]))
        return ids[ranges(chunk_at[code], chunk_n[code])], each[ends] - each[ends - sizes], out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, text):
        ids, counts, decoded = vocabulary(path).encode([t or "" for t in column(block, text).to_pylist()])
        ends = np.cumsum(counts)
        data = ids.astype("<u4").tobytes()
        packed = pa.array([data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())
        table = block.append_column("n_tokens", pa.array(counts, pa.int64())).append_column("ids", packed).append_column("decoded", pa.array(decoded, pa.string()))
        yield from table.combine_chunks().to_batches()


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids (little-endian unsigned 32-bit integers) and decoded, the text that the ids give."""
    own, at, back = plain(docs)
    return back(own.transform(mapped, lambda it: _encode(it, path, at(text)), schema_of(own, "n_tokens long", "ids binary", "decoded string")))
