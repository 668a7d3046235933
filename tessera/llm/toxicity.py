"""A convolutional toxicity classifier over hashed words, trained in numpy.

Words (lower-cased, cut at white space and ASCII punctuation) have two hashed embeddings side by side,
so two words are mixed up only if both hashes meet. Filters of several widths slide over them, the
largest response of each filter in a text is kept, and a logistic layer makes the score of it. Words
that training hasn't seen have embeddings of zero.

Training takes at most TRAIN_ROWS labelled rows, those of least hash of doc_id; a fifth of them is kept
aside to shift the scores so that 0.3 is the best threshold over all, and to find the threshold of each
language with enough of its labels. Every text is scored whole.

Defined cases: a null or empty text is scored as a text without words; rows without a doc_id or label
don't train; a doc_id labelled more than once trains by its largest label; without both labels among
the training rows every score is the share of label 1 (0 if there are no labels); repeated rows, null
ids and other columns are kept (a column toxicity as toxicity_in); a text longer than a block is scored alone
and whole; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import PUNCTUATION, U64, blocks, column, mapped, plain, ranges, schema_of, word_hashes

#: Most labelled rows that training takes.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
BITS, DIM, FILTERS, WIDTHS = 16, 8, 12, (1, 2, 3)
EPOCHS, STEP, BATCH = 8, 0.1, 64
#: A language's own threshold needs so many of its labels of either kind.
LEAST_LABELS = 20


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both buckets of each word, packed in 32 bits, and the words of each text."""
    words, counts = word_hashes(pc.utf8_lower(texts), PUNCTUATION)
    return ((words & U64((1 << BITS) - 1)) | (words >> U64(40) & U64((1 << BITS) - 1)) << U64(16)).astype(np.uint32), counts


class Model:
    """Embeddings, filters and the logistic layer; thresholds by language."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tables = np.zeros((2, 1 << BITS, DIM), np.float32)
        self.filters = [(rng.standard_normal((w * 2 * DIM, FILTERS)) / np.sqrt(2 * DIM)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.offset = 0.0
        self.thresholds: dict[str, float] = {}
        self.rng = rng

    def _layout(self, packed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings with empty places after each text, so that no window reaches the next one."""
        pad = max(WIDTHS)  # an empty text has one window, all padding
        starts = np.cumsum(counts + pad) - (counts + pad)
        x = np.zeros((int((counts + pad).sum()) + pad, 2 * DIM), np.float32)
        at = ranges(starts, counts)
        x[at, :DIM] = self.tables[0][packed & 0xFFFF]
        x[at, DIM:] = self.tables[1][packed >> 16]
        return x, starts, at

    def _responses(self, x: np.ndarray, w: int, filters: np.ndarray) -> np.ndarray:
        n = len(x) - max(WIDTHS) + 1
        out = x[:n] @ filters[: 2 * DIM]
        for j in range(1, w):
            out += x[j : n + j] @ filters[2 * DIM * j : 2 * DIM * (j + 1)]
        return out

    def logits(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.empty(0)
        x, starts, _ = self._layout(packed, counts)
        edges = np.stack([starts, starts + np.maximum(counts, 1)], 1).ravel()
        pooled = [np.maximum.reduceat(self._responses(x, w, f), np.minimum(edges, len(x) - max(WIDTHS)), axis=0)[::2] for w, f in zip(WIDTHS, self.filters)]
        return np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.offset

    def gradients(self, packed: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple:
        """Of the mean logistic loss: for each table the rows and their gradients, then filters, bias, output weights and offset."""
        x, starts, at = self._layout(packed, counts)
        place = np.full(len(x), -1, np.int64)
        place[at] = packed
        pooled, best = [], []
        for w, f in zip(WIDTHS, self.filters):
            r = self._responses(x, w, f)
            top = np.stack([s + r[s : s + max(n, 1)].argmax(0) for s, n in zip(starts, counts)])
            best.append(top)
            pooled.append(np.take_along_axis(r, top, 0))
        hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        error = (1 / (1 + np.exp(-(hidden @ self.out + self.offset))) - labels).astype(np.float32) / len(counts)
        back = error[:, None] * self.out * (hidden > 0)
        filters, rows, many = [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            d, c = np.nonzero(g)
            at_best, value = best[k][d, c], g[d, c]
            near = np.concatenate([x[at_best + j] for j in range(w)], 1)
            own = np.zeros_like(f)
            np.add.at(own.T, c, near * value[:, None])
            filters.append(own)
            for j in range(w):
                rows.append(place[at_best + j])
                many.append(f[2 * DIM * j : 2 * DIM * (j + 1), c].T * value[:, None])
        row, value = np.concatenate(rows), np.concatenate(many)
        row, value = row[row >= 0], value[row >= 0]
        tables = []
        for t, bucket in enumerate((row & 0xFFFF, row >> 16)):
            own, inverse = np.unique(bucket, return_inverse=True)
            g = np.zeros((len(own), DIM), np.float32)
            np.add.at(g, inverse, value[:, t * DIM : (t + 1) * DIM])
            tables.append((own, g))
        return tables, filters, back.sum(0), hidden.T @ error, float(error.sum())

    def fit(self, packed: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> None:
        rate = labels.mean() if len(labels) else 0.0
        if rate in (0.0, 1.0):
            self.out[:] = 0
            self.offset = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (40.0 if rate else -40.0)
            return
        owner = np.repeat(np.arange(len(counts)), counts)
        for t, buckets in enumerate((packed & 0xFFFF, packed >> 16)):
            # documents with a bucket, by label: what tells the labels apart starts apart
            once = np.unique(owner * (1 << BITS) + buckets)
            bucket, label = once & (1 << BITS) - 1, labels[once >> BITS]
            a, b = (np.bincount(bucket[label == k], minlength=1 << BITS) for k in (1, 0))
            n1, n0 = labels.sum(), (1 - labels).sum()
            p = (a + b) / len(labels)
            z = (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
            self.tables[t][:, 0] = np.sign(z) * np.clip(np.abs(z) - 3, 0, 6) / 3
            self.tables[t][:, 1:] = self.rng.standard_normal((1 << BITS, DIM - 1)) * 0.03 * (a + b > 2)[:, None]
        self.offset = float(np.log(rate / (1 - rate)))
        begins = np.cumsum(counts) - counts
        memory = [np.full(v.shape, 1e-3, np.float32) for v in (self.tables, *self.filters, self.bias, self.out)]
        offset_memory = 1e-3
        for epoch in range(EPOCHS):
            step = STEP / (1 + epoch / 3)
            order = self.rng.permutation(len(counts))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                words, n = packed[ranges(begins[some], counts[some])], counts[some]
                tables, filters, bias, out, offset = self.gradients(words, n, labels[some])
                for t, (own, g) in enumerate(tables):
                    memory[0][t][own] += g * g
                    self.tables[t][own] -= step * g / np.sqrt(memory[0][t][own])
                for value, g, held in zip((*self.filters, self.bias, self.out), (*filters, bias, out), memory[1:]):
                    held += g * g
                    value -= step * 0.3 * g / np.sqrt(held)
                offset_memory += offset**2
                self.offset -= step * 0.3 * offset / offset_memory**0.5

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: list) -> None:
        if len(labels) and 0 < labels.mean() < 1:
            self.offset += float(np.log(THRESHOLD / (1 - THRESHOLD))) - (best := _best_cut(logits, labels))
            logits = logits + float(np.log(THRESHOLD / (1 - THRESHOLD))) - best
        for lang in {x for x in langs if x is not None}:
            own = np.array([x == lang for x in langs])
            if own.sum() and min(labels[own].sum(), (1 - labels[own]).sum()) >= LEAST_LABELS:
                cut = _best_cut(logits[own], labels[own])
                self.thresholds[lang] = float(np.clip(1 / (1 + np.exp(-cut)), 0.1, 0.9))


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap at the cut of largest F1."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(labels) + 1) + labels.sum())
    ends = np.append(np.diff(logits[order]) != 0, True)
    i = int(np.argmax(np.where(ends, f1, -1)))
    return float(logits[order][i] + (logits[order][i + 1] if i + 1 < len(order) else logits[order][i] - 2)) / 2


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels must not train; false where there is no doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Model:
    """A model from at most `rows` labelled documents that aren't held out."""
    own, at, _ = plain(docs)
    marks, of, _ = plain(labels)
    usable = marks.select(F.col(of(doc_id)).alias("__id"), F.col(of(label)).alias("label")).filter(F.col("__id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("__id")))
    usable = usable.groupBy("__id").agg(F.max("label").alias("label"))
    every = max(1, usable.count() // (2 * rows))  # so that a task sends few rows, however many tasks there are
    some = usable.filter(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    found = own.join(F.broadcast(some), F.col(at(doc_id)) == F.col("__id")).select("__id", F.col(at(text)).alias("text"), F.col(at(lang)).alias("lang"), "label")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            packed, counts = _buckets(column(block, "text"))
            ends = np.cumsum(counts)
            data = [packed[e - n : e].tobytes() for e, n in zip(ends, counts)]
            yield pa.record_batch([column(block, "__id"), column(block, "lang"), column(block, "label").cast(pa.int64()), pa.array(data, pa.binary())], names=["id", "lang", "label", "words"])

    id_type = found.schema["__id"].dataType.simpleString()
    words = found.transform(mapped, buckets, f"id {id_type}, lang string, label long, words binary")
    # one task fits, so that the driver holds the model only
    got = words.repartition(1).transform(mapped, _fit, "model binary").toArrow().column("model")
    return pickle.loads(got[0].as_py()) if len(got) else _fitted(None)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, pickled."""
    held = list(batches)
    model = _fitted(pa.Table.from_batches(held) if held else None)
    yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def _fitted(rows: pa.Table | None) -> Model:
    """A model of rows (id, lang, label, words), in the order of their ids."""
    model = Model()
    got = rows.sort_by("id") if rows is not None else pa.table({"lang": pa.array([], pa.string()), "label": pa.array([], pa.int64()), "words": pa.array([], pa.binary())})
    words = [np.frombuffer(x.as_py(), np.uint32) for x in column(got, "words")]
    y = column(got, "label").to_numpy().astype(np.float32)
    counts = np.array([len(w) for w in words], np.int64)
    langs = column(got, "lang").to_pylist()
    aside = np.arange(len(words)) % 5 == 4
    flat = lambda keep: np.concatenate([words[i] for i in np.flatnonzero(keep)] or [np.empty(0, np.uint32)])
    model.fit(flat(~aside), counts[~aside], y[~aside])
    logits = np.concatenate([model.logits(flat(np.isin(np.arange(len(words)), i)), counts[i]) for i in np.array_split(np.flatnonzero(aside), max(1, int(aside.sum()) // 200))]) if aside.any() else np.empty(0)
    model.calibrate(logits, y[aside], [langs[i] for i in np.flatnonzero(aside)])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity, the score of each whole text."""
    own, at, back = plain(docs)
    name = at(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, name, most_bytes=1 << 20):
            packed, counts = _buckets(column(block, name))
            scores = 1 / (1 + np.exp(-model.logits(packed, counts).astype(np.float64)))
            yield from block.append_column("toxicity", pa.array(scores, pa.float64())).combine_chunks().to_batches()

    return back(own.transform(mapped, run, schema_of(own, "toxicity double")))


def threshold(model: Model, lang: Column) -> Column:
    """The threshold of each language; THRESHOLD for those without enough labels."""
    out = F.lit(THRESHOLD)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
