"""What the operators of this subpackage share: word hashing, packed exchanges, materialised steps.

Texts are hashed a block at a time in numpy, straight from the Arrow buffers, so no Python object
is made for a word. A 64-bit hash stands for a word or a run of words; two different ones among n
meet with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Words end at these bytes: space and \x09 to \x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte but letters and digits, for words without punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

#: Bytes of text hashed at a time (a longer text is hashed alone).
CHUNK_BYTES = 1 << 19
#: Bytes of a batch of rows between Spark and Python.
BATCH_BYTES = 4 << 20
#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True) if x.dtype != U64 else x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64, at least n of them; kept between calls up to 8 MB."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 1 << 20:
            _powers[base] = have
    return have[:n]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of hashes[i : i + width] for each i that has so many; the caller drops those that cross documents."""
    n = len(hashes)
    if n < width:
        return np.empty(0, U64)
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out *= U64(_BASE)
        out += hashes[k : n - width + 1 + k]
    return mix(out)


def word_hashes(texts: pa.Array, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and how many each text has. A null text has none."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    parts, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        if end > begin:
            got, starts = _hash_chunk(data[begin:end], offsets[at:to] - begin, separators)
            counts[at:to] = np.diff(np.append(np.searchsorted(starts, offsets[at:to] - begin), len(starts)))
            parts.append(got)
        at = to
    return (np.concatenate(parts) if parts else np.empty(0, U64)), counts


def _hash_chunk(data: np.ndarray, begins: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    white = separators[data]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[begins[begins < n]] = True
    before = cut[:n].copy()
    before[1:] |= white[:-1]
    after = cut[1:].copy()
    after[:-1] |= white[1:]
    inside = ~white
    starts = np.flatnonzero(before & inside)
    ends = np.flatnonzero(after & inside)
    sums = _BYTES[data]
    sums *= powers(_BASE, n)
    np.cumsum(sums, out=sums)
    out = sums[ends]
    out -= np.where(starts > 0, sums[starts - 1], U64(0))
    out *= powers(_BASE_INVERSE, n)[starts]
    out += (ends - starts).astype(U64)
    return mix(out), starts


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, where a Python worker hands back its free memory after each partition, as workers stay for the next stages.

    Batches are kept to BATCH_BYTES (if the session still has Spark's default of 64 MB), on both sides of the exchange with Python.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m").lower() in ("67108864", "67108864b", "64m", "64mb"):
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


def position_in_group(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups that have these counts."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of each range, one range after another."""
    return np.repeat(starts, lengths) + position_in_group(lengths)


def shingles(texts: pa.Array, width: int = 5, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of all texts and how many each text has.

    A text with fewer words, but one at least, has one shingle: all its words.
    """
    words, counts = word_hashes(texts, separators)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = position_in_group(counts)
    full = window_hashes(words, width)
    keep = np.flatnonzero((place + width <= counts[owner])[: len(full)]) if len(full) else np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not len(short):
        return full[keep], n
    begins = np.cumsum(counts) - counts
    lone = np.zeros(len(short), U64)
    for k in range(width - 1):
        has = counts[short] > k
        lone[has] = lone[has] * U64(_BASE) + words[begins[short[has]] + k]
    lone = mix(lone + counts[short].astype(U64))
    out = np.empty(int(n.sum()), U64)
    first = np.cumsum(n) - n
    is_long = np.ones(len(out), bool)
    is_long[first[short]] = False
    out[is_long] = full[keep]
    out[first[short]] = lone
    return out, n


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.Table]:
    """The batches as tables of at most so many rows and bytes of text (a longer text comes alone)."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(lengths[at : at + most_rows - rows])
            n = int(np.searchsorted(ends, most_bytes - size, "right"))
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(at, n))
                size, rows, at = size + int(ends[n - 1]), rows + n, at + n
            if rows >= most_rows or size >= most_bytes or (n < len(ends) and held):
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    got = table.column(name).combine_chunks()
    return got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)


def part() -> Column:
    """A column that `numbered` needs: the partition of a row within its own frame, also where frames are united."""
    return F.spark_partition_id().alias("part")


def numbered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Blocks with their numbers, the same ones if the task runs again."""
    for i, table in enumerate(blocks(batches, most_bytes=most_bytes)):
        yield table.column("part")[0].as_py() << 32 | i, table


def planes(values: np.ndarray) -> bytes:
    """Whole numbers, compressed by byte planes: all lowest bytes, then all second ones, up to the highest that isn't zero."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    data = np.ascontiguousarray(rows[:, :width].T).tobytes()
    return np.array([len(values), width], "<i8").tobytes() + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def from_planes(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<i8", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(data[16:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def pack(*parts: bytes) -> bytes:
    """Byte strings as one."""
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def unpack(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, "<i8", n, 8))
    return [data[b:e] for b, e in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


#: What blocks ask of buckets: items from place `begin` of the block's list on; and a block's own row, its head.
ASKED = "bucket int, block long, begin int, items binary, head binary"
#: A value for each item from place `begin` of the block's list on; and heads as they came.
ANSWERED = "block long, begin int, values binary, head binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("begin", pa.int32()), ("items", pa.binary()), ("head", pa.binary())])
_ANSWERED = pa.schema([("block", pa.int64()), ("begin", pa.int32()), ("values", pa.binary()), ("head", pa.binary())])


def questions(n_buckets: int, block: int, bucket: np.ndarray, items: Callable[[int, int], bytes], head: bytes | None) -> pa.RecordBatch:
    """A block's rows: its items, which lie sorted by bucket, a row for each bucket that has some; and its head, if it awaits answers."""
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket)).tolist() if len(bucket) else [0]
    rows = [(int(bucket[a]), block, a, items(a, b), None) for a, b in zip(cuts[:-1], cuts[1:])]
    if head is not None:
        rows.append((block % n_buckets, block, None, None, head))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)] if rows else [pa.array([], f.type) for f in _ASKED], schema=_ASKED)


def answers(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (block, begin, values, head)."""
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANSWERED)], schema=_ANSWERED)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each block's head and the values of all its items. Rows come sorted by block."""
    block, head, parts = None, None, []

    def whole() -> tuple[bytes, np.ndarray]:
        parts.sort(key=lambda x: x[0])
        return head, np.concatenate([from_planes(v) for _, v in parts]) if parts else np.empty(0, np.int64)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != block:
                if head is not None:
                    yield whole()
                block, head, parts = row[0], None, []
            if row[3] is not None:
                head = row[3]
            else:
                parts.append((row[1], row[2]))
    if head is not None:
        yield whole()


def ask(asked: DataFrame, n_buckets: int, answer: Callable, finish: Callable, schema: str, heads: DataFrame | None = None) -> DataFrame:
    """Deal what blocks ask to the buckets, and the answers back to the blocks (and the blocks' heads, if they don't ride with the questions).

    An item of a block costs its own bytes and those of its value, however many buckets there are.
    """
    found = by_bucket(asked, n_buckets).transform(mapped, answer, ANSWERED)
    found = found if heads is None else found.union(heads)
    return found.repartition("block").sortWithinPartitions("block").transform(mapped, finish, schema)


def steady(df: DataFrame) -> DataFrame:
    """df, if its partitions hold the same rows in the same order whenever they are computed (scans do), else a written copy.

    Blocks are known by partition and place, so a task that runs again must see the same blocks.
    """
    plan = df._jdf.queryExecution().optimizedPlan().treeString()
    kinds = {re.match(r"[\s:+|-]*(\w+)", x)[1] for x in plan.splitlines() if re.match(r"[\s:+|-]*(\w+)", x)}
    return df if kinds <= {"Relation", "RelationV2", "Project", "Filter", "LocalRelation", "Range"} else materialise(df)


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's size, 0 if it has none (such as for rows from Python)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def bucket_count(df: DataFrame, bucket_bytes: int = 8 << 20) -> int:
    """Buckets of an exchange: the shuffle partitions, more if the input is larger than that many buckets."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, -(-input_bytes(df) // bucket_bytes))


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """Partition i holds bucket i whole. A lost partition is computed anew from the map output."""
    return df.repartitionById(n, F.col("bucket"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir. Where it is unset, a temporary one, on a single machine only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(got)
    return got


def few_files(df: DataFrame, file_bytes: int = 256 << 20) -> int:
    """Files for tables that are small beside df: one for each so many bytes of df, two at least, as many as shuffle partitions at most."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(2, input_bytes(df) // file_bytes)))


_scopes = threading.local()


class Scratch:
    """Removes the tables that are materialised in it when it ends, also by an error; those of `result` stay."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.held = spark, [], []

    def __enter__(self) -> Scratch:
        self.outer, _scopes.paths = getattr(_scopes, "paths", None), self.paths
        return self

    def __exit__(self, *error) -> None:
        _scopes.paths = self.outer
        for path in self.paths:
            _remove(self.spark, path)
        for df in self.held:
            df.unpersist()

    def hold(self, df: DataFrame) -> DataFrame:
        """df, kept on the executors' disks until the scope ends; parts that are lost are computed again."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def result(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """df written so that it outlives this scope (it belongs to the one around it, if any)."""
        _scopes.paths = self.outer
        try:
            return materialise(df, files)
        finally:
            _scopes.paths = self.paths


def _remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place) if at_exit else files.delete(place, True)


def materialise(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write a frame as Parquet to the shared folder, in so many files if given, and read it back, which cuts its lineage.

    The table goes when the Scratch around it ends, at the latest when the driver does.
    """
    spark = df.sparkSession
    df = df.repartition(files) if files else df
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if (paths := getattr(_scopes, "paths", None)) is not None:
        paths.append(path)
    df.write.parquet(path)
    _remove(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """df with its columns named c0, c1, ..., which nothing here clashes with; the new name of a column; and the way back.

    On the way back an input column that has the name of an added one is kept as that name and `_in`.
    """
    names = df.columns

    def at(name: str) -> str:
        found = [i for i, n in enumerate(names) if n == name] or [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"there is no column {name!r} among {names}")
        return f"c{found[0]}"

    def back(out: DataFrame) -> DataFrame:
        own = {f"c{i}": n for i, n in enumerate(names)}
        taken = {c.lower() for c in out.columns if c not in own}
        final = []
        for c in out.columns:
            name = own.get(c, c)
            while c in own and name.lower() in taken:
                name += "_in"
            final.append(name)
        return out.toDF(*final)

    return df.toDF(*[f"c{i}" for i in range(len(names))]), at, back


def schema_of(df: DataFrame, *more: str) -> str:
    """The schema text of df (of plain names) and more columns."""
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), *more])
