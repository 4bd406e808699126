"""Helpers shared by the operators: whole texts as byte arrays, vectorised word hashes, shared folders, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a single longer text is taken whole.
CHUNK_BYTES = 1 << 20
#: Word separators of `[^\x20\x09-\x0D]+`.
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that aren't part of a run of letters: all ASCII but letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: The first k bytes of eight, as a mask of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of over so many bytes are hashed one by one.
LONG_WORD = 256


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/urlatlas-checkpoints") -> str:
    """The shared folder of spark.checkpoint.dir. The fallback is for sessions of one machine that name none; on a cluster
    every node would have a folder of its own there, so that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where or fallback)
        _delete_on_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    return where or fallback


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that a lazy result reads; it goes when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there. Shuffle files of its making go when it is written: nothing needs
    them any more. Spark's own cleaner would only see that when the driver collects its garbage."""
    checkpoint_dir(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        out = df.select("*").checkpoint()
    finally:
        conf.set(key, before)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def crc_of_id(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def release() -> None:
    """Gives free memory back to the system: Python workers live on from task to task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep_freed() -> None:
    """Lets this process hold 64 MB that it has freed, till release(): steps that make arrays of a few MB over and over would
    otherwise get their pages from the system each time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Lets at most so many rows go to a Python worker at once: texts are long, and a batch lies in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, rows)
    return df


def tidy(run):
    """An Arrow map function that leaves no free memory behind."""

    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def with_columns(docs: DataFrame, schema: str, compute, whole: bool) -> DataFrame:
    """doc_id and what compute(texts) gives: a function made in the worker by compute(), from an Arrow array of texts to
    arrays. With `whole`, all columns of a row as struct `row` instead of doc_id, so that no join has to bring them back."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    first = StructField("row", docs.schema) if whole else docs.schema["doc_id"]
    names = [first.name, *new.names]

    def run(batches):
        of = compute()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(first.name), *of(b.column("row").field("text") if whole else b.column("text"))], names)

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if whole else docs.select("doc_id", "text")
    return small_batches(source).mapInArrow(tidy(run), StructType([first, *new.fields]))


def joined(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together as long as their texts have `limit` bytes at most; a larger one stays as it is."""
    held, size = [], 0
    for b in batches:
        n = b.column("text").nbytes
        if held and size + n > limit:
            yield _one(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if any(b.num_rows for b in batches) else batches[0]


def binary_array(data: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """Values data[starts[k] : starts[k + 1]], without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def binary_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binary values, and where each value's begin (one more than values)."""
    _, at, data = values.buffers()
    starts = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, at, data = column.buffers()
    starts = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def chunks(starts: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of at most `limit` bytes, or one row."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values in which every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def separates(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space of `[^\\x20\\x09-\\x0D]+`."""
    return _IS_SEPARATOR[data]


def word_spans(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word of every row, and how many words come before each row."""
    lo, hi = int(starts[0]), int(starts[-1])
    inside = ~separator[data[lo:hi]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[starts - lo] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, starts - lo)


def word_hashes(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, and how many words come before each row. Eight bytes at a time are mixed
    in by permutations, so words of equal length of up to eight bytes never share a hash; long words are hashed whole."""
    first, end, before = word_spans(data, starts, separator)
    if not len(first):
        return np.zeros(0, np.uint64), before
    part = np.zeros(int(starts[-1] - starts[0]) + 8, np.uint8)
    part[:-8] = _LOWER[data[int(starts[0]) : int(starts[-1])]]
    eight = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    length = end - first
    h = mix(length.astype(np.uint64) * np.uint64(_BASE))
    h = mix(h ^ eight[first] & _FIRST[np.minimum(length, 8)])
    k, more = 8, np.flatnonzero((length > 8) & (length <= LONG_WORD))
    while len(more):
        h[more] = mix(h[more] * np.uint64(_BASE) ^ eight[first[more] + k] & _FIRST[np.minimum(length[more] - k, 8)])
        k += 8
        more = more[length[more] > k]
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(part[first[k] : end[k]], digest_size=8).digest(), "little")
    return h, before


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_hashes(words: np.ndarray, before: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of runs of `width` words; a shorter row is one run; a row without words has none."""
    n = len(words)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        if k < n:
            runs[: n - k] = runs[: n - k] * np.uint64(_BASE) + words[k:]
    runs = mix(runs)
    out = []
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(distinct(runs[lo : hi - width + 1]))
        elif hi > lo:
            h = hi - lo
            for w in words[lo:hi].tolist():
                h = (h * _BASE + w) % 2**64
            out.append(mix(np.array([h ^ 0x5851F42D4C957F2D], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
