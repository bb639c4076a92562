"""Shared helpers: Arrow batches in bounded pieces, word tables and 64-bit hashes in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 20
BATCH_ROWS = 1024
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough for long texts; the library's runtime settings stay as they are."""
    from scenetally.session import tune

    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def texts(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(docs: list[bytes], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive documents of at most ``most`` bytes (one longer document is a run of its own)."""
    start, size = 0, 0
    for i, d in enumerate(docs):
        if i > start and size + len(d) > most:
            yield start, i
            start, size = i, 0
        size += len(d)
    if start < len(docs):
        yield start, len(docs)


def batch_of(schema: T.StructType, columns: Iterable) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)],
        schema=arrow,
    )


def frugal(run: Callable) -> Callable:
    """The same batch function, whose worker gives freed memory back to the system when its task ends.

    Workers outlive their tasks; without this each keeps the most it ever used beside the heap of the executor.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return task


def chosen(hashed: Column, wanted: int, total: int) -> Column:
    """A sample of about ``wanted`` of ``total`` rows by a 64-bit hash; some hashes are chosen however large the total."""
    if wanted >= total:
        return F.lit(True)
    least = max(1, (wanted << 63) // total)
    return F.shiftrightunsigned(hashed, 1) < F.lit(least).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# word bytes after lower-casing A-Z: digits, a-z and every byte of a character beyond ASCII
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NOT_SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _ODD, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Words:
    """Words of several documents: hash of each word, its document, and the first word of each document."""

    def __init__(self, docs: list[bytes], word_byte: np.ndarray):
        # 0xFF is in no UTF-8 text; here it only parts documents
        buffer = np.frombuffer(b"\xff" + b"\xff".join(docs) + b"\xff", dtype=np.uint8)
        inside = word_byte[buffer] & (buffer != 255)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.buffer = buffer
        lengths = np.fromiter((len(d) for d in docs), dtype=np.int64, count=len(docs))
        doc_start = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
        self.doc_byte = doc_start[:-1]
        self.first = np.searchsorted(self.starts, doc_start)  # of each document, and the end of the last
        self.counts = np.diff(self.first)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, dtype=np.uint64)
        flat = self.buffer[self.inside]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(flat)) - np.repeat(begin, lengths)
        h = np.add.reduceat(_BYTE[flat] * _powers(int(lengths.max()))[place], begin)
        return mix(h + lengths.astype(np.uint64) * _ODD)


def ngrams(h: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of the words at the given offsets, for every place where the last of them exists."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.full(n, (salt * 2654435761 + len(offsets)) % 2**64, dtype=np.uint64)
    for o in offsets:
        acc = mix(acc * _ODD + h[o : o + n])
    return acc


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="scenetally-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_at(df: DataFrame) -> tuple[DataFrame, str]:
    """keep(), and the folder of the table."""
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder; compressed and with known sizes, unlike a checkpoint."""
    return keep_at(df)[0]


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table of keep_at() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
