"""What the operators share: shared-folder tables, and whole-batch tokenising with numpy.

Words are runs of bytes other than ``\\x20\\x09-\\x0D``; UTF-8 never uses those bytes inside a
character, so working on bytes gives the same words as working on code points.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a temporary folder stands in if driver and executors are one process; on a
    cluster that is an error, as every machine would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="webloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's own settings while a table is written: a query's shuffle files go when it has ended, and batches for Python
#: workers are of 8 MB at most, as the JVM keeps outside its heap what the largest took.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    The files of the query's shuffles are deleted once the table is written, as no later step reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom/{what}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name, None) for name in _WHILE_WRITING}
    for name, value in _WHILE_WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if "/webloom/" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers stay for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches, limit: int = 4 << 20, column: int = 1):
    """Slices of Arrow batches with about ``limit`` bytes in the given column, so that memory doesn't follow batch size."""
    for batch in batches:
        col = batch.column(column)
        if col.type in (pa.string(), pa.binary()):
            # a row is never split: one very long text makes a slice of its own
            ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
        else:
            ends = np.arange(len(col) + 1)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, side="right")) - 1)
            to = min(to, len(col))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, U64)
        out[0] = 1
        done, step = 1, base
        while done < size:  # doubling
            take = min(done, size - done)
            out[done : done + take] = out[:take] * U64(step)
            done += take
            step = step * step % (1 << 64)
        _powers[base] = have = out
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64, from which span_hash() hashes any span."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: equal bytes give equal hashes wherever they stand."""
    inverse = powers(_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def window_hash(buf: np.ndarray, width: int) -> np.ndarray:
    """span_hash() of every ``width`` neighbouring bytes."""
    sums = prefix_hash(buf)
    return mix((sums[width:] - sums[:-width]) * powers(_INVERSE, len(sums))[: len(sums) - width])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of several texts: h (hash), doc (index of the text), start, end (bytes in buf)."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = buf
        buf = _LOWER[buf] if lower else buf
        inside = ~_SPACE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(lengths)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.buf = buf
        self.h = span_hash(prefix_hash(buf), self.start, self.end)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of each text, sorted; a text of 1 to width-1 words has one, of all its words."""
    h, doc, n = words.h, words.doc, len(words.h)
    factor = [U64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    if n >= width:
        at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        s = np.zeros(len(at), U64)
        for k in range(width):
            s += mix(h[at + k] ^ U64(k)) * factor[k]
        docs, s = doc[at], mix(s)
    else:
        docs, s = np.zeros(0, np.int64), np.zeros(0, U64)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        first = np.searchsorted(doc, short)
        own = np.zeros(len(short), U64)
        for k in range(width - 1):
            more = np.flatnonzero(words.count[short] > k)
            own[more] += mix(h[first[more] + k] ^ U64(k)) * factor[k]
        own = mix(own ^ (words.count[short].astype(U64) << U64(56)))
        docs, s = np.concatenate((docs, short)), np.concatenate((s, own))
    order = np.lexsort((s, docs))
    docs, s = docs[order], s[order]
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (s[1:] != s[:-1])
        docs, s = docs[new], s[new]
    return docs, s
