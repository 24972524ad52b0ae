"""Vectorised text primitives over Arrow string columns.

A column arrives as one UTF-8 buffer with offsets. Words, lines and shingles
are spans of that buffer. A span's 64-bit hash absorbs eight bytes a step
through a multiply and shift round; one step is taken for all spans of a batch
at once, so hashing needs no Python loop over words. Spans of more than
LONG bytes are hashed one by one.

Words are ``[^\\x20\\x09-\\x0D]+``: only ASCII white space separates.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text handled at once: bounds the temporaries of a worker.
CHUNK_BYTES = 1 << 20
#: Spans of more bytes are hashed one by one.
LONG = 64

LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_libc: list = []
_SEED, _STEP = 0x3C79AC492BA7B653, U64(0x1C69B3F74AC4AE35)
#: Keeps the low k of eight bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _lanes(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each place, of which `left` count (the others are 0)."""
    windows_ = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return windows_[at].view("<u8").ravel() & _KEEP[np.minimum(left, 8)]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans. Spans of up to eight bytes and equal length never share one."""
    padded = np.concatenate([LOWER_BYTE[buf] if lower else buf, np.zeros(8, np.uint8)])
    size = (ends - starts).astype(np.int64)
    out = size.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(_SEED)
    long = np.flatnonzero(size > LONG)
    if len(long):
        data = memoryview(padded)
        out[long] = [xxhash.xxh3_64_intdigest(data[a:b], seed=_SEED) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    open_ = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[open_], size[open_]
    while len(open_):
        h = (out[open_] ^ _lanes(padded, at, left)) * _STEP
        out[open_] = h ^ h >> U64(32)
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return mix(out)


def equal_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, lower: bool = False) -> np.ndarray:
    """Whether each span has the bytes of the span whose index `other` gives."""
    padded = np.concatenate([LOWER_BYTE[buf] if lower else buf, np.zeros(8, np.uint8)])
    size = ends - starts
    same = size == size[other]
    long = np.flatnonzero(same & (size > LONG) & (other != np.arange(len(size))))
    if len(long):
        data = memoryview(padded)
        for k, o in zip(long.tolist(), other[long].tolist(), strict=True):
            same[k] = data[starts[k] : ends[k]] == data[starts[o] : ends[o]]
    open_ = np.flatnonzero(same & (size <= LONG) & (other != np.arange(len(size))))
    at, rep, left = starts[open_], starts[other[open_]], size[open_]
    while len(open_):
        differ = _lanes(padded, at, left) != _lanes(padded, rep, left)
        same[open_[differ]] = False
        more = ~differ & (left > 8)
        open_, at, rep, left = open_[more], at[more] + 8, rep[more] + 8, left[more] - 8
    return same


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null text counts as empty)."""
    c = batch.column(batch.schema.get_field_index(name))
    return c.fill_null("") if c.null_count else c


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string array."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with at most `limit` bytes, or one longer row."""
    buf, offsets = flat(texts)
    i, n = 0, len(texts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    give_back()


def give_back() -> None:
    """Return memory that Arrow and the C library keep for later to the system: several workers share a machine."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        with contextlib.suppress(OSError, AttributeError):
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        _libc.append(lambda _: 0)
    _libc[0](0)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row boundary."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word of each row (n + 1)."""
    starts, ends = _runs(~IS_SPACE[buf], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the newline) and row of each line; a row has one line more than newlines."""
    breaks = np.flatnonzero(buf == 10)
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.concatenate([np.arange(len(offsets) - 1), row_of])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True))
    ends[last] = offsets[1:][rows[last]]
    return starts, ends, rows


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of each character and the first character of each row (n + 1)."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = buf[at].astype(np.uint32)
    point = b.copy()
    wide = np.flatnonzero(b >= 0xC0)
    if len(wide):
        w, start = b[wide], at[wide]
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        c1, c2, c3 = (padded[start + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        three, four = (w & 0x0F) << 12 | c1 << 6 | c2, (w & 0x07) << 18 | c1 << 12 | c2 << 6 | c3
        point[wide] = np.where(w < 0xE0, (w & 0x1F) << 6 | c1, np.where(w < 0xF0, three, four))
    return point, np.concatenate([[0], np.cumsum(lead)])[offsets]


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, given the first item of each row (n + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start item of each window of `width` items within a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    room = np.repeat(first[1:], np.diff(first))[:n] >= np.arange(width, n + width)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : n + k] * _MULTIPLIERS[k]
    at = np.flatnonzero(room)
    return mix(total[at]), at


def sum_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's items; 0 for a row without items."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def scratch_dir(spark, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset on a local master (tests), it is set to a temporary folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames) -> None:
    """Delete what `stored` wrote for these frames, which nothing that is still to run may read."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits in a bitmap of hashes: at most so many rows are broadcast, whatever the table.
BITMAP_WORDS = 1 << 20


def hash_bitmap(hashes, name: str):
    """(word, bits) of a bitmap over a column of 64-bit hashes: a bounded table, written to the shared folder."""
    from pyspark.sql import functions as F

    h = F.col(hashes.columns[0])
    rows = hashes.select((F.shiftrightunsigned(h, 6) % BITMAP_WORDS).alias("word"), F.expr(f"shiftleft(1L, CAST({hashes.columns[0]} & 63 AS INT))").alias("bit"))
    return stored(rows.groupBy("word").agg(F.bit_or("bit").alias("bits")), name)


def in_bitmap(df, column_name: str, bitmap):
    """`df` with boolean _may: false only if the hash in the column is not in the bitmap."""
    from pyspark.sql import functions as F

    h = F.col(column_name)
    own = df.withColumn("_word", F.shiftrightunsigned(h, 6) % BITMAP_WORDS).join(F.broadcast(bitmap.withColumnsRenamed({"word": "_word", "bits": "_bits"})), "_word", "left")
    hit = F.expr(f"(shiftrightunsigned(_bits, CAST(`{column_name}` & 63 AS INT)) & 1) = 1")
    return own.withColumn("_may", F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def small_batches(spark) -> None:
    """Arrow batches of few rows: one batch of very long texts must fit a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


@contextlib.contextmanager
def batch_rows(spark, rows: int):
    """At most `rows` rows an Arrow batch for what is executed inside: for rows that are megabytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_remainder(column_name: str, modulus: int):
    """crc32 of an integer id written as text, modulo `modulus` (a null id counts as empty text)."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column_name).cast("string"), F.lit("")).cast("binary")) % modulus
