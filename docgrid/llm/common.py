"""What the corpus operators share: cuts of the lineage, text buffers, hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.shared import forget, shared_dir

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that one numpy step works on; bounds a worker's memory.
STEP_BYTES = 1 << 19


@contextlib.contextmanager
def settings(spark: SparkSession, **values: object):
    """Session settings (dots written as ``__``) while a table is written; the old values come back."""
    keys = {k.replace("__", "."): str(v) for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arrow_rows(spark: SparkSession, rows: int = 1000):
    """Fewer rows in an Arrow batch while it lasts: texts are long, and a batch is whole in memory."""
    old = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=min(rows, old) if old > 0 else rows, spark__sql__execution__arrow__maxBytesPerBatch=16 << 20)


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again.

    The written table outlives lost executors and ends the lineage; the shuffle
    files behind it are removed with the write (a setting of Spark's own).
    Returns the table and its place, so that the caller can ``forget`` it after
    its last reader; the rest goes when the driver ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/docgrid/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark), settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(where)
    atexit.register(forget, spark, where)
    return spark.read.schema(df.schema).parquet(where), where


def salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each ``key``: rows of a hot key go to ``salts`` tasks, dealt by ``by``."""
    one = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    all_ = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(all_, [key, "__salt"], how).drop("__salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id, m: int):
    """crc32 of the id as text, modulo ``m``; the folds of the contracts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(m)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back: a worker that waits for its next task, of whatever job, holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in runs of whole rows of about ``most`` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        n, i = batch.num_rows, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
    release()


#: Fixed seeds: hashes must be the same in every worker and session.
_TABLES = np.random.Generator(np.random.PCG64(20240131)).integers(0, 2**64, (2, 256), np.uint64, endpoint=False)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base, and of its inverse, modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        base = _BASES[which]
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:  # doubling
                m = min(k, size - k)
                p[k : k + m] = p[:m] * np.uint64(pow(b, k, 2**64))
                k += m
            out.append(p)
        have = _POWERS[which] = (out[0], out[1])
    return have


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """n + 1 sums of a polynomial in the bytes; differences give hashes of any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * powers(len(data), which)[0][: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sub_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end), the same wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), which)[1][start])


#: Bytes up to which strings are hashed together, eight at a time.
_SHORT = 64


class Lanes:
    """A hash of sequences of 64-bit words, many at a time: two lanes of state, each stirred by every word.

    A lane alone could be steered: for any change of one word there is a change
    of the next that undoes it. No single word undoes a change in both, so a
    collision takes the search that any 64-bit hash does, some 2**32 trials.
    """

    def __init__(self, start: np.ndarray) -> None:
        self.a = mix(start * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
        self.b = mix(start ^ np.uint64(0xA0761D6478BD642F))

    def add(self, word: np.ndarray, live=slice(None)) -> None:
        self.a[live] = mix(self.a[live] * np.uint64(0xD1342543DE82EF95) + word)
        self.b[live] = mix((self.b[live] ^ mix(word)) * np.uint64(0xE7037ED1A0B428DB))

    def end(self) -> np.ndarray:
        return mix(self.a + mix(self.b * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(0x589965CC75374CC3)))


def string_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings [start, end).

    Strings of up to seven bytes have hashes of their own, a bijection of bytes
    and size. Longer ones go through ``Lanes``, those above ``_SHORT`` through
    blake2b.
    """
    size = end - start
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    left = np.clip(size, 0, 7).astype(np.uint64)
    chunk = eight[start] & ((np.uint64(1) << (np.uint64(8) * left)) - np.uint64(1))
    h = mix(chunk | size.astype(np.uint64) << np.uint64(56))
    mid = np.flatnonzero((size > 7) & (size <= _SHORT))
    if len(mid):
        lanes, at, n = Lanes(size[mid].astype(np.uint64)), start[mid], size[mid]
        for k in range(0, _SHORT, 8):
            live = np.flatnonzero(n > k)
            if not len(live):
                break
            left = np.minimum(n[live] - k, 8).astype(np.uint64)
            lanes.add(eight[at[live] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)), live)
        h[mid] = lanes.end()
    for i in np.flatnonzero(size > _SHORT):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts, A-Z lower-cased: (hash, start, end, n + 1 offsets into the words).

    Words are maximal runs of bytes that aren't white space; UTF-8 keeps
    those bytes out of longer characters.
    """
    low = _LOWER[data]
    solid = ~IS_SPACE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~solid[:-1]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~solid[1:]
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return string_hash(low, start, end), start, end, np.searchsorted(start, offsets)
