"""Removal of repeated byte strings by anchors and fingerprints of growing detail.

This stands in for prefix doubling over positions: no ranks are paired at
growing offsets. A rank is a fingerprint of bytes cut from the text, the same
in every task, so none are numbered across the cluster. Spark deals the
(rank, position) pairs out by rank and sorts them; positions whose rank is
unique leave, the rest are ranked again in smaller cells of offsets.

Not every position starts: of each window of ``length`` bytes only the place of
its smallest ``GRAM``-byte hash does, its anchor. Equal windows have their
anchors at the same offset d, so a window repeats exactly if its anchor meets
another with an equal window around it. The offsets d of an anchor are ranked
as one run, then in cells, then one by one; what lies inside every window of a
cell is its rank, what all its windows cover is its cover:

* rank unique: none of its windows repeats, it leaves;
* cover repeated: all of its windows repeat, its bytes go;
* else it is ranked again in smaller cells. Of cells with repeated covers that
  share a rank with such a one, one for each cover stays as a witness.

Names are 64 bits where a wrong one costs only work, 128 bits where they decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import cut, forget, mix, prefix_hash, sub_hash, utf8

#: Bytes of the strings that mark anchors.
GRAM = 64
#: Offsets in a cell.
CELL = 12
#: Bytes of text, and entries, that a task works on at a time.
PIECE, HOLD = 1 << 18, 1 << 18

_ANCHOR = np.dtype([("name", "<u8"), ("key", "<i8"), ("at", "<i4"), ("lo", "<i2"), ("hi", "<i2")])
_CELL = np.dtype([("name", "<u8"), ("c0", "<u8"), ("c1", "<u8"), ("key", "<i8"), ("at", "<i4"), ("lo", "<i2"), ("hi", "<i2"), ("flag", "u1")])
_FOUND = "key long, at int, lo short, hi short, kind byte"
GONE, OPEN, WITNESS = 0, 1, 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts that end at ``ends``: each anchor's place, name, and lowest and highest offset of its windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    prefix = prefix_hash(data)
    start = np.arange(len(data) - gram + 1)
    name = sub_hash(prefix, start, start + gram)
    low = np.uint64((1 << 22) - 1)
    least = _least((mix(name) & ~low) | (start.astype(np.uint64) & low), length - gram + 1)
    window = np.arange(len(data) - length + 1)
    end = ends[np.searchsorted(ends, window, "right")]
    window = window[window + length <= end]
    if not len(window):
        return none, none.astype(np.uint64), none, none
    at = (least[window] & low).astype(np.int64)
    first = np.append(True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))
    a = np.flatnonzero(first)
    z = np.append(a[1:], len(at)) - 1
    return at[a], name[at[a]], at[a] - window[z], at[a] - window[a]


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(keys, bytes, ends, base): whole short texts together, long ones in pieces whose windows don't overlap."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column(1))
        i, n = 0, len(keys)
        while i < n:
            if offsets[i + 1] - offsets[i] > PIECE:
                text = data[offsets[i] : offsets[i + 1]]
                for a in range(0, len(text) - length + 1, PIECE):
                    part = text[a : a + PIECE + length - 1]
                    yield keys[i : i + 1], part, np.array([len(part)]), a
                i += 1
                continue
            j = i + 1
            while j < n and offsets[j + 1] - offsets[i] <= PIECE:
                j += 1
            yield keys[i:j], data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], 0
            i = j


def _names(text: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hashes of strings of one text, in pieces."""
    out = np.empty(len(start), np.uint64)
    piece = start // PIECE
    for p in np.unique(piece):
        m = np.flatnonzero(piece == p)
        a, z = start[m].min(), end[m].max()
        prefix = prefix_hash(text[a:z], which)
        out[m] = sub_hash(prefix, start[m] - a, end[m] - a, which)
    return out


def cells(text: np.ndarray, key: int, found: np.ndarray, length: int, size: int) -> np.ndarray:
    """Entries (``_CELL``) for the open and witness ranges of one text, split into cells of ``size`` offsets."""
    at, lo, hi, flag = (found[x].astype(np.int64) for x in ("at", "lo", "hi", "flag"))
    a, z = lo // size, hi // size
    count = z - a + 1
    row = np.repeat(np.arange(len(at)), count)
    cell = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at, flag = at[row], flag[row]
    lo, hi = np.maximum(lo[row], cell * size), np.minimum(hi[row], cell * size + size - 1)
    out = np.empty(len(row), _CELL)
    rank = _names(text, at - cell * size, at - (cell + 1) * size + 1 + length, 0)
    span = mix((lo * 4096 + hi).astype(np.uint64))
    out["name"] = mix(rank + cell.astype(np.uint64))
    for i, c in enumerate(("c0", "c1")):
        out[c] = mix(_names(text, at - hi, at - lo + length, i) + span)
    out["key"], out["at"], out["lo"], out["hi"], out["flag"] = key, at, lo, hi, flag
    return out


_PACKED = "bucket int, kind byte, rows binary"


def _packed(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int8()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "kind", "rows"])


def _by_bucket(x: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    """Sorted entries by the top bits of their name."""
    edge = np.searchsorted(x["name"], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return [(b, 0, x[a:z].tobytes()) for b, (a, z) in enumerate(zip(edge, np.append(edge[1:], len(x)))) if z > a]


def _found(x: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(x), 1 << 16):
        p, k = x[a : a + (1 << 16)], kind[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[c])) for c in ("key", "at", "lo", "hi")] + [pa.array(k.astype(np.int8))], names=["key", "at", "lo", "hi", "kind"])


def _buckets_of(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[bool, np.ndarray]]:
    """Entries of each bucket together, and what was settled before as it comes: (settled, entries)."""
    now, held = None, []
    for batch in batches:
        for bucket, settled, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
            x = np.frombuffer(rows, kind)
            if settled:
                yield True, x
                continue
            if bucket != now and held:
                yield False, np.concatenate(held)
                held = []
            now = bucket
            held.append(x)
    if held:
        yield False, np.concatenate(held)


def _deal(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "kind").sortWithinPartitions("bucket")


def _repeated_anchors(rows: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """(key, at, lo, hi, kind) of anchors whose first rank isn't unique."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            x = np.concatenate(held)
            x = x[np.argsort(x["name"], kind="stable")]
            first = np.append(True, x["name"][1:] != x["name"][:-1])
            many = np.zeros(len(x), bool)
            many[1:] |= ~first[1:]
            many[:-1] |= ~first[1:]
            out = []
            again = x[many]  # met in this task
            for a in range(0, len(again), 8192):
                out.append((turn % (1 << bits), 1, again[a : a + 8192].tobytes()))
                turn += 1
            one = x[first].copy()
            one["at"][many[first]] = -1  # passed on already; still meets others
            out += _by_bucket(one, bits)
            yield from _packed(out)

        for keys, data, ends, base in _pieces(batches, length):
            at, name, lo, hi = anchors(data, ends, length, gram)
            x = np.empty(len(at), _ANCHOR)
            doc = np.searchsorted(ends, at, "right")
            begin = np.append(0, ends[:-1])
            x["name"], x["key"], x["at"], x["lo"], x["hi"] = name, keys[doc], at - begin[doc] + base, lo, hi
            held.append(x)
            count += len(x)
            if count >= HOLD:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for settled, x in _buckets_of(batches, _ANCHOR):
            if not settled:
                x = x[np.argsort(x["name"], kind="stable")]
                same = x["name"][1:] == x["name"][:-1]
                many = np.zeros(len(x), bool)
                many[1:] |= same
                many[:-1] |= same
                x = x[many & (x["at"] >= 0)]
            yield from _found(x, np.full(len(x), OPEN))

    return _deal(rows.mapInArrow(pack, _PACKED)).mapInArrow(meet, _FOUND)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries, and where names and covers begin."""
    x = x[np.lexsort((x["key"], x["flag"] & 1, x["c1"], x["c0"], x["name"]))]
    name = np.append(True, x["name"][1:] != x["name"][:-1])
    cover = name | np.append(True, (x["c0"][1:] != x["c0"][:-1]) | (x["c1"][1:] != x["c1"][:-1]))
    return x, name, cover


def _rank_again(entries: DataFrame, bits: int) -> DataFrame:
    """What becomes of the cells: gone, open or witness. Flag 1: no verdict wanted; 2: its cover is known to repeat."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            x, _, cover = _groups(np.concatenate(held))
            begin = np.flatnonzero(cover)
            times = np.diff(np.append(begin, len(x)))
            many = np.repeat(times > 1, times)
            gone, out = x[many & (x["flag"] & 1 == 0)], []
            for a in range(0, len(gone), 8192):
                out.append((turn % (1 << bits), 1, gone[a : a + 8192].tobytes()))
                turn += 1
            one = x[cover].copy()
            one["flag"][times > 1] = 3
            yield from _packed(out + _by_bucket(one, bits))

        for batch in batches:
            for rows in batch.column(0).to_pylist():
                held.append(np.frombuffer(rows, _CELL))
                count += len(held[-1])
            if count >= HOLD:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for settled, x in _buckets_of(batches, _CELL):
            if settled:
                yield from _found(x, np.full(len(x), GONE))
                continue
            x, name, cover = _groups(x)
            begin = np.flatnonzero(cover)
            times = np.diff(np.append(begin, len(x)))
            known = np.maximum.reduceat(x["flag"], begin) & 2
            repeated = np.repeat((times > 1) | (known > 0), times)
            wanted = x["flag"] & 1 == 0
            group = np.cumsum(name) - 1
            members = np.bincount(group)
            need = np.bincount(group, wanted & ~repeated) > 0
            open_group = (need & (members > 1))[group]
            kind = np.full(len(x), -1)
            kind[repeated & wanted] = GONE
            kind[~repeated & wanted & open_group] = OPEN
            yield from _found(x[kind >= 0], kind[kind >= 0])
            witness = open_group & cover & (repeated | ~wanted)
            yield from _found(x[witness], np.full(int(witness.sum()), WITNESS))

    return _deal(entries.mapInArrow(pack, _PACKED)).mapInArrow(meet, _FOUND)


def _entries(texts: DataFrame, found: DataFrame, length: int, size: int) -> DataFrame:
    """The cells of every text's open and witness ranges, packed; a text's ranges come together in its own row."""
    ranges = found.where(F.col("kind") != GONE).groupBy("key").agg(F.collect_list(F.struct("at", "lo", "hi", (F.col("kind") == WITNESS).cast("int").alias("flag"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, _ = utf8(batch.column(1).slice(i, 1))
                f = batch.column(2)[i].values.flatten()
                x = np.unique(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in f], axis=1), axis=0)
                seen = np.zeros(len(x), [("at", "i8"), ("lo", "i8"), ("hi", "i8"), ("flag", "i8")])
                for k, c in enumerate(seen.dtype.names):
                    seen[c] = x[:, k]
                step = max(1, HOLD // 16)
                for a in range(0, len(seen), step):
                    rows = cells(text, batch.column(0)[i].as_py(), seen[a : a + step], length, size)
                    yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["rows"])

    return texts.select("key", "text").join(ranges, "key").select("key", "text", "found").mapInArrow(run, "rows binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int | None = None, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row of ``docs``.

    Each byte goes that lies in a string of ``length`` bytes that also starts
    anywhere else, in the same text or another; strings are judged on the
    input. ``length`` is 32 to 256 (longer strings could be built that the
    fingerprints confuse); another raises ValueError. Null counts as the empty text; texts
    shorter than ``length`` stay whole. Repeated rows are texts of their own,
    so all their strings repeat. Ids may be null or repeated: rows are told
    apart by id and text. Other columns are ignored. Empty input: no rows.
    """
    if not 32 <= length <= 256:
        raise ValueError("length is 32 to 256")
    spark = docs.sparkSession
    gram = gram or max(8, length * GRAM // 200)
    reach = length - gram + 1
    bits = max(6, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("id", "text"))
    long = rows.where(F.octet_length("text") >= length).select("key", "text")

    found, found_at = cut(_repeated_anchors(long, length, gram, bits), "anchors")
    texts, texts_at = cut(long.join(found.select("key").distinct(), "key", "left_semi"), "texts")
    gone = []
    for size in (reach, CELL, 1):
        if size >= reach and size != reach:
            continue
        now, now_at = cut(_rank_again(_entries(texts, found, length, size), bits), "cells")
        gone.append(now.where(F.col("kind") == GONE).select("key", (F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + length).alias("z")))
        found = now
    forget(spark, found_at)
    spans = gone[0]
    for g in gone[1:]:
        spans = spans.unionByName(g)
    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("a", "z")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                data, _ = utf8(batch.column(1).slice(i, 1))
                a, z = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.column(2)[i].values.flatten())
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, a, 1)
                np.add.at(depth, z, -1)
                off = np.cumsum(depth[:-1]) > 0
                kept = data[~off].tobytes()
                starts = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                out.append((batch.column(0)[i].as_py(), int(off.sum()), starts, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["key", "n_removed", "n_spans", "sha", "kept"])

    changed, _ = cut(texts.dropDuplicates(["key"]).join(per_text, "key").select("key", "text", "spans").mapInArrow(run, "key long, n_removed long, n_spans long, sha string, kept binary"), "changed")
    forget(spark, texts_at)
    zero = F.lit(0).cast("long")
    own = rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), *([F.col("text").cast("binary").alias("bytes")] if with_text else []))
    out = own.join(changed, "key", "left").select(
        "id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), *([F.coalesce("kept", "bytes").alias("kept")] if with_text else [])
    )
    return out
