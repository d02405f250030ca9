"""Byte-level BPE, encoding and decoding.

Each pre-token is a linked list of parts. Every mergeable pair stands in the
bucket of its merge rank; a bitmap of two levels (256 ranks to a word) marks the
buckets in use, so that find-first-set twice yields the lowest rank. A merge
puts at most two new pairs in; pairs that a merge has made stale stay in their buckets
and are skipped when they come up. The cost of a pre-token of n bytes is
O(n log n) whatever its shape, also for one of many megabytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docgrid.llm.common import release

#: Pre-tokens whose ids a worker remembers, and the longest that it does.
CACHE_SIZE, CACHE_LONGEST = 400_000, 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: always the lowest rank's leftmost pair first."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n))  # where the part before it begins
    due = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank of the pair that begins here, -1: none
    due.append(-1)
    buckets: dict[int, list[int]] = {}  # by rank: a heap of places
    low: dict[int, int] = {}  # by the rank's upper bits: which ranks have a bucket
    top = 0  # which of these words aren't empty

    def push(rank: int, i: int) -> None:
        nonlocal top
        bucket = buckets.get(rank)
        if bucket is None:
            buckets[rank] = [i]
            word = rank >> 8
            low[word] = low.get(word, 0) | 1 << (rank & 255)
            top |= 1 << word
        else:
            heappush(bucket, i)

    for i in range(n - 1):
        if due[i] >= 0:
            push(due[i], i)
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top &= top - 1
        if due[i] != rank:
            continue  # stale
        j = after[i]
        end = after[j]
        after[i] = end
        due[j] = -1
        new = -1
        if end < n:
            before[end] = i
            new = get(piece[i : after[end]], -1)
            if new >= 0:
                push(new, i)
        due[i] = new
        k = before[i]
        if k >= 0:
            new = get(piece[k:end], -1)
            if new != due[k]:
                due[k] = new
                if new >= 0:
                    push(new, k)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


@lru_cache(2)
def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


class Codec:
    """Encodes and decodes whole texts; remembers the ids of short pre-tokens, within a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _ids(self, piece: str) -> str:
        out = self.older.get(piece) or " ".join(map(str, merge(piece.encode(), self.ranks)))
        if len(piece) <= CACHE_LONGEST:
            if len(self.known) >= CACHE_SIZE // 2:  # what isn't asked for again falls out
                self.older, self.known = self.known, {}
            self.known[piece] = out
        return out

    def encode(self, text: str) -> str:
        """Ids in decimal, joined by one space."""
        known, ids = self.known.get, self._ids  # a turn of the cache in between only costs look-ups
        return " ".join([known(x) or ids(x) for x in self.split(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(2)
def _codec(lines: bytes, pattern: str) -> Codec:
    return Codec(load_ranks(lines), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of ``docs``.

    ``vocabulary`` is the path of a file of base64 token and rank lines,
    readable by the driver; its lines (under 1 MB) travel to the executors as a
    broadcast. ``ids`` (array<int>) is given with ``keep_ids``. Null and empty
    texts have no ids; null ids and repeated rows pass through; other columns
    are ignored. Empty input: no rows.
    """
    with open(vocabulary, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, sha, back, kept = [], [], [], []
                for value in part.column(1):
                    ids = codec.encode(value.as_py() or "")
                    n.append(ids.count(" ") + 1 if ids else 0)
                    sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    at = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(kept))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return slim.mapInArrow(run, schema)
