"""Jaccard self join of word n-gram sets by PartEnum signatures, exact.

Two sets of sizes up to ``hi`` with Jaccard similarity of at least p percent
differ in at most k = floor(2 hi (100 - p) / (100 + p)) features. The feature
domain (64-bit hashes) is cut into more than k / 2 equal ranges, and each range
into three parts. Some range then holds at most one difference, so two of its
three parts are equal: of each range, every subset of two parts gives one
signature, the band of sizes, the range, the subset and the features in it.
Empty subsets give none; a range with features in two parts or more has none
that is empty. A set in which too few ranges are so filled also takes part in
the next scheme, with a new partition and more ranges; no link is lost at any
size. Sets of a band take signatures for their own band, and for the next one
if they are large enough to link with a set in it.

Signatures meet in buckets of the hash space. Equal sets and equal signatures
collapse inside each task first, so a group of any size reaches its bucket as
one entry for each task.

The sets that share a signature form a group. Groups that overlap are put
together first: near copies share many signatures, under many pivots. Links are
sought in rounds:

1. In a group up to ``SMALL`` members, one task holds sketches (features counted
   in bins) against each other, which rules out pairs without loss. Stars that
   cover what may link are tested on whole sets, then all pairs that those links
   haven't joined.
2. A larger group has a centre, any set will do; it is made of the features that
   most of some members have. D(x) is what x and the centre differ in, and
   |x ^ y| = |D(x) ^ D(y)|. With a(x) = (100 + p) |D(x)| - (100 - p) |x|, sets
   with a(x) + a(y) <= 0 are linked; all of these are linked with the one of the
   least a, no test needed. Of all others, linked sets have (a(x) + a(y)) /
   (2 (100 + p)) or more of D(x) and D(y) in common, so both have one of their
   first |D| - that + 1 differences in common, in one order for all of the group
   (those that many members have come last). For the one of a pair with the
   smaller a, of which the other's is no smaller, |D| - a / (100 + p) + 1 will
   do. Sets of unlike components that share a difference, for one of them among
   those, form the groups of the next round.

A difference that a group of the next round shares is one that most of the
sampled members don't have, so groups shrink and the rounds end; no pair that
may link is left out, and no large group is paired out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import Lanes, arrow_rows, cut, forget, mix, salted, steps, words
from docgrid.llm.components import components

#: Growth of the size bands.
BAND = 1.5
#: Signatures that a task holds before it hands them on.
HOLD = 1 << 19
#: Features of all sets for each bucket, about; a task holds the signatures of one bucket, so their number grows with the input.
FEATURES = 1 << 19
#: Members up to which a group is paired out, by sketches, in one task.
SMALL = 2048
#: Members of a large group that are brought together with its centre at a time; sets of more features come alone.
TOGETHER, LONG = 256, 50_000
#: Pairs of one set that are tested together, about.
STAR = 128
#: Bits by which texts and sets are told that a join needs; what shares a bit with one of these is sent too, and left out there.
BITS = 1 << 25
#: Members of a large group, about, from which its centre and the order of differences are taken, and how many of these make a difference frequent; they decide how much work there is, not the result.
SAMPLED, FREQUENT = 48, 3


def _fold(h: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each start."""
    lanes = Lanes(np.full(len(start), k, np.uint64))
    for i in range(k):
        lanes.add(h[start + i])
    return lanes.end()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles.

    Fewer words: the whole sequence is one shingle. No words: the empty set.
    """
    h, _, _, at = words(data, offsets)
    grams = _fold(h, np.arange(max(0, len(h) - k + 1)), k)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(_fold(h, np.array([a]), int(b - a)))
        else:
            out.append(grams[:0])
    return out


def set_hash(features: np.ndarray) -> int:
    """A 64-bit name of a set of sorted features."""
    return int.from_bytes(hashlib.blake2b(features.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(features: np.ndarray) -> bytes:
    """The features counted in bins of their top bits, a byte each; the bins are a power of two near the size, 64 to 65,536."""
    bits = min(16, max(6, len(features).bit_length() - 1))
    return np.minimum(np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Bands:
    """Size bands for a similarity of ``percent``."""

    def __init__(self, percent: int) -> None:
        self.percent, self.edges = percent, [1]

    def _grow(self, n: int) -> None:
        while self.edges[-1] <= n:
            lo = self.edges[-1]
            self.edges.append(max(lo, int(lo * BAND)) + 1)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n features takes signatures."""
        self._grow(2 * n + 2)
        band = int(np.searchsorted(self.edges, n, "right")) - 1
        return [band, band + 1] if 100 * n >= self.percent * self.edges[band + 1] else [band]

    def differ(self, band: int) -> int:
        """Features in which two linked sets of the band differ at most."""
        return 2 * (self.edges[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, their sets' places) of sets given as sorted distinct hashes.

    Bands in which linked sets are equal need none: equal sets have one name.
    """
    todo = []  # (set, band, ranges, filled ranges that suffice)
    for i, s in enumerate(sets):
        for band in bands.of(len(s)) if len(s) else ():
            if k := bands.differ(band):
                todo.append((i, band, k // 2 + 1 + (k + 15) // 32, min(k, len(s) * (100 - bands.percent) // bands.percent) // 2))
    sigs, owners, scheme = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while todo:
        which = np.array([t[0] for t in todo])
        band, ranges, enough = (np.array([t[i] for t in todo], np.uint64) for i in (1, 2, 3))
        size = np.array([len(sets[i]) for i in which])
        f = np.concatenate([sets[i] for i in which])
        row = np.repeat(np.arange(len(todo)), size)
        where = f if not scheme else mix(f + np.uint64(scheme * 0x632BE59BD9B4E019 % 2**64))
        base = np.append(0, np.cumsum(ranges)).astype(np.int64)  # first range of each row
        slot = 3 * base[row] + (((where >> np.uint64(32)) * (np.uint64(3) * ranges[row])) >> np.uint64(32)).astype(np.int64)
        value = mix(f ^ np.uint64(0x2545F4914F6CDD1D))
        if scheme:
            order = np.argsort(slot, kind="stable")
            slot, value = slot[order], value[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        parts, filled = np.zeros(3 * base[-1], np.uint64), np.zeros(3 * base[-1], bool)
        parts[slot[first]], filled[slot[first]] = np.add.reduceat(value, first), True
        parts, filled = parts.reshape(-1, 3), filled.reshape(-1, 3)
        owner = np.repeat(np.arange(len(todo)), ranges.astype(np.int64))
        place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        for omitted in range(3):
            a, b = (omitted + 1) % 3, (omitted + 2) % 3
            some = np.flatnonzero(filled[:, a] | filled[:, b])
            name = mix((band[owner[some]] << np.uint64(48)) + np.uint64(scheme << 40) + place[some] * np.uint64(3) + np.uint64(omitted))
            sigs.append(mix(parts[some, a] + parts[some, b] + name))
            owners.append(which[owner[some]])
        well = np.bincount(owner, filled.sum(1) > 1, len(todo))
        todo = [(t[0], t[1], t[2] + t[2] // 4 + 1, t[3]) for t, w in zip(todo, well) if w <= t[3]]
        scheme += 1
    return np.concatenate(sigs), np.concatenate(owners)


def _slim(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, cid, sketch): the size of each text's set, its name and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            sets = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], names=["id", "n", "cid", "sketch"])

    return docs.mapInArrow(run, "id long, n long, cid long, sketch binary")


#: base is null: pairs (id, pivot) that met in a task, as they are; else the entries of a bucket, their signatures' last 40 bits (all low 32, then all high 8), ids as differences from base if they fit 32 bits.
_PACKED = "bucket int, base long, sigs binary, ids binary"


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[first], b[first]


def _buckets(features: int, partitions: int) -> int:
    """Into how many buckets, a power of two, the hashes of signatures are dealt."""
    return 1 << max(6, (2 * partitions - 1).bit_length(), (features // FEATURES).bit_length())


def _meet(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(id, pivot, across): texts that share a signature with the pivot, which met in one task or across tasks.

    What met in one task also belongs to the pivots that its own pivot met across tasks.
    """
    bits = np.uint64(buckets.bit_length() - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, count, turn = Bands(percent), 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[int, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            sig, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            key = ((sig >> (np.uint64(64) - bits)) << np.uint64(40)) | (sig & np.uint64(0xFFFFFFFFFF))
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            first = np.append(True, key[1:] != key[:-1])
            pivots = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
            more = ~first & (ids != pivots)
            rows = []
            x, p = _distinct_pairs(ids[more], pivots[more])
            for a in range(0, len(x), 4096):
                rows.append((turn % buckets, None, x[a : a + 4096].tobytes(), p[a : a + 4096].tobytes()))
                turn += 1
            key, ids = key[first], ids[first]
            bucket = (key >> np.uint64(40)).astype(np.int64)
            low, high = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint8)
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            for a, z in zip(edge, [*edge[1:], len(key)]):
                own = ids[a:z]
                base = int(own.min())
                apart = int(own.max()) - base
                rows.append((int(bucket[a]), base, low[a:z].tobytes() + high[a:z].tobytes(), (own - base).astype(np.uint32).tobytes() if apart < 2**32 else own.tobytes()))
            for a in range(0, len(rows), 64):
                part = rows[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), *(pa.array([r[i] for r in part], pa.binary()) for i in (2, 3))], names=["bucket", "base", "sigs", "ids"])

        for batch, data, offsets in steps(batches):
            mine, ids = [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(data, offsets, k)):
                if not len(s) or i is None:
                    continue
                name = set_hash(s)
                if name in seen:  # an equal set went before it; the name links them
                    continue
                if len(seen) >= HOLD // 4:
                    seen.clear()
                seen[name] = i
                mine.append(s)
                ids.append(i)
            sigs, owner = signatures(mine, bands)
            held.append((sigs, np.array(ids, np.int64)[owner]))
            count += len(sigs)
            if count >= HOLD:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def give(ids: np.ndarray, pivots: np.ndarray, across: bool) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(ids), 1 << 16):
                z = min(len(ids), a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:z]), pa.array(pivots[a:z]), pa.array(np.full(z - a, across))], names=["id", "pivot", "across"])

        def close() -> Iterator[pa.RecordBatch]:
            sig, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.lexsort((ids, sig))
            sig, ids = sig[order], ids[order]
            first = np.append(True, sig[1:] != sig[:-1])
            pivots = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
            more = ~first & (ids != pivots)
            yield from give(*_distinct_pairs(ids[more], pivots[more]), True)

        for batch in batches:
            for bucket, base, sigs, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if base is None:
                    yield from give(np.frombuffer(sigs, np.int64), np.frombuffer(ids, np.int64), False)
                    continue
                if bucket != now and held:
                    yield from close()
                    held = []
                now = bucket
                n = len(sigs) // 5
                sig = np.frombuffer(sigs, np.uint32, n) | np.frombuffer(sigs, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)
                held.append((sig, base + (np.frombuffer(ids, np.uint32).astype(np.int64) if len(ids) == 4 * n else np.frombuffer(ids, np.int64) - base)))
        if held:
            yield from close()

    packed = docs.mapInArrow(pack, _PACKED)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "id long, pivot long, across boolean")


def _fewer_bins(x: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(x.reshape(bins, -1).sum(1, dtype=np.int32), 255).astype(np.uint8) if len(x) > bins else x


def _possible(groups: DataFrame, percent: int, star: bool) -> DataFrame:
    """(u, v), u < v: pairs of a group's members (g, v, n, root, sketch) of unlike roots that may link.

    ``star``: only those of a forest of stars that covers them, the largest
    star first; there u is the middle of its star. Two sketches of the coarser one's bins differ in total by no
    more than the sets do (bins at 255 count as unknown), so no link is lost.
    """

    def pairs(v: np.ndarray, n: np.ndarray, root: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((v, n))
        v, n, root = v[order], n[order], root[order]
        counts = [np.frombuffer(sketches[i], np.uint8) for i in order]
        meet = np.zeros((len(v), len(v)), bool)
        for i in range(len(v)):
            # sizes ascend: partners come after, up to the largest that may link
            z = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            j = np.arange(i + 1, z)
            j = j[root[j] != root[i]]
            own, width = counts[i].astype(np.int16), len(counts[i])
            for a in range(0, len(j), max(1, (1 << 20) // width)):
                some = j[a : a + max(1, (1 << 20) // width)]
                other = np.stack([_fewer_bins(counts[x], width) for x in some])
                difference = np.abs(other - own)
                if own.max() >= 255 or other.max() >= 255:
                    difference[(other >= 255) | (own >= 255)] = 0
                meet[i, some] = difference.sum(1, dtype=np.int64) * (100 + percent) <= (n[i] + n[some]) * (100 - percent)
        if star:
            both, bare, meet = meet | meet.T, np.ones(len(v), bool), np.zeros_like(meet)
            reach = both.sum(1)
            while True:
                i = int((reach * bare).argmax())
                if not reach[i] or not bare[i]:
                    break
                meet[i] = both[i] & bare
                gone = meet[i].copy()
                gone[i] = True
                bare &= ~gone
                reach -= both[:, gone].sum(1)
        i, j = np.nonzero(meet)
        if star:
            return v[i], v[j]
        return np.minimum(v[i], v[j]), np.maximum(v[i], v[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            v, n, root = (np.array([h[i] for h in held], np.int64) for i in range(3))
            a, b = pairs(v, n, root, [h[3] for h in held])
            for i in range(0, len(a), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 15)]), pa.array(b[i : i + (1 << 15)])], names=["u", "v"])

        for batch in batches:
            for g, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if g != now and held:
                    yield from close()
                    held = []
                now = g
                held.append(row)
        if held:
            yield from close()

    rows = groups.select("g", "v", "n", "root", "sketch")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long").distinct()


def _rest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What b has and a hasn't, both sorted."""
    if not len(a):
        return b
    return b[a[np.minimum(np.searchsorted(a, b), len(a) - 1)] != b]


def _likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be one of ``keys``: all of those, and few others, told by a bitmap of 4 MB at most that every task holds."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    held = rows.withColumns({"__bucket": F.bitmap_bucket_number(place), "__at": F.bitmap_bit_position(place)}).join(F.broadcast(bits), "__bucket")
    return held.where("getbit(cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) = 1").select(*rows.columns)


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, nu, nv, shared) of distinct pairs: sizes and the number of common features.

    Pairs of one u come together in parts of some ``STAR`` pairs, and each part gets a set once.
    """
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    asks = salted(pairs, many, "u", "v").select(F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("part"), "u", "v")
    need = asks.select("part", F.explode(F.array("u", "v")).alias("cid")).distinct()
    none = F.lit(None)
    rows = need.join(_likely(sets, need, "cid"), "cid").select("part", F.lit(0).alias("kind"), F.col("cid").alias("u"), none.cast("long").alias("v"), "features")
    rows = rows.unionByName(asks.select("part", F.lit(1).alias("kind"), "u", "v", none.cast("binary").alias("features")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        for batch in batches:
            out = []
            for part, kind, u, v, features in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part != now:
                    now, have = part, {}
                if kind == 0:
                    have[u] = np.frombuffer(features, np.uint64)
                else:
                    x, y = have[u], have[v]
                    out.append((u, v, len(x), len(y), len(y) - len(_rest(x, y))))
            if out:
                columns = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["u", "v", "nu", "nv", "shared"])

    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, "u long, v long, nu long, nv long, shared long")


def _centres(some: DataFrame) -> DataFrame:
    """(g, centre, often) of sampled members (g, features): the features that most have, and those in which many differ from it, by how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            f, times = np.unique(np.concatenate(held), return_counts=True)
            most = 2 * times > len(held)
            differ = np.where(most, len(held) - times, times)
            often = f[differ >= FREQUENT][np.argsort(differ[differ >= FREQUENT], kind="stable")]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (f[most], often))], names=["g", "centre", "often"])

        for batch in batches:
            for g, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != now and held:
                    yield close()
                    held = []
                now = g
                held.append(np.frombuffer(features, np.uint64))
        if held:
            yield close()

    return some.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, centre binary, often binary")


def _differences(members: DataFrame, centres: DataFrame, firsts: bool) -> DataFrame:
    """Of members (part, g, v, n, root, first, short, features), by their group's centre: (g, v, d), in how many features they differ from it;
    or (g, v, n, root, f, early), the ``first`` differences, frequent ones last, and whether each is among the first ``short``."""
    none = F.lit(None)
    rows = members.select("part", F.lit(1).alias("kind"), "g", "v", "n", "root", "first", "short", "features", none.cast("binary").alias("often"))
    parts = members.select("part", "g").distinct()
    led = salted(parts, centres, "g", "part").select("part", F.lit(0).alias("kind"), "g", *(none.cast("long").alias(c) for c in ("v", "n", "root", "first", "short")), F.col("centre").alias("features"), "often")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = late = rank = np.zeros(0, np.uint64)
        for batch in batches:
            held, size = [], 0
            for _, kind, g, v, n, root, first, short, features, often in zip(*(batch.column(i).to_pylist() for i in range(10))):
                f = np.frombuffer(features, np.uint64)
                if kind == 0:
                    centre, often = f, np.frombuffer(often, np.uint64)
                    rank = np.argsort(often)
                    late = often[rank]
                    continue
                d = np.sort(np.concatenate([_rest(centre, f), _rest(f, centre)]))
                if firsts:
                    if len(late):
                        at = np.minimum(np.searchsorted(late, d), len(late) - 1)
                        hit = late[at] == d
                        d = np.concatenate([d[~hit], d[hit][np.argsort(rank[at[hit]])]])
                    d = d[:first]
                held.append((g, v, n, root, short, d))
                size += len(d)
                if size >= 1 << 16:
                    yield give(held)
                    held, size = [], 0
            if held:
                yield give(held)

    def give(held: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(h[5]) for h in held], np.int64)
        if not firsts:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.int64()) for i in (0, 1)] + [pa.array(size)], names=["g", "v", "d"])
        columns = [np.repeat(np.array([h[i] for h in held], np.int64), size) for i in range(5)]
        early = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) < columns[4]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:4]), pa.array(np.concatenate([h[5] for h in held]).view(np.int64)), pa.array(early)], names=["g", "v", "n", "root", "f", "early"])

    ready = rows.unionByName(led).repartition("part").sortWithinPartitions("part", "kind")
    return ready.mapInArrow(run, "g long, v long, n long, root long, f long, early boolean" if firsts else "g long, v long, d long")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(cid, features) of the texts of ``rows`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches):
            sets = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "features"])

    return rows.select("id", "text").mapInArrow(run, "cid long, features binary")


def _merged(groups: DataFrame) -> DataFrame:
    """Groups (g, id), each with its pivot g as a member, those that overlap put together.

    A group is held against one other, the largest that its pivot is in, and
    goes into it if pairing the members that this lacks with all of its own
    takes no more pairs than the group itself, unless that one goes too. All
    pairs of a group stay pairs of one group, so no link is lost.
    """
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    above = groups.where("g != id").select(F.col("g").alias("h"), F.col("id").alias("g")).join(sizes, "g")
    above = salted(above, sizes.select(F.col("g").alias("h"), F.col("size").alias("over")), "h", "g").where("over > size or (over = size and h < g)")
    best = above.groupBy("g", "size").agg(F.max(F.struct("over", -F.col("h"), "h")).alias("x")).select("g", "size", "x.over", "x.h")
    both = salted(groups, best, "g", "id").join(groups.select(F.col("g").alias("h"), "id"), ["h", "id"])
    inside = both.groupBy("g", "h", "over", "size").agg(F.count(F.lit(1)).alias("inside"))
    moves = inside.where("(size - inside) * over <= size * size").select("g", "h")
    moves = moves.join(moves.select(F.col("g").alias("h")), "h", "left_anti")
    return salted(groups, moves, "g", "id", "left").select(F.coalesce("h", "g").alias("g"), "id").distinct()


def _groups(found: DataFrame) -> DataFrame:
    """(g, id) of what ``_meet`` found: two texts that share a signature are in one group.

    What met in a task goes wherever its pivot met others, that pivot's own
    group included; groups of these pivots are merged before that.
    """
    across = found.where("across").select(F.col("pivot").alias("g"), "id")
    near, near_at = cut(across.unionByName(across.select("g", F.col("g").alias("id"))).distinct(), "near")
    merged, _ = cut(_merged(near), "merged")
    forget(found.sparkSession, near_at)
    own = found.where("not across").select(F.col("pivot").alias("way"), "id")
    ways = merged.select("g", F.col("id").alias("way"))
    by_way = own.join(ways, "way", "left").select(F.coalesce("g", "way").alias("g"), "id")
    lone = own.select("way").distinct().join(ways, "way", "left_anti").select(F.col("way").alias("g"), F.col("way").alias("id"))
    return merged.unionByName(by_way).unionByName(lone).distinct()


def _relabel(label: DataFrame, label_at: str, links: DataFrame) -> tuple[DataFrame, str]:
    """``label`` (cid, root) with the components that the links (u, v) join."""
    spark = label.sparkSession
    named = links.join(label.select(F.col("cid").alias("u"), F.col("root").alias("ru")), "u").join(label.select(F.col("cid").alias("v"), F.col("root").alias("rv")), "v")
    joined, joined_at = cut(named.where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
    if not joined.isEmpty():
        reached, reached_at = components(joined)
        new, new_at = cut(salted(label, reached.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "cid", "left").select("cid", F.coalesce("top", "root").alias("root")), "label")
        for place in (reached_at, label_at):
            forget(spark, place)
        label, label_at = new, new_at
    forget(spark, joined_at)
    return label, label_at


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of ``docs``.

    Texts link when the Jaccard similarity of their sets of distinct k-word
    shingles (A-Z lower-cased, words split at white space) is ``percent`` or
    more; ``component_id`` is the smallest id that links reach. Texts with
    fewer than k words are one shingle; null, empty and blank texts have none
    and link with nothing. Texts of any length are taken whole; a set and its
    sketch are held whole by one task. Ids are integers; rows of one id are one
    node; a row with a null id links with nothing and has a null
    ``component_id``. Other columns are ignored. Empty input: no rows. The
    links are sought when the function is called, not when its result is read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim, _ = cut(_slim(rows, k), "sets")
    buckets = _buckets(slim.agg(F.sum("n")).first()[0] or 0, partitions)
    with arrow_rows(spark, 64):  # a row holds a bucket's signatures of a whole task
        found, found_at = cut(_meet(rows, k, percent, buckets).distinct(), "met")

    named = slim.where("n > 0 and id is not null")
    of = named.select("id", F.col("cid").alias("v")).distinct()
    met = found.join(of, "id").join(of.select(F.col("id").alias("pivot"), F.col("v").alias("p")), "pivot").where("v != p")
    met, met_at = cut(met.select(F.col("v").alias("id"), F.col("p").alias("pivot"), "across").distinct(), "pairs")
    members, members_at = cut(_groups(met), "members")
    for place in (found_at, met_at):
        forget(spark, place)
    counted = named.select(F.col("cid").alias("v"), "n").distinct()
    groups, groups_at = cut(_merged(members).withColumnRenamed("id", "v").join(counted, "v").select("g", "v", "n"), "groups")
    forget(spark, members_at)
    classes = named.groupBy("cid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    met = groups.select(F.col("v").alias("cid")).distinct()
    sketches, sketches_at = cut(classes.join(met, "cid", "left_semi"), "sketches")
    sets, sets_at = cut(_sets(_likely(rows, sketches, "id").join(sketches.select("id"), "id", "left_semi"), k), "features")
    label, label_at = cut(sketches.select("cid", F.col("cid").alias("root")), "label")

    def linked(pairs: DataFrame) -> tuple[DataFrame, str]:
        """Those pairs that link, by whole sets."""
        asked, asked_at = cut(pairs, "possible")
        tested = _shared(asked, sets).where(100 * F.col("shared") >= percent * (F.col("nu") + F.col("nv") - F.col("shared")))
        out = cut(tested.select("u", "v"), "tested")
        forget(spark, asked_at)
        return out

    def with_root(g: DataFrame) -> DataFrame:
        return g.join(label.withColumnRenamed("cid", "v"), "v")

    def with_sketch(g: DataFrame) -> DataFrame:
        return g.join(sketches.select(F.col("cid").alias("v"), "sketch"), "v")

    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized, sized_at = cut(salted(groups, sizes, "g", "v"), "sized")
    forget(spark, groups_at)
    small = sized.where(F.col("size") <= SMALL).drop("size")
    large, large_at = cut(sized.where(F.col("size") > SMALL), "large")
    # small groups: stars first, then pairs that aren't joined yet
    links, links_at = linked(_possible(with_sketch(small).withColumn("root", F.col("v")), percent, True))
    label, label_at = _relabel(label, label_at, links)
    forget(spark, links_at)
    rooted, rooted_at = cut(with_root(small), "rooted")
    mixed = rooted.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("g")
    forget(spark, sized_at)
    small, small_at = rooted.join(mixed, "g", "left_semi"), rooted_at
    each = sets.withColumnRenamed("cid", "v")
    none = F.lit(None).cast("long")
    while True:
        links, links_at = linked(_possible(with_sketch(small), percent, False))
        label, label_at = _relabel(label, label_at, links)
        for place in (links_at, small_at):
            forget(spark, place)
        if large.isEmpty():
            forget(spark, large_at)
            break
        # large groups: those near the centre are linked
        centres, centres_at = cut(_centres(large.where(F.pmod(F.xxhash64("g", "v"), F.col("size")) < SAMPLED).join(each, "v").select("g", "features")), "centres")
        spread = F.pmod(F.xxhash64("v"), F.when(F.col("n") > LONG, F.lit(2**31)).otherwise(F.ceil(F.col("size") / TOGETHER)))
        large = large.select("g", "v", "n", "size", F.xxhash64("g", spread).alias("part"))
        d = _differences(large.withColumns({"root": none, "first": none, "short": none}).join(each, "v"), centres, False)
        far, far_at = cut(d.join(large, ["g", "v"]).withColumn("a", (100 + percent) * F.col("d") - (100 - percent) * F.col("n")), "far")
        least, least_at = cut(far.groupBy("g").agg(F.min(F.struct("a", "v")).alias("x")).select("g", F.col("x.a").alias("least"), F.col("x.v").alias("u")), "least")
        label, label_at = _relabel(label, label_at, salted(far, least, "g", "v").where("a + least <= 0 and u != v").select("u", "v"))
        # the first differences of those that unlike components may share
        tops = least.join(label.select(F.col("cid").alias("u"), F.col("root").alias("top")), "u").select("g", "least", "top")
        known, known_at = cut(salted(with_root(far), tops, "g", "v"), "known")
        needed = known.where("root != top").groupBy("g").agg(F.min("a").alias("needed"))
        partner = F.when(F.col("root") == F.col("top"), F.col("needed")).otherwise(F.col("least"))

        def length(other: Column) -> Column:
            """Differences that are enough where the partner's a is ``other`` or more."""
            common = F.ceil((F.col("a") + other) / (2 * (100 + percent)))
            return (F.col("d") - F.greatest(F.lit(1), common) + 1).cast("long")

        asks = salted(known, needed, "g", "v").withColumns({"first": length(partner), "short": length(F.greatest(partner, F.col("a")))}).where("first > 0")
        asks, asks_at = cut(asks.select("part", "g", "v", "n", "root", "first", "short"), "asks")
        seats = _differences(asks.join(each, "v"), centres, True).select(F.xxhash64("g", "f").alias("g"), "v", "n", "root", "early")
        seats, seats_at = cut(seats, "seats")
        unlike = seats.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.bool_or("early").alias("early"), F.count(F.lit(1)).alias("size"))
        unlike, unlike_at = cut(unlike.where("x != y and early").select("g", "size"), "unlike")
        small, small_at = cut(seats.select("g", "v", "n", "root").join(unlike.where(F.col("size") <= SMALL), "g", "left_semi"), "small")
        new, new_at = cut(salted(seats.select("g", "v", "n"), unlike.where(F.col("size") > SMALL), "g", "v"), "large")
        for place in (large_at, centres_at, far_at, least_at, known_at, asks_at, seats_at, unlike_at):
            forget(spark, place)
        large, large_at = new, new_at
    for place in (sets_at, sketches_at):
        forget(spark, place)

    # the smallest id of each component; rows of one id are one node
    ids, ids_at = cut(salted(named.select("id", "cid"), label, "cid", "id", "left").select("id", F.coalesce("root", "cid").alias("root")).distinct(), "ids")
    forget(spark, label_at)
    split = ids.groupBy("id").agg(F.min("root").alias("u"), F.max("root").alias("w")).where("u != w").select("id", "u")
    edges, edges_at = cut(ids.join(split, "id").select("u", F.col("root").alias("v")).distinct(), "edges")
    if not edges.isEmpty():
        reached, reached_at = components(edges)
        joined, joined_at = cut(salted(ids, reached.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "id", "left").select("id", F.coalesce("top", "root").alias("root")).distinct(), "ids")
        for place in (reached_at, ids_at):
            forget(spark, place)
        ids, ids_at = joined, joined_at
    forget(spark, edges_at)
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    reached, _ = cut(salted(ids, least, "root", "id").select("id", "component_id"), "reached")
    forget(spark, ids_at)
    out = slim.select("id", F.col("n").alias("n_shingles")).join(reached, "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
