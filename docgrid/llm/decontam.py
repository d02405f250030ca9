"""Benchmark decontamination within an edit distance, without loss.

A document is contaminated by an item when some stretch of it is within an
edit distance of ``percent`` of the item's length (in bytes, A-Z lower-cased,
white space squeezed).

An item of L bytes that may have d edits is cut into d + 1 pieces of
L // (d + 1) bytes or more; a stretch within d edits holds one of them whole
and not more than d bytes from its place. Every place of every text is looked
up among the pieces of all items, and the ranges that a stretch around a hit
can take are searched. A range that holds a stretch has at least L - 5 - 6 d
places whose runs of 6 bytes occur in the item (the q-gram lemma); other ranges
are left out, and the exact edit distance decides on the rest. Neither step
loses a stretch, however the edits lie. Items below 10 bytes have no edits.

CGK walks and bit-sampling LSH, used before, could only discard ranges, and
discarded some that hold a stretch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import _LOWER, IS_SPACE, Lanes, mix, prefix_hash, steps, sub_hash, utf8

#: Edits allowed, in percent of an item's bytes.
PERCENT = 10
#: Bytes of a piece that are looked up first (shorter pieces whole), and of the runs that the lemma counts.
SEED, GRAM = 7, 6
#: Places whose runs are counted at once.
PLACES = 1 << 20
#: Pieces found that one numpy step looks at; ranges from which many are searched at once, and at most so many.
HITS, FEW, TOGETHER = 1 << 20, 48, 1 << 13
#: Items of one pass over the documents; more items are taken in blocks of about so many.
BLOCK = 5000


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, places in the input): A-Z lower-cased, each run of white space one space, none at a text's ends."""
    low = _LOWER[data]
    space = IS_SPACE[low]
    low = np.where(space, np.uint8(32), low)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.ones(len(data), bool)  # another space, or the text's beginning, stands before
    after[1:] = space[:-1]
    keep = ~(space & (after | edge[:-1]))
    last = np.zeros(len(data), bool)  # a space at the end
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    tail = ends[space[ends]]
    last[tail] = True
    for e in tail:  # the space that was kept of a run at the end
        while e > 0 and not keep[e] and space[e] and not edge[e]:
            e -= 1
        if space[e]:
            keep[e] = False
    at = np.flatnonzero(keep)
    return low[at], np.searchsorted(at, offsets), at


def edit_search(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` nearest to ``item``, its first end; (most + 1, -1) if none is within ``most``.

    One step of bit operations for each byte of the text.
    """
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, most + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(across | up))
        fall = up & across
        if rise & high:
            score += 1
        elif fall & high:
            score -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        eq |= down
        up = fall | (full & ~(eq | rise))
        down = rise & eq
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Of one block of items: their pieces by the length that is looked up, and the lemma's runs."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int) -> None:
        self.ids, self.text = [i for i, _ in items], [t for _, t in items]
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.most = self.length * percent // 100
        data = np.frombuffer(b"".join(self.text), np.uint8)
        begin = np.cumsum(self.length) - self.length
        prefix = prefix_hash(data)

        item = np.repeat(np.arange(len(items)), self.most + 1)
        part = np.arange(len(item)) - np.repeat(np.cumsum(self.most + 1) - self.most - 1, self.most + 1)
        off = part * self.length[item] // (self.most[item] + 1)
        size = (part + 1) * self.length[item] // (self.most[item] + 1) - off
        start = begin[item] + off
        #: (bytes looked up, bits of their hashes, hashes in order, item, offset, size, hash of the whole piece)
        self.seeds = []
        looked = np.minimum(size, SEED)
        for q in np.unique(looked).tolist():
            m = np.flatnonzero(looked == q)
            h = sub_hash(prefix, start[m], start[m] + q)
            m, h = m[np.argsort(h, kind="stable")], np.sort(h)
            maybe = np.zeros(1 << 22, bool)
            maybe[h >> np.uint64(42)] = True
            self.seeds.append((q, maybe, h, item[m], off[m], size[m], sub_hash(prefix, start[m], start[m] + size[m])))
        n = np.maximum(self.length - GRAM + 1, 0)
        item = np.repeat(np.arange(len(items)), n)
        start = begin[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        self.gram = np.zeros(1 << 23, bool)
        self.gram[mix(sub_hash(prefix, start, start + GRAM) + item.astype(np.uint64)) >> np.uint64(41)] = True

    def _hits(self, prefix: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, where the item would begin) of every piece in the texts."""
        for q, maybe, seed, items, offs, sizes, whole in self.seeds:
            start = np.arange(max(len(prefix) - max(q, 1), 0))
            h = sub_hash(prefix, start, start + q)
            at = np.flatnonzero(maybe[h >> np.uint64(42)])
            a, z = np.searchsorted(seed, h[at], "left"), np.searchsorted(seed, h[at], "right")
            at, a, upto = at[z > a], a[z > a], np.cumsum((z - a)[z > a])
            done = 0
            while done < len(at):  # a piece that many items share comes up for all of them, wherever it stands
                to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + HITS, "right")))
                times = np.diff(upto[done:to], prepend=upto[done - 1] if done else 0)
                place, hit = np.repeat(at[done:to], times), np.repeat(a[done:to] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                doc = np.searchsorted(offsets, place, "right") - 1
                fine = place + sizes[hit] <= offsets[doc + 1]
                place, hit, doc = place[fine], hit[fine], doc[fine]
                fine = sub_hash(prefix, place, place + sizes[hit]) == whole[hit]
                place, hit, doc = place[fine], hit[fine], doc[fine]
                yield doc, items[hit], place - offs[hit]
                done = to

    def ranges(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, start, end) of the ranges that pieces give and the lemma leaves, for about ``HITS`` pieces at a time.

        Of ranges of one text with the same bytes, an item gets the first.
        """
        prefix, second = prefix_hash(data), prefix_hash(data, 1)
        held, n = [], 0
        for hits in self._hits(prefix, offsets):
            held.append(hits)
            n += len(hits[0])
            if n >= HITS:
                yield self._narrow(data, offsets, prefix, second, *map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield self._narrow(data, offsets, prefix, second, *map(np.concatenate, zip(*held)))

    def _narrow(self, data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, second: np.ndarray, doc: np.ndarray, item: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not len(doc):
            return doc, item, first, first
        first = np.maximum(first, offsets[doc])
        order = np.lexsort((first, item, doc))
        doc, item, first = doc[order], item[order], first[order]
        cell = (first - offsets[doc]) // (self.length[item] + 1)  # hits near each other are one range, of bounded length
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1]) | (first[1:] - first[:-1] > self.most[item[1:]] + 1))
        head = np.flatnonzero(new)
        last = first[np.append(head[1:], len(doc)) - 1]
        doc, item, first = doc[head], item[head], first[head]
        low = np.maximum(first - self.most[item], offsets[doc])
        high = np.minimum(last + self.length[item] + self.most[item], offsets[doc + 1])
        places = np.arange(max(len(data) - GRAM + 1, 0))
        run = sub_hash(prefix, places, places + GRAM)
        n = np.maximum(high - low - GRAM + 1, 0)
        need = self.length[item] + 1 - GRAM * (self.most[item] + 1)
        keep = n >= need
        doc, item, low, high, n, need = doc[keep], item[keep], low[keep], high[keep], n[keep], need[keep]
        names = Lanes(doc.astype(np.uint64))
        for part in (item.astype(np.uint64), (high - low).astype(np.uint64), sub_hash(prefix, low, high), sub_hash(second, low, high, 1)):
            names.add(part)
        keep = np.sort(np.unique(names.end(), return_index=True)[1])
        doc, item, low, high, n, need = doc[keep], item[keep], low[keep], high[keep], n[keep], need[keep]
        keep = np.zeros(len(doc), bool)
        upto = np.cumsum(n)
        a = 0
        while a < len(doc):
            z = max(a + 1, int(np.searchsorted(upto, upto[a] - n[a] + PLACES, "right")))
            m = slice(a, z)
            row = np.repeat(np.arange(len(n[m])), n[m])
            place = low[m][row] + np.arange(len(row)) - np.repeat(np.cumsum(n[m]) - n[m], n[m])
            g = self.gram[mix(run[place] + item[m][row].astype(np.uint64)) >> np.uint64(41)]
            keep[m] = np.bincount(row, g, len(n[m])) >= need[m]
            a = z
        return doc[keep], item[keep], low[keep], high[keep]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        """By text and item: (distance, start, end) of the nearest stretch, the first of equals."""
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        for docs, items, lows, highs in self.ranges(data, offsets):
            for part in range(0, len(docs), TOGETHER):
                m = slice(part, part + TOGETHER)
                doc, item, low, high = docs[m], items[m], lows[m], highs[m]
                if len(doc) >= FEW:
                    near = self._within(data, item, low, high)
                    doc, item, low, high = doc[near], item[near], low[near], high[near]
                for w, i, lo, hi in zip(*(x.tolist() for x in (doc, item, low, high))):
                    piece = data[lo:hi].tobytes()
                    distance, end = edit_search(self.text[i], piece, int(self.most[i]))
                    if end < 0:
                        continue
                    _, size = edit_search(self.text[i][::-1], piece[:end][::-1], distance)
                    span = (distance, lo + end - size, lo + end)
                    old = found.setdefault(w, {}).get(i)
                    if old is None or span < old:
                        found[w][i] = span
        return found

    def _within(self, data: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which ranges hold a stretch within the item's distance: ``edit_search`` for all of them at once, a byte of each a step."""
        out = np.zeros(len(item), bool)
        words = (self.length[item] + 63) // 64
        for size in np.unique(words).tolist():
            which = np.flatnonzero(words == size)
            which = which[np.argsort(-(high - low)[which], kind="stable")]  # the longest first, so that those still going are in front
            own, row = np.unique(item[which], return_inverse=True)
            masks = np.zeros((len(own), 256, size), np.uint64) if len(own) * size <= 1 << 13 else None
            if masks is None:  # the masks of many long items at once would take much memory
                for part in np.array_split(np.arange(len(which)), -(-len(own) * size // (1 << 13)) + 1):
                    if len(part):
                        out[which[part]] = self._within(data, item[which[part]], low[which[part]], high[which[part]]) if len(part) < len(which) else [edit_search(self.text[i], data[a:z].tobytes(), int(self.most[i]))[1] >= 0 for i, a, z in zip(item[which], low[which], high[which])]
                continue
            for k, i in enumerate(own.tolist()):
                t = np.frombuffer(self.text[i], np.uint8)
                at = np.arange(len(t))
                np.bitwise_or.at(masks, (k, t, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
            length, most = (high - low)[which], self.most[item[which]]
            last = ((self.length[item[which]] - 1) % 64).astype(np.uint64)
            up, down = np.full((size, len(which)), ~np.uint64(0)), np.zeros((size, len(which)), np.uint64)
            score, best = self.length[item[which]].copy(), self.length[item[which]].copy()
            one, top = np.uint64(1), np.uint64(63)
            ends = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # how many are longer than j
            for j, n in enumerate(ends.tolist()):
                code = data[low[which[:n]] + j]
                carry, in_rise, in_fall = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for w in range(size):
                    eq, u, d = masks[row[:n], code, w], up[w, :n], down[w, :n]
                    a = eq & u
                    total = a + u
                    over = total < u
                    total = total + carry
                    over |= total < carry
                    carry = over.astype(np.uint64)
                    across = (total ^ u) | eq | d
                    rise, fall = d | ~(across | u), u & across
                    if w == size - 1:
                        score[:n] += ((rise >> last[:n]) & one).astype(np.int64) - ((fall >> last[:n]) & one).astype(np.int64)
                    shifted, lowered = (rise << one) | in_rise, (fall << one) | in_fall
                    in_rise, in_fall = rise >> top, fall >> top
                    eq = eq | d
                    up[w, :n], down[w, :n] = lowered | ~(eq | shifted), shifted & eq
                np.minimum(best[:n], score[:n], out=best[:n])
            out[which] = best <= most
        return out


@lru_cache(2)
def _index(packed: bytes, percent: int) -> Index:
    table = pa.ipc.open_stream(packed).read_all()
    return Index(list(zip(table.column(0).to_pylist(), table.column(1).to_pylist())), percent)


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[bytes]:
    """Normalised items in blocks of about ``size`` rows, each small enough for the driver."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    count = math.ceil(rows.count() / size)
    for b in range(count):
        block = rows.where(F.pmod(F.xxhash64("id"), F.lit(count)) == b) if count > 1 else rows
        table = block.toArrow().combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        data, offsets = utf8(table.column("text"))
        low, offsets, _ = normalise(data, offsets)
        texts = [low[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])]
        keep = [i for i, t in enumerate(texts) if t]
        if keep:
            out = pa.table([pa.array([table.column("id")[i].as_py() for i in keep], pa.int64()), pa.array([texts[i] for i in keep], pa.binary())], names=["id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, out.schema) as w:
                w.write_table(out)
            yield sink.getvalue().to_pybytes()


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(row, id, item_id, distance, start, end): every text and item that a stretch of the text is near to.

    ``start`` and ``end`` are bytes of the text's UTF-8, of the nearest
    stretch. ``row`` is a hash of id and text. Null and empty texts hold
    nothing; items that are null, without an id or empty when normalised are
    left out; items of one id count as one, by their
    nearest. Repeated rows give repeated results. Empty tables: no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text")).select("row", "id", "text")
    schema = f"row long, id {slim.schema['id'].dataType.simpleString()}, item_id long, distance int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for packed in _blocks(items, item_id, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(packed)  # bounded by `block` items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value, percent)
            for batch, data, offsets in steps(batches, most=1 << 19):
                low, ends, at = normalise(data, offsets)
                rows = []
                for w, hits in index.search(low, ends).items():
                    best: dict[int, tuple[int, int, int]] = {}
                    for i, span in hits.items():
                        best[index.ids[i]] = min(span, best.get(index.ids[i], span))
                    for i, (distance, a, z) in sorted(best.items()):
                        rows.append((w, i, distance, int(at[a] - offsets[w]), int(at[z - 1] + 1 - offsets[w])))
                of = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64())))],
                    names=["row", "id", "item_id", "distance", "start", "end"],
                )

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(row, id, item_ids, distances, spans), a row for each distinct contaminated (id, text); lists by item id."""
    found = find_leaks(docs, items, id_col, text_col, **options).distinct()
    hits = found.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("item_id", "distance", "start", "end"))).alias("h"))
    return hits.select("row", "id", F.col("h.item_id").alias("item_ids"), F.col("h.distance").alias("distances"), F.transform("h", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns; null and empty texts stay."""
    bad = find_leaks(docs, items, id_col, text_col, **options).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", F.xxhash64(id_col, text_col)).join(bad, "__row", "left_anti").select(*docs.columns)
