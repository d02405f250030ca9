"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) P(word | class). The class of a word is a
hash of its last two bytes, so that classes need no table and unseen words have
one. The first factor is a softmax over classes of summed weights: a bias and
hashed features of the context (the word before, the word before that as a skip
feature, both as a bigram, and their classes). The second is the maximum-entropy
solution for unigram features alone: smoothed counts within the class. Words
never seen in training are one further word of their class, so the
probabilities of all words of all classes add up to one.

Training: the texts are dealt into lots by a hash of id and text, their number
follows the tokens counted. In each round gradient steps run over every lot of
a disjoint share of the texts, in a fixed order, from the same weights; the
weights of a feature are averaged over the lots, each by how often it saw the
feature, in blocks of features that Spark deals out. All training texts are
used. Neither lots nor orders depend on how the input is partitioned, so the
weights don't, nor do they change when a lost task runs again.

Counts cover all words and stay in a table. The ``HEAD`` most frequent words go
to every task (a fixed size); all other words of the texts meet their counts in
a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import arrow_rows, cut, mix, steps, words

#: Classes (0: the end of a text), feature buckets, features of a context.
CLASSES, BUCKETS, FEATURES = 32, 1 << 15, 5
#: Buckets in a block of weights.
BLOCK = 32
#: Disjoint shares of the training texts, one for each round; tokens of a gradient step; its rate.
ROUNDS, BATCH, RATE = 3, 1024, 0.25
#: Tokens in a lot, about.
LOT = 1 << 20
#: Tokens whose features are made at a time; a context doesn't reach across.
STEP = 64 * BATCH
#: Most frequent words whose counts each task holds, 16 bytes each.
HEAD = 500_000
#: Distinct words that a task counts before it hands them on.
HOLD = 1 << 20
ADD = 0.1

END = np.uint64(0x243F6A8885A308D3)
_BEGIN = np.uint64(0x13198A2E03707344)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, n + 1 offsets): the words of each text, A-Z lower-cased, and its end."""
    h, start, end, at = words(data, offsets)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    last = low[end - 1] if len(h) else np.zeros(0, np.uint64)
    before = np.where(end - 2 >= start, low[np.maximum(end - 2, 0)], 0).astype(np.uint64) if len(h) else last
    kind = (1 + mix(before * np.uint64(256) + last) % np.uint64(CLASSES - 1)).astype(np.int64)
    tok = np.full(len(h) + n, END, np.uint64)
    cls = np.zeros(len(h) + n, np.int64)
    where = np.arange(len(h)) + doc
    tok[where], cls[where] = h, kind
    return tok, cls, at + np.arange(n + 1)


def contexts(tok: np.ndarray, cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Buckets of the FEATURES features of every token, a column each; bucket 0 is the bias's."""
    n = len(tok)
    w1, w2 = np.full(n, _BEGIN), np.full(n, _BEGIN)
    k1, k2 = np.full(n, CLASSES, np.int64), np.full(n, CLASSES, np.int64)
    w1[1:], k1[1:] = tok[:-1], cls[:-1]
    w2[2:], k2[2:] = tok[:-2], cls[:-2]
    first = at[:-1]
    w1[first], k1[first], w2[first], k2[first] = _BEGIN, CLASSES, _BEGIN, CLASSES
    second = first[np.diff(at) > 1] + 1
    w2[second], k2[second] = _BEGIN, CLASSES
    out = np.empty((n, FEATURES), np.int32)
    space = np.uint64(BUCKETS - 1)
    bigram = mix(w1 * np.uint64(3) + w2)
    for i, x in enumerate((w1 + np.uint64(1), w2 + np.uint64(2), bigram + np.uint64(3), (k1 * 64 + k2).astype(np.uint64) + np.uint64(4 << 40))):
        out[:, i + 1] = (mix(x * np.uint64(8) + np.uint64(i)) % space + np.uint64(1)).astype(np.int32)
    out[:, 0] = 0
    return out


def class_probabilities(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Softmax over the classes for each row of feature buckets."""
    x = weights[feats[:, 0]]
    for i in range(1, feats.shape[1]):
        x = x + weights[feats[:, i]]
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def descend(weights: np.ndarray, scale: np.ndarray, seen: np.ndarray, feats: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """Gradient steps over the tokens, in place; a rate for each bucket falls with its squared gradients."""
    for a in range(0, len(cls), BATCH):
        f, k = feats[a : a + BATCH], cls[a : a + BATCH]
        g = class_probabilities(weights, f)
        g[np.arange(len(k)), k] -= 1
        flat = f.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        sorted_ = flat[order]
        head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        rows = sorted_[head]
        times = np.diff(np.append(head, len(flat)))
        total = np.add.reduceat(g[order % len(k)], head, axis=0)
        scale[rows] += (total * total).mean(1)
        weights[rows] -= (rate / np.sqrt(scale[rows]))[:, None] * total
        seen[rows] += times


@dataclass(frozen=True)
class Model:
    """weights (BUCKETS, CLASSES); counts of tokens and distinct words of each class; all tokens, all distinct."""

    weights: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    train_tokens: int
    vocabulary: int


def _schema_free(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, k, c): hash, class and count of every distinct token of ``docs``, each text's end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, k, c = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(h, kind="stable")
            h, k, c = h[order], k[order], c[order]
            head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[head], k[head], np.add.reduceat(c, head)

        def give(h, k, c) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(h), 1 << 16):
                z = a + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(h[a:z].view(np.int64)), pa.array(k[a:z].astype(np.int32)), pa.array(c[a:z])], names=["h", "k", "c"])

        for _, data, offsets in steps(batches, most=1 << 20):
            tok, cls, _ = tokens(data, offsets)
            u, first, c = np.unique(tok, return_index=True, return_counts=True)
            held.append((u, cls[first], c))
            size += len(u)
            if size >= 2 * HOLD:
                held = [fold()]
                size = len(held[0][0])
                if size >= HOLD:
                    yield from give(*held[0])
                    held, size = [], 0
        if held:
            yield from give(*fold())

    part = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, k int, c long")
    return part.groupBy("h").agg(F.min("k").alias("k"), F.sum("c").alias("c"))


def _train_round(docs: DataFrame, lots: int, weights: np.ndarray, rate: float) -> np.ndarray:
    """The weights after the gradient steps over each lot of ``docs`` (row, id, text), averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS x CLASSES, a fixed size

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, scale, seen = None, None, None, None

        def give() -> Iterator[pa.RecordBatch]:
            own_ = own * seen[:, None]
            block = np.flatnonzero(seen.reshape(-1, BLOCK).any(1))
            for a in range(0, len(block), 64):
                b = block[a : a + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.astype(np.int32)), pa.array(np.full(len(b), now, np.int64)), pa.array([own_[i * BLOCK : i * BLOCK + BLOCK].tobytes() for i in b], pa.binary()), pa.array([seen[i * BLOCK : i * BLOCK + BLOCK].tobytes() for i in b], pa.binary())],
                    names=["block", "lot", "w", "n"],
                )

        for lot, tok, cls, at in _by_lot(batches):
            if lot != now:
                if now is not None:
                    yield from give()
                now, own, scale, seen = lot, shared.value.copy(), np.ones(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
            descend(own, scale, seen, contexts(tok, cls, at), cls, rate)
        if now is not None:
            yield from give()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, n = None, None, None

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], names=["block", "w", "n"])

        for batch in batches:
            for block, _, x, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != now:
                    if now is not None:
                        yield give()
                    now, w, n = block, np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK)
                w += np.frombuffer(x, np.float32).reshape(BLOCK, CLASSES)
                n += np.frombuffer(m, np.float32)
        if now is not None:
            yield give()

    dealt = docs.withColumn("lot", F.pmod(F.shiftrightunsigned("row", 20), F.lit(lots)).cast("long")).repartition("lot").sortWithinPartitions("lot", "row", "id", "text")
    learnt = dealt.select("lot", "text").mapInArrow(learn, "block int, lot long, w binary, n binary")
    sums = learnt.repartition("block").sortWithinPartitions("block", "lot").mapInArrow(add, "block int, w binary, n binary")
    new = weights.copy()
    with arrow_rows(docs.sparkSession):
        got = sums.toArrow()  # the weights, a fixed size
    for block, w, n in zip(*(got.column(i).to_pylist() for i in range(3))):
        m = np.frombuffer(n, np.float32)
        rows = np.flatnonzero(m > 0)
        new[block * BLOCK + rows] = np.frombuffer(w, np.float32).reshape(BLOCK, CLASSES)[rows] / m[rows, None]
    shared.unpersist()
    return new


def _by_lot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lot, tokens, classes, offsets) of whole gradient steps of a lot's texts, whatever the batches; the last step of a lot is short."""
    now, held, count = None, [], 0

    def close(final: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal held, count
        tok, cls = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        first = np.concatenate([h[2] for h in held])
        z = len(tok) if final else len(tok) // STEP * STEP
        for a in range(0, z, STEP):
            e = min(z, a + STEP)
            yield now, tok[a:e], cls[a:e], np.append(np.flatnonzero(first[a:e]) if first[a] else np.append(0, np.flatnonzero(first[a:e])), e - a)
        held, count = [(tok[z:], cls[z:], first[z:])], len(tok) - z

    for batch in batches:
        lots = batch.column(0).to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, lots[1:] != lots[:-1])), len(lots))
        for a, z in zip(edge[:-1], edge[1:]):
            if lots[a] != now:
                if count:
                    yield from close(True)
                now, held, count = int(lots[a]), [], 0
            for _, data, offsets in steps(iter([batch.slice(a, z - a)]), most=1 << 19):
                tok, cls, at = tokens(data, offsets)
                first = np.zeros(len(tok), bool)
                first[at[:-1]] = True
                held.append((tok, cls, first))
                count += len(tok)
                if count >= 2 * STEP:
                    yield from close(False)
    if count:
        yield from close(True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame, str]:
    """Learn from all rows of ``docs``: the model, and the table (h, k, c) of counts with its place.

    The rounds' shares are dealt by a hash of id and text; the result doesn't
    depend on partitions. Texts of any length are taken whole, in steps. Null
    and empty texts are an end alone. Without rows the weights are zero. Runs
    when called.
    """
    spark = docs.sparkSession
    slim = _schema_free(docs, id_col, text_col)
    counts, place = cut(count_words(slim), "words")
    by_class = counts.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        n[r.k], v[r.k] = r.n, r.v
    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    if n.sum():
        weights[0] = np.log((n + 1.0) / (n.sum() + CLASSES))
        for r in range(ROUNDS):
            share = slim.withColumn("row", F.xxhash64("id", "text")).where(F.pmod("row", F.lit(ROUNDS)) == r)
            weights = _train_round(share, 1 + int(n.sum()) // (ROUNDS * LOT), weights, RATE / (1 + r))
    return Model(weights, n, v, int(n.sum()), int(v.sum())), counts, place


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for every row of ``docs``.

    Scores are sums of log10 probabilities over the words of the text and its
    end: ``base_score`` by smoothed word counts, ``score`` by the model. Null,
    empty and blank texts are an end alone. Repeated rows, null ids and other
    columns do no harm; other columns are ignored. Empty input: no rows.
    """
    spark = docs.sparkSession
    slim = _schema_free(docs, id_col, text_col)
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).select("h", "c").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    head = spark.sparkContext.broadcast((h[order], top.column("c").to_numpy()[order]))  # HEAD entries at most
    shared = spark.sparkContext.broadcast(model)  # a fixed size
    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"key long, id {id_type}, n_tokens long, known long, counted double, classed double, inner double, tail array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (hs, cs) = shared.value, head.value
        logs = np.log10(cs + ADD)
        within = np.log10(m.class_tokens + ADD * (m.class_words + 1))
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 40
        for batch, data, offsets in steps(batches, most=1 << 19):
            tok, cls, at = tokens(data, offsets)
            feats = contexts(tok, cls, at)
            picked = np.empty(len(tok))
            for a in range(0, len(tok), 8192):
                p = class_probabilities(m.weights, feats[a : a + 8192])
                picked[a : a + 8192] = p[np.arange(len(p)), cls[a : a + 8192]]
            pos = np.minimum(np.searchsorted(hs, tok), max(len(hs) - 1, 0))
            hit = hs[pos] == tok if len(hs) else np.zeros(len(tok), bool)
            counted = np.where(hit, logs[pos], 0.0) if len(hs) else np.zeros(len(tok))
            first = at[:-1]
            total = lambda x: pa.array(np.add.reduceat(x, first))  # noqa: E731  every text has its end
            n = len(first)
            missed = np.add.reduceat((~hit).astype(np.int64), first)
            tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(missed)).astype(np.int32)), pa.array(tok[~hit].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key + np.arange(n)), batch.column(0), pa.array(np.diff(at)), total(hit.astype(np.int64)), total(counted), total(np.log10(np.maximum(picked, 1e-30))), total(within[cls]), tail],
                names=["key", "id", "n_tokens", "known", "counted", "classed", "inner", "tail"],
            )
            key += n

    part, _ = cut(slim.mapInArrow(run, schema), "scored")
    rare = part.select("key", F.explode("tail").alias("h")).groupBy("h", "key").agg(F.count(F.lit(1)).alias("t"))
    met = rare.join(counts.select("h", "c"), "h", "left")
    found = met.groupBy("key").agg(F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("t"))).alias("rare"))
    level = float(np.log10(model.train_tokens + ADD * (model.vocabulary + 1)))
    words_part: Column = F.col("counted") + F.coalesce("more", F.lit(0.0))
    return part.drop("tail").join(found, "key", "left").select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare", F.lit(0))).alias("n_known"),
        (words_part - F.col("n_tokens") * F.lit(level)).alias("base_score"),
        (words_part - F.col("inner") + F.col("classed")).alias("score"),
    )
