"""Document quality by Bradley-Terry pairwise ranking.

Preference pairs (a good and a poor document) train a linear score by
logistic loss on the difference of their features, on a bounded sample; the
threshold is a quantile of the scores of all labelled rows, so it doesn't move
with the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import IS_SPACE, cut, forget, steps, string_hash, words

#: Labelled rows of each class that the ranker is fitted on, at most (the lowest hashes of the id).
SAMPLE_PER_CLASS = 8000
#: Preference pairs of a training step, and steps.
PAIRS, STEPS = 4096, 400
#: Buckets of hashed pairs of neighbouring bytes.
HASHED = 64
#: Bytes that are counted at a time; bounds the memory that a very long text takes.
CHUNK = 1 << 17
NAMES = ("length", "letters", "digits", "spaces", "upper", "high", "stops", "marks", "lines", "mean_word", "long_words", "distinct", "most", "repeats", "line_repeats", "ends_mark", "short_words")
N_FEATURES = len(NAMES) + HASHED

_CLASS = np.full(256, 7, np.uint8)  # marks
_CLASS[[*range(65, 91)]] = 4
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[IS_SPACE] = 3
_CLASS[128:] = 5
_CLASS[list(b".,;:!?'\"")] = 6


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the bytes of each class, and the hashed pairs of neighbouring bytes."""
    n = len(offsets) - 1
    kinds, pairs = np.zeros((n, 8), np.int64), np.zeros((n, HASHED), np.int64)
    for a in range(0, len(data), CHUNK):
        z = min(a + CHUNK, len(data))
        low, high = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, z, "left"))
        texts = high - low
        doc = np.repeat(np.arange(texts), np.diff(np.clip(offsets[low : high + 1], a, z)))
        kinds[low:high] += np.bincount(doc * 8 + _CLASS[data[a:z]], minlength=8 * texts).reshape(texts, 8)
        inner = np.ones(z - a, bool)
        ends = offsets[low : high + 1]
        inner[ends[(ends > a) & (ends <= z)] - 1 - a] = False
        at = np.flatnonzero(inner)
        pair = ((data[at + a].astype(np.uint32) * 40503 + data[at + (a + 1)] * np.uint32(60493)) >> np.uint32(5)) % HASHED
        pairs[low:high] += np.bincount(doc[at] * HASHED + pair, minlength=HASHED * texts).reshape(texts, HASHED)
    return kinds, pairs


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``N_FEATURES`` numbers for each text; the empty text has zeros only."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    size = np.diff(offsets)
    kinds, hashed = _byte_counts(data, offsets)
    share = kinds / np.maximum(size, 1)[:, None]
    out[:, 0] = np.log1p(size)
    for column, kind in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)):
        out[:, column] = share[:, kind]
    out[:, len(NAMES) :] = np.sqrt(hashed / np.maximum(size, 1)[:, None])
    h, start, end, at = words(data, offsets)
    count = np.diff(at)
    some = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    length = end - start
    breaks = np.flatnonzero(data == 10)
    out[:, 8] = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n) / some
    out[:, 9] = np.log1p(np.bincount(of, length, n) / some)
    out[:, 10] = np.bincount(of[length > 12], minlength=n) / some
    order = np.lexsort((h, of))
    ho, oo = h[order], of[order]
    first = np.ones(len(ho), bool)
    first[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    out[:, 11] = np.bincount(oo[first], minlength=n) / some
    if len(ho):
        runs = np.flatnonzero(first)
        times = np.diff(np.append(runs, len(ho)))
        most = np.zeros(n)
        np.maximum.at(most, oo[runs], times)
        out[:, 12] = most / some
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        out[:, 13] = np.bincount(of[1:][same], minlength=n) / some
        out[:, 15] = np.bincount(of[_CLASS[data[end - 1]] == 7], minlength=n) / some
        out[:, 16] = np.bincount(of[length == 1], minlength=n) / some
    line_start = np.unique(np.concatenate([offsets[:-1][size > 0], breaks[breaks + 1 < len(data)] + 1]))
    if len(line_start):
        line_end = np.append(line_start[1:], len(data))
        line_hash = string_hash(data, line_start, np.maximum(line_start, line_end - 1))
        owner = np.searchsorted(offsets, line_start, "right") - 1
        order = np.lexsort((line_hash, owner))
        new = np.ones(len(order), bool)
        new[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        lines = np.bincount(owner, minlength=n)
        out[:, 14] = 1 - np.bincount(owner[order][new], minlength=n) / np.maximum(lines, 1)
        out[lines == 0, 14] = 0
    return out


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid((features - mean) / spread . weights - threshold)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranker:
    """Learn from features and labels 0 or 1.

    The threshold is the quantile of the training scores at the share of
    label 0. Without rows of both labels there are no pairs: weights are zero
    and every score is 0.5.
    """
    good, poor = x[y == 1], x[y == 0]
    k = x.shape[1]
    if not len(good) or not len(poor):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    mean, spread = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    spread = np.where(spread > 1e-6, spread, 1.0)
    good, poor = (good - mean) / spread, (poor - mean) / spread
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    for t in range(1, STEPS + 1):
        d = good[rng.integers(len(good), size=PAIRS)] - poor[rng.integers(len(poor), size=PAIRS)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    raw = np.sort(np.concatenate([good @ w, poor @ w]))
    cut = len(poor)
    return Ranker(mean, spread, w, float((raw[cut - 1] + raw[cut]) / 2))


def clean_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label) of all rows that can be learnt from.

    Rows with a null id or label, or another label than 0 and 1, are left
    out; an id labelled both ways gives two rows.
    """
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(id, label): of each class the ``per_class`` clean rows with the lowest hash of the id."""
    clean = clean_labels(labels, id_col, label_col)
    parts = [clean.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def ordered(x: np.ndarray) -> np.ndarray:
    """Finite doubles as longs of the same order; its own inverse on the bits."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(2**63 - 1))


def select_rank(keys: DataFrame, rank: int) -> tuple[int, int]:
    """(value, rows up to it) of the long column ``k`` without nulls at ``rank`` (from 0), by counts of 16 bits at a time."""
    prefix, below = 0, 0
    for shift in (48, 32, 16, 0):
        part = keys if shift == 48 else keys.where(F.shiftright("k", shift + 16) == F.lit(prefix))
        digits = part.groupBy(F.shiftright("k", shift).alias("d")).count().collect()  # 65,536 rows at most
        for d, n in sorted((r["d"], r["count"]) for r in digits):
            if below + n > rank:
                prefix = d
                break
            below += n
    return prefix, below + n


def threshold(docs: DataFrame, labels: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> float:
    """The quantile of the raw scores of all labelled rows at the share of label 0, exact; 0 without rows of both labels.

    Scores meet the labels, so no text is shuffled.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            keys = ordered(ranker.raw(features(data, offsets).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys)], names=["id", "k"])

    scores = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, k long")
    met, place = cut(scores.join(clean_labels(labels, id_col, label_col), "id").select("k", "label"), "labelled")
    n, poor = met.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    out = 0.0
    if 0 < poor < n:
        low, upto = select_rank(met, poor - 1)
        high = low if upto > poor else met.where(F.col("k") > low).agg(F.min("k")).first()[0]
        bits = np.array([low, high], np.int64)
        out = float((bits ^ ((bits >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64).mean())
    forget(docs.sparkSession, place)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Ranker:
    """Fit the weights on a bounded sample of labelled rows, ``2 * per_class`` rows of features at most reach the driver; the threshold is over all labelled rows."""
    sample = F.broadcast(sample_labels(labels, id_col, label_col, per_class))  # bounded by per_class
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    got = rows.mapInArrow(run, "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    y = np.array(got.column("label").to_pylist(), np.int64)
    order = np.lexsort((*x.T[::8], y))  # the order in which rows arrive doesn't count
    ranker = fit(x[order], y[order])
    if not ranker.weights.any():
        return ranker
    return replace(ranker, threshold=threshold(docs, labels, ranker, id_col, text_col, label_col))


def score_documents(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where score >= 0.5).

    The score depends on the text alone; null and empty texts have the score
    of all-zero features. Other columns and repeated rows pass unchanged; an
    older ``score`` or ``predicted`` column is replaced. Empty input: no rows.
    """

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = pa.RecordBatch.from_arrays([part], names=["text"])
            out = [ranker.score(features(data, offsets).astype(np.float64)) for _, data, offsets in steps(iter([texts]))]
            yield pa.array(np.concatenate([np.zeros(0), *out]))

    scored = docs.withColumn("score", score(F.coalesce(F.col(text_col), F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

