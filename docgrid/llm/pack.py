"""Packing by a controlled mixture: deficit round-robin over source queues.

Every source is a queue of tokens (its documents, one after the other). In
each round a queue's deficit counter grows by its quantum, its share of a
sequence in the target mixture; once the counter holds at least ``least``
tokens the queue is served, documents being cut where the counter ends. What
a counter has left is carried into the next round. The rounds, laid end to
end, are cut into sequences of ``size`` tokens, so only the last one can be
short.

A queue's total after r rounds has a closed form, ``floor(served rounds x
quantum)``, and so has the place of any token. A task therefore starts from
the very deficits with which the rounds before it end, whichever queue and
rounds its rows stand in; nothing runs through the driver but the totals of
at most ``QUEUES`` queues.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import cut

#: Queues at most. The sources with the most tokens have one each, all others share the last.
QUEUES = 256
#: Tokens that one numpy step places.
STEP_TOKENS = 1 << 20

def _bytes_of() -> dict[str, int]:
    """The printable alphabet in which byte-level vocabularies are written."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for a byte-level tokenizer's json file.

    Where a vocabulary numbers its tokens in the order of its merges, the
    ``tiktoken`` library gives the same ids several times faster from ranks
    read from the same file; other tokenizers run as they are.
    """

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        self.encoding, self.special = None, ()
        rules = json.loads(vocabulary)
        model, added = rules["model"], {x["content"]: x["id"] for x in rules.get("added_tokens") or ()}
        alphabet, vocab = _bytes_of(), {t: i for t, i in (model.get("vocab") or {}).items() if t not in added} if model["type"] == "BPE" else {}
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges") or ()]
        split = rules.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex") and not rules.get("normalizer")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and all(x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in rules.get("added_tokens") or ())
        if plain and merged == sorted(set(merged)) and len(vocab) == 256 + len(merged) and min(merged, default=256) >= 256 and all(c in alphabet for t in vocab for c in t):
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
            self.encoding, self.special = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added), tuple(added)
        else:
            self.one = Tokenizer.from_buffer(vocabulary).encode

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.encoding is None:
            return array("I", self.one(text, add_special_tokens=False).ids).tobytes()
        if any(map(text.__contains__, self.special)):
            return array("I", self.encoding.encode(text, allowed_special="all", disallowed_special=())).tobytes()
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).tobytes()


@lru_cache(2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def tokenise(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, part, start, ids): each row's ids with ``end_id`` after them; before them stand ``start`` tokens of the same task and source."""
    with open(vocabulary, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(lines.value), TaskContext.get().partitionId()
        before: dict[str | None, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                out, start = [], []
                for source, text in zip(rows.column(1).to_pylist(), rows.column(2), strict=True):
                    ids = encoder.encode(text.as_py() or "") + end
                    out.append(ids)
                    start.append(before.get(source, 0))
                    before[source] = start[-1] + len(ids) // 4
                ends = np.cumsum([0, *map(len, out)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(out), np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([part] * len(out), pa.int32()), pa.array(start, pa.int64()), lists], names=["id", "source", "part", "start", "ids"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, source string, part int, start long, ids array<int>")


@dataclass(frozen=True)
class Schedule:
    """Deficit round-robin in closed form: ``total`` tokens of each queue, its ``weight`` in the target mixture."""

    total: np.ndarray
    weight: np.ndarray
    size: int
    least: int

    def __post_init__(self) -> None:
        quantum = self.size * self.weight / self.weight.sum()
        every = np.maximum(1, np.ceil(self.least / quantum)).astype(np.int64)  # rounds until a counter holds `least` tokens
        put = object.__setattr__
        put(self, "every", every)
        put(self, "gain", every * quantum)
        put(self, "phase", np.arange(len(every)) * every // len(every))  # so that small queues don't all come up at once

    def served(self, queue: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Tokens of a queue once it was served ``turns`` times; the fraction cut off is the deficit that it carries."""
        return np.minimum(np.floor(turns * self.gain[queue]).astype(np.int64), self.total[queue])

    def turn(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The turn, from 1, in which a queue's token comes."""
        turn = np.maximum(1, np.ceil((token + 1) / self.gain[queue])).astype(np.int64)
        turn += np.floor(turn * self.gain[queue]) <= token  # the division may be off by one
        return turn - (np.floor((turn - 1) * self.gain[queue]) > token)

    def place(self, queue: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Where a queue's turn begins in the rounds laid end to end. Queues take turns in an order that rotates by the round."""
        rounds = turn * self.every[queue] - self.phase[queue] - 1
        n = len(self.total)
        every = np.arange(n)[None, :]
        back = (rounds[:, None] + self.phase) // self.every
        now = (rounds[:, None] + 1 + self.phase) // self.every
        earlier = (every - rounds[:, None]) % n < ((queue - rounds) % n)[:, None]
        return self.served(every, np.where(earlier, now, back)).sum(axis=1)

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents that stand at [first, first + n) in their queues, as (document, its tokens before the piece, length, place)."""
        one, last = self.turn(queue, first), self.turn(queue, first + n - 1)
        of = np.repeat(np.arange(len(queue)), last - one + 1)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(last - one + 1) - (last - one + 1), last - one + 1) + one[of]
        q = queue[of]
        begin = self.served(q, turn - 1)
        low = np.maximum(begin, first[of])
        length = np.minimum(self.served(q, turn), (first + n)[of]) - low
        place, start = self.place(q, turn) + low - begin, low - first[of]
        # end to end: one piece
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + length[:-1])
        head = np.flatnonzero(new)
        of, place, start, length = of[head], place[head], start[head], np.add.reduceat(length, head) if len(head) else length
        # cut at the ends of sequences
        parts = (place + length - 1) // self.size - place // self.size + 1
        row = np.repeat(np.arange(len(of)), parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        low = np.maximum(place[row], (place[row] // self.size + k) * self.size)
        high = np.minimum((place + length)[row], (place[row] // self.size + k + 1) * self.size)
        return of[row], start[row] + low - place[row], high - low, low


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, target: Mapping[str | None, float] | None = None, least: int = 256,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences of ``size`` tokens: (id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``vocabulary`` is a byte-level tokenizer's json file, readable by the
    driver; its text (a few MB) travels as a broadcast. Strings of special
    tokens in a text give those tokens, as the library has it by default.
    ``target`` gives the sources' weights, a source that it leaves out having
    1; without it each has its own share of all tokens, so that every window
    has the whole table's mixture. When a queue is used up, the rest go on in
    their proportions. In any run of windows a queue with tokens left is off
    its share by less than ``least`` and a round's rounding. Beyond ``QUEUES``
    sources the smallest share a queue, which weighs what they do together.

    A null or empty text is its end token alone; a null source is a source of
    its own; null ids, repeated ids and repeated rows pass through, each row
    with tokens of its own; other columns are ignored, whatever their names;
    an empty table gives no rows. A text of any length is cut like others. The
    order within a queue is that of the input's partitions and their rows.
    """
    spark = docs.sparkSession
    tokens, _ = cut(tokenise(docs, vocabulary, end_id, id_col, text_col, source_col), "tokens")
    sums, _ = cut(tokens.groupBy("source", "part").agg(F.sum(F.size("ids")).alias("n")), "queues")
    tops = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("source").asc_nulls_first()).limit(QUEUES).collect()
    own = tops if len(tops) < QUEUES else tops[: QUEUES - 1]
    everything = sums.agg(F.sum("n")).first()[0] or 0
    total = [r["n"] for r in own]
    weight = [float((target or {}).get(r["source"], 1)) if target else float(r["n"]) for r in own]
    if everything > sum(total):
        total.append(everything - sum(total))
        weight.append(float(sums.select("source").distinct().count() - len(own)) if target else float(total[-1]))
    if min(weight, default=1) <= 0:
        raise ValueError("weights must be positive: every token is packed")
    schedule = Schedule(np.array(total, np.int64), np.array(weight), size, least) if total else None

    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(own)], "source string, queue int")  # `QUEUES` rows at most
    dealt = sums.join(F.broadcast(names), sums["source"].eqNullSafe(names["source"]), "left").select(sums["source"], "part", "n", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    tasks = dealt.groupBy("queue", "part").agg(F.sum("n").alias("n")).withColumn("low", F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).drop("n")
    inner = F.sum("n").over(Window.partitionBy("queue", "part").orderBy(F.col("source").asc_nulls_first())) - F.col("n")
    base = dealt.withColumn("inner", inner).join(tasks, ["queue", "part"]).select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", (F.col("low") + F.col("inner")).alias("base"))
    base, _ = cut(base, "bases")  # its size is known then, so the tokens aren't shuffled to meet it while it is small
    placed = tokens.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "queue", (F.col("base") + F.col("start")).alias("first"), "ids")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, first = (batch.column(i).to_numpy() for i in (2, 3))
            lists = batch.column(4)
            ends, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_TOKENS, "right")) - 1)
                n = np.diff(ends[at : to + 1])
                of, start, length, place = schedule.pieces(queue[at:to].astype(np.int64), first[at:to], n)
                low = ends[at + of] + start
                crc = [zlib.crc32(ids[i : i + k]) for i, k in zip(low.tolist(), length.tolist(), strict=True)]
                rows = batch.slice(at, to - at).select([0, 1]).take(pa.array(of))
                columns = [*rows.columns, *map(pa.array, (start, length, np.array(crc, np.int64), n[of], place // size, place % size))]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    index = np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], length)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[index])))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
                at = to

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, lengths, sources): the sequences themselves, from pieces with ``ids``.

    ``lengths`` holds a piece's length for each piece, for attention masks. A
    short sequence is padded to ``size`` unless its length is a power of two.
    A group is one sequence, ``size`` tokens at most.
    """
    by = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "source", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    padded = F.when(n.bitwiseAND(n - 1) == 0, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(size) - n)))
    return by.select("sequence_id", padded.alias("ids"), F.col("p.length").alias("lengths"), F.col("p.source").alias("sources"))
