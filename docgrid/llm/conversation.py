"""Repair of conversations: signature deduplication.

A conversation's rows become a string, its signature, of one letter a row:
the role's initial and the row's first fault. What to edit depends on the
signature alone, so each distinct signature is solved once, by a memoised
recursion over its halves that also finds shared stretches again. The audits
are joined back to the conversations and replayed over their rows.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3, the only edit of
a blank or repeated row), Insert an empty user or assistant turn (2);
truncated rows that stay cost 1 each. The repaired initials match
``(s?(ua)+)?``; of the cheapest edits the ones whose initials are the least
string win.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import cut, salted

#: Initials and faults: letter 4 * initial + fault, from "A".
INITIALS, FAULTS = "suax", "nbdt"
#: Rows in a piece of a signature, so that no group of rows grows with a conversation.
PIECE = 1024
#: Stretches of a signature that are remembered, and the longest that are.
MEMO, MEMO_LONGEST = 1 << 16, 64

#: What has been emitted: nothing, a system turn, a user turn, an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after an inserted or reroled turn, and after a kept one.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_KEEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: By state: the cost and the edits of an ending.
_END, _TAIL = (0, 4, 2, 0), ("", "II", "I", "")


def _row(letter: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], list[str], list[int]]:
    """One row before costs ``ahead``: by state the cost, the edits (inserts, then what happens to the row) and the state after it."""
    initial, fault = INITIALS[(ord(letter) - 65) >> 2], FAULTS[(ord(letter) - 65) & 3]
    late = fault == "t"
    best: list[tuple[int, str, int]] = []
    for s in range(4):
        options = [(3 + ahead[s], "D", s)]
        if fault in "nt":
            if (s, initial) in _KEEP:
                options.append((late + ahead[_KEEP[s, initial]], "K", _KEEP[s, initial]))
            options.append((2 + late + ahead[_NEXT[s]], "R", _NEXT[s]))
        best.append(min(options))
    for _ in range(3):  # no more than three inserts lead to another state
        best = [min(best[s], (2 + best[_NEXT[s]][0], "I" + best[_NEXT[s]][1], best[_NEXT[s]][2])) for s in range(4)]
    return tuple(x[0] for x in best), [x[1] for x in best], [x[2] for x in best]


def _stretch(signature: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], list[str], list[int]]:
    if len(signature) == 1:
        return _row(signature, ahead)
    half = len(signature) // 2
    solve = _known if len(signature) <= 2 * MEMO_LONGEST else _shifted
    costs, right, ends = solve(signature[half:], ahead)
    costs, left, middle = solve(signature[:half], costs)
    return costs, [left[s] + right[middle[s]] for s in range(4)], [ends[middle[s]] for s in range(4)]


_remembered = lru_cache(MEMO)(_stretch)


def _shifted(signature: str, ahead: tuple[int, ...], solve=_stretch) -> tuple[tuple[int, ...], list[str], list[int]]:
    """Costs differ by at most four between states, so few vectors are left once the least is taken off."""
    least = min(ahead)
    costs, edits, ends = solve(signature, tuple(x - least for x in ahead))
    return tuple(x + least for x in costs), edits, ends


def _known(signature: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], list[str], list[int]]:
    return _shifted(signature, ahead, _remembered if len(signature) <= MEMO_LONGEST else _stretch)


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of a signature; the recursion is as deep as the logarithm of its length."""
    if not signature:
        return 0, ""
    costs, edits, ends = _known(signature, _END)
    return costs[_START], edits[_START] + _TAIL[ends[_START]]


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` rows with the faults that the hash of ``conv_id:turn`` deals out; a null role or text becomes one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("__h")).where("__h <> 0")
    damaged = slim.select(
        "conv_id", "turn", F.when(F.col("__h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__h") == 1, "").when(F.col("__h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("__h") == 3, 2).otherwise(1))).alias("__n"),
    )
    return damaged.drop("__n")


def _letter(initial: Column, fault: Column) -> Column:
    return F.char(F.lit(65) + 4 * initial + fault)


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, at, mark, same): ``at`` numbers the rows by conversation, turn (nulls first), role and text.

    The table is sorted by ranges that also split a conversation or a turn, so
    a hot one is spread over the tasks. ``mark`` is 4 * initial + (blank 1,
    truncated 3, else 0), ``same`` a 128-bit hash of conversation, role and text.
    """
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    near = [*keys[:2], F.substring("role", 1, 32), F.substring("text", 1, 32)]  # prefixes keep the order; whole texts would be sampled to the driver
    slim = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    conv = F.coalesce(F.concat(F.lit("+"), F.col("conv").cast("string")), F.lit("-"))
    same = F.unhex(F.md5(F.concat_ws(":", F.octet_length(conv), F.octet_length("role"), conv, "role", "text")))
    return slim.repartitionByRange(*near).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("at"), (4 * initial + fault).cast("int").alias("mark"), same.alias("same"))


def _signatures(ordered: DataFrame) -> DataFrame:
    """(conv, signature) from rows in order."""
    slim = ordered.select("conv", "at", "mark", "same")
    again = slim.groupBy("same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    fault = F.col("mark") % 4
    fault = F.when(fault == 1, 1).when(F.col("at") > F.col("first"), 2).otherwise(fault)
    letters = slim.join(again, "same", "left").select("conv", "at", _letter(F.floor(F.col("mark") / 4).cast("int"), fault.cast("int")).alias("letter"))
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # as Spark numbers rows
    join = lambda c: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]))
    pieces = letters.groupBy("conv", task.alias("task"), F.floor(place / PIECE).alias("piece")).agg(F.min("at").alias("first"), join("letter").alias("letters"))
    return pieces.select("conv", F.col("first").alias("at"), "letters").groupBy("conv").agg(join("letters").alias("signature"))


def _solved(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) for distinct signatures."""
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                codes = [ord(c) - 65 for c in x]
                initials, faults = [INITIALS[c >> 2] for c in codes], [c & 3 for c in codes]
                out.append((x, *map(faults.count, (1, 2, 3)), sum(a + b not in legal for a, b in zip(initials, initials[1:])), *solve(x)))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit_conversations(rows: DataFrame, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and the ordered rows that ``replay`` needs.

    ``rows`` has conv_id, turn, role, text; ``every`` (conv_id) names
    conversations that may have lost all their rows. A null role or text
    counts as one space, a null conv_id is a conversation of its own, null
    turns come first; rows of one turn go by role and text; rows that repeat
    are duplicates. Texts of any length pass once through a sort. Other
    columns are ignored; an empty table gives no rows.
    """
    ordered, _ = cut(_ordered(rows), "turns")
    signatures, _ = cut(_signatures(ordered), "signatures")
    audits = salted(signatures, _solved(signatures), "signature", "conv").drop("signature")
    turns = ordered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    base = (every.select(F.col("conv_id").alias("conv")) if every is not None else ordered.select("conv")).distinct()
    out = base
    for part in (turns, audits):
        part = part.withColumnRenamed("conv", "__conv")
        out = out.join(part, out["conv"].eqNullSafe(part["__conv"]), "left").drop("__conv")
    return out.select("conv", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit")), ordered


class _Replay:
    """Follows one conversation's audit; gives the turns that stand after repair."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, _START

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit.startswith("I", self.at):
            self.at, self.state = self.at + 1, _NEXT[self.state]
            yield "I", _ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[self.state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, _ROLE[self.state], text

    end = _inserts


def replay(audits: DataFrame, ordered: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired turns (conv, position, edit, role, text); with ``digest`` the audits and the SHA-256 of each repaired conversation.

    A conversation's audit comes before its rows, and the rows stream by in
    order: a task holds one audit and one batch, however long a conversation
    is. (A SHA-256 is a chain over all turns, so one task must see them.)
    """
    conv = ordered.schema["conv"].dataType.simpleString()
    none = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    heads = audits.select("conv", F.lit(-1).cast("long").alias("at"), F.col("audit").alias("role"), F.lit("").alias("text"), *_COUNTS)
    lines = heads.unionByName(ordered.select("conv", "at", "role", "text", *none)).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = f"conv {conv}, {counts}, audit string, repaired_sha256 string" if digest else f"conv {conv}, position long, edit string, role string, text string"
    kinds = lines.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        target = pa.schema([(x.split()[0], to_arrow_type(kinds["conv"].dataType) if x.startswith("conv ") else pa.string() if x.endswith("string") else pa.int64()) for x in schema.split(", ")])
        head, turns, sha, position = None, None, None, 0
        out: list[tuple] = []

        def emit(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal position
            for edit, role, text in found:
                if digest:
                    sha.update(f"{chr(10) * (position > 0)}{role}:{text}".encode())
                else:
                    out.append((head[0], position, edit, role, text))
                position += 1

        def close() -> None:
            if turns is not None:
                emit(turns.end())
                if digest:
                    out.append((head[0], *head[4:], head[2], sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target, strict=True)] if out else [pa.array([], f.type) for f in target], schema=target)
            out.clear()
            return made

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    if row[1] < 0:
                        close()
                        head, turns, sha, position = row, _Replay(row[2]), hashlib.sha256(), 0
                    else:
                        emit(turns.row(row[2], row[3]))
                if out:
                    yield batch_of()
        close()
        if out:
            yield batch_of()

    return lines.mapInArrow(run, schema)
