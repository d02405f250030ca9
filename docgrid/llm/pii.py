"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each text once and stops at anchors: at
signs, plus signs, dots, digits, '://' and words that announce an account.
Around every anchor a deterministic parser expands to the left and right and
validates what it finds (labels, octets, check sums, lengths). No regular
expression runs over the texts.

Kinds: ``email ip card phone`` follow the base definitions; ``url`` (a user
name and secret before a host) and ``account`` (a number that a cue announces
and whose form or check digits hold) are further ones.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Words that announce an identifier, as they may begin a word, in lower case, capitals or with a capital.
CUES = ("account", "acct", "iban", "ssn", "passport")
#: Characters between a cue and its number.
CUE_REACH = 24

_DIGITS = frozenset("0123456789")
_ALPHA = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ALNUM = _ALPHA | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")

Span = tuple[int, int]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, "d")
    for c in "@+.":
        out.add_word(c, c)
    out.add_word("://", ":")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            out.add_word(form, "c")
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d += d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(code: str) -> bool:
    """Two letters, two check digits, 11 to 30 more; remainder 1 modulo 97."""
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _domain(text: str, i: int) -> int:
    """The end of label(.label)+ from i, or -1."""
    n, end, labels = len(text), -1, 0
    while True:
        j = i
        while j < n and text[j] in _LABEL:
            j += 1
        if j == i:
            break
        labels += 1
        end = j
        if j < n and text[j] == ".":
            i = j + 1
        else:
            break
    return end if labels > 1 else -1


def _emails(text: str, at: list[int]) -> Iterator[Span]:
    last = 0
    for a in at:
        if a < last:
            continue
        start = a
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start == a:
            continue
        end = _domain(text, a + 1)
        if end > 0:
            yield start, end
            last = end


def _ips(text: str, dots: list[int]) -> Iterator[Span]:
    last, n = 0, len(text)
    for d in dots:
        start = d
        while start > last and text[start - 1] in _DIGITS:
            start -= 1
        if d < last or start == d:
            continue
        parts, i = [text[start:d]], d
        while len(parts) < 4 and i < n and text[i] == ".":
            j = i + 1
            while j < n and text[j] in _DIGITS:
                j += 1
            if j == i + 1:
                break
            parts.append(text[i + 1 : j])
            i = j
        if len(parts) == 4:
            last = i
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
                yield start, i


def _cards(text: str, digits: list[int]) -> Iterator[Span]:
    """Runs of digits with one space or hyphen between at most, as the anchors show them."""
    i, n = 0, len(digits)
    while i < n:
        j = i
        while j + 1 < n and (digits[j + 1] == digits[j] + 1 or (digits[j + 1] == digits[j] + 2 and text[digits[j] + 1] in " -")):
            j += 1
        if 13 <= j - i + 1 <= 19 and luhn("".join([text[k] for k in digits[i : j + 1]])):
            yield digits[i], digits[j] + 1
        i = j + 1


def _phones(text: str, plus: list[int]) -> Iterator[Span]:
    n = len(text)
    for p in plus:
        if p + 1 >= n or text[p + 1] not in _DIGITS:
            continue
        j, end, count, most = p + 2, -1, 1, 1
        while j < n and text[j] in _PHONE:
            if text[j] in _DIGITS:
                count += 1
                if j >= p + 3:
                    end, most = j + 1, count
            j += 1
        if end > 0 and 9 <= most <= 15:
            yield p, end


def _urls(text: str, schemes: list[int]) -> Iterator[Span]:
    """scheme://user:secret@host; from the scheme to the end of the host."""
    last, n = 0, len(text)
    for s in schemes:  # at the first slash's colon
        start = s
        while start > last and text[start - 1] in _ALNUM:
            start -= 1
        if start == s or s < last:
            continue
        j, colon, end = s + 3, -1, -1
        while j < n and not text[j].isspace() and text[j] not in "/?#\"'<>":
            if text[j] == ":" and colon < 0:
                colon = j
            if text[j] == "@" and s + 3 < colon < j - 1:
                end = j + 1
            j += 1
        if 0 < end < j:
            yield start, j
            last = j


def _accounts(text: str, cues: list[int], digits: list[int]) -> Iterator[Span]:
    """The first number within reach after a cue: an IBAN, nine digits as 3-2-4, or 8 to 17 digits; passports 6 to 9 characters."""
    last, n = 0, len(text)
    for c in cues:  # the cue's end
        if c < last or (c < n and text[c] in _ALPHA and text[c] not in "sS"):
            continue
        k = bisect_right(digits, c - 1)
        if k == len(digits) or digits[k] - c > CUE_REACH:
            continue
        start = digits[k]
        while start > c and text[start - 1] in _ALNUM:
            start -= 1
        end = start
        while end < n and (text[end] in _ALNUM or (text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS)):
            end += 1
        code = "".join([x for x in text[start:end] if x in _ALNUM]).upper()
        fine = iban(code) or (code.isdigit() and 8 <= len(code) <= 17) or (6 <= len(code) <= 9 and code[:1].isalpha() and code[2:].isdigit())
        if fine:
            yield start, end
            last = end


def find(text: str) -> dict[str, list[Span]]:
    """Spans of every kind, in code points, ends exclusive, ordered by start."""
    hits: dict[str, list[int]] = {"d": [], "@": [], "+": [], ".": [], ":": [], "c": []}
    for end, kind in _automaton().iter(text):
        hits[kind].append(end)
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    digits = hits["d"]
    if hits["@"]:
        found["email"] = list(_emails(text, hits["@"]))
    if digits:
        n = len(text)
        dots = [x for x in hits["."] if x and x + 1 < n and text[x - 1] in _DIGITS and text[x + 1] in _DIGITS]
        if len(dots) > 2:
            found["ip"] = list(_ips(text, dots))
        if len(digits) > 12:
            found["card"] = list(_cards(text, digits))
        if hits["+"] and len(digits) > 8:
            found["phone"] = list(_phones(text, hits["+"]))
        if hits["c"]:
            found["account"] = list(_accounts(text, [x + 1 for x in hits["c"]], digits))
    if hits[":"]:
        found["url"] = list(_urls(text, [x - 2 for x in hits[":"]]))
    return found


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in kinds for a, b in found[k]])


def redact(text: str, found: dict[str, list[Span]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    spans = sorted((a, -b, k) for k in KINDS for a, b in found[k])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_<kind>..., base_sha256, spans[, redacted]) for every row of ``docs``.

    ``spans``: kind:start:end, by kind as listed in ``KINDS``, then start,
    joined by commas; ``base_sha256`` is over the base kinds only. Null and
    empty texts have no spans. Null ids, repeated rows and other columns: rows
    pass through one by one, other columns are ignored. Empty input: no rows.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string" + ", redacted string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            sha, spans, clean = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = find(text)
                for k in KINDS:
                    counts[k].append(len(found[k]))
                sha.append(hashlib.sha256(joined(found, BASE).encode()).hexdigest())
                spans.append(joined(found, KINDS))
                if with_text:
                    clean.append(redact(text, found))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if with_text:
                columns.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, schema)
