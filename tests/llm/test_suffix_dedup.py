import hashlib
from collections import Counter

import numpy as np
import pytest

from docgrid.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        off = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                off[s : s + length] = b"\1" * length
        kept = bytes(c for c, o in zip(t, off) if not o)
        spans = sum(1 for k in range(len(off)) if off[k] and (k == 0 or not off[k - 1]))
        out.append((i, len(t), sum(off), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    make = lambda k: "".join(rng.choice(list("abcdé \n"), k))
    passages = [make(int(k)) for k in rng.integers(60, 500, 8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 6)):
            if rng.random() < 0.5:
                p = passages[rng.integers(len(passages))]
                a = rng.integers(0, len(p) // 2)
                parts.append(p[a : a + int(rng.integers(40, 500))])
            else:
                parts.append(make(int(rng.integers(1, 300))))
        rows.append((i, "".join(parts)))
    rows += [(900, None), (901, ""), (902, "x" * 700), (903, "y" * 199), (904, "y" * 200), (905, "ab" * 300), (906, rows[3][1]), (906, rows[3][1]), (None, rows[5][1]), (None, make(300))]
    return rows


@pytest.mark.parametrize("seed, length", [(1, 200), (2, 200), (3, 100), (4, 40)])
def test_against_brute_force(spark, seed, length):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length=length).collect()], key=str)
    assert got == brute(rows, length)
    assert sum(r[2] for r in got)


def test_long_text_in_pieces_and_kept_bytes(spark, monkeypatch):
    from docgrid.llm import suffix_dedup

    rng = np.random.default_rng(9)
    make = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    shared = make(5000)
    big = make(1_048_576 - 2300) + shared + make(400_000)
    rows = [(1, big), (2, make(100) + shared[700:4000] + make(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in remove_repeats(docs, with_text=True).collect()}
    assert got[1].n_removed >= 3300 and got[2].n_removed >= 3300 and got[1].n_spans == got[2].n_spans == 1
    assert len(got[2].kept) == got[2].n_bytes - got[2].n_removed
    assert hashlib.sha256(got[1].kept).hexdigest() == got[1].kept_sha256
    assert remove_repeats(docs.limit(0)).count() == 0
