import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.llm import decontam


def distance_table(item, text):
    """Nearest stretch by the plain table: (distance, first end)."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text):
        new = [0]
        for i, d in enumerate(item):
            new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (c != d)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j + 1)
    return best


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=70), st.binary(max_size=90))
def test_edit_search(item, text):
    item, text = bytes(c % 4 for c in item), bytes(c % 4 for c in text)
    best, end = distance_table(item, text)
    assert decontam.edit_search(item, text, len(item) - 1) == ((best, end) if best < len(item) else (len(item), -1))


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.integers(len(out))
        kind = rng.integers(3)
        if kind == 0:
            out[k] = rng.choice(list("abcdefgh "))
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, rng.choice(list("abcdefgh")))
    return "".join(out)


def words(rng, n):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    out = ""
    while len(out) < n:
        out += "".join(rng.choice(syllables, rng.integers(1, 5))) + " "
    return out[:n].strip().ljust(n, "x")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = [(i, words(rng, int(rng.integers(81, 395)))) for i in range(60)]
    rows, truth, planted = [], set(), {}
    for i in range(400):
        text = words(rng, int(rng.integers(200, 900)))
        if i % 2 == 0:
            j, part = i % 60, [0, 2, 5, 7, 10][i // 2 % 5]
            leak = edited(rng, items[j][1], int(len(items[j][1]) * part / 100))
            text = text[:150] + " " + (leak.upper() if i % 3 else leak.replace(" ", " \n ")) + " " + text[150:]
            planted[i] = (j, part)
        rows.append((i, text))
    norm = lambda t: " ".join(t.lower().split()).encode()
    for i, t in rows:
        for j, item in items:
            if (i in planted and planted[i][0] == j) or i < 12:
                n = norm(item)
                if decontam.edit_search(n, norm(t), len(n) * 10 // 100)[1] >= 0:
                    truth.add((i, j))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(docs, bench).collect()
    got = {(r.id, r.item_id) for r in found}
    assert got <= truth
    assert len(got & truth) >= 0.97 * len(truth)
    assert all((i, j) in got for i, (j, part) in planted.items() if part <= 5)
    by = dict(rows)
    for r in found:
        text = by[r.id].encode()[r.start : r.end].decode()
        assert distance_table(norm(items[r.item_id][1]), norm(text))[0] == r.distance
    clean = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}
    split = {(r.id, r.item_id) for r in decontam.find_leaks(docs, bench, block=20).collect()}
    assert split == got


def test_edges(spark):
    item = "the quick brown fox jumps over the lazy dog and runs"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "  " + item.upper() + "\n\n", 1), (3, "  " + item.upper() + "\n\n", 1), (None, "x " + item, 2), (5, "é" * 900_000 + item, 3), (6, item[:30], 3), (7, "   ", 3)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (8, None), (None, item), (7, "short"), (9, item + " x"), (4, "")], "item_id long, text string")
    got = sorted([(r.id, r.item_ids, r.distances) for r in decontam.contamination(docs, bench).collect()], key=str)
    assert got == [(3, [9], [0]), (5, [9], [0]), (None, [9], [0])]
    assert sorted([r.doc_id for r in decontam.decontaminate(docs, bench).collect()]) == [1, 2, 6, 7]
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 == decontam.find_leaks(docs, bench.limit(0)).count()
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 8


def test_evenly_spaced_edits_and_short_items(spark):
    """Edits that leave no run of 12 bytes, and items of 4 to 40 bytes: all are found, as brute force finds them."""
    rng = np.random.default_rng(11)
    items = [(i, words(rng, n).strip()) for i, n in enumerate([4, 7, 9, 11, 16, 19, 21, 23, 25, 30, 40, 81, 120, 200, 300, 394] * 2)]
    rows = []
    for i, item in items:
        most = len(item) * 10 // 100
        for kind in range(3):  # substituted, inserted, left out
            out, step = list(item), len(item) / (most + 1)
            for e in range(most, 0, -1):
                k = int(e * step) - (kind == 2)
                out[k : k + (kind != 1)] = ["#"] if kind < 2 else []
            rows.append((len(rows), words(rng, 150) + " " + "".join(out) + " " + words(rng, 150)))
            rows.append((len(rows), "".join(out)))
    norm = lambda t: " ".join(t.lower().split()).encode()
    truth = {}
    for d, text in rows:
        for i, item in items:
            distance, end = decontam.edit_search(norm(item), norm(text), len(norm(item)) * 10 // 100)
            if end >= 0:
                truth[d, i] = distance
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item_id): r.distance for r in decontam.find_leaks(docs, bench).collect()} == truth
    assert {(d, d // 6) for d, _ in rows} <= set(truth)


def test_many_ranges_at_once_equal_one_at_a_time():
    rng = np.random.default_rng(9)
    items = [(i, bytes(rng.integers(97, 101, int(rng.choice([4, 12, 40, 63, 64, 65, 128, 130, 400]))).astype(np.uint8))) for i in range(40)]
    index = decontam.Index(items, 10)
    data, low, high, item = [], [], [], []
    at = 0
    for _ in range(400):
        i = int(rng.integers(len(items)))
        near = edited(rng, items[i][1].decode(), int(rng.integers(0, 2 + len(items[i][1]) // 8))).encode()
        part = bytes(rng.integers(97, 101, int(rng.integers(0, 20))).astype(np.uint8)) + near + b"a" * int(rng.integers(0, 9))
        data.append(part)
        low, high, item, at = [*low, at], [*high, at + len(part)], [*item, i], at + len(part)
    data = np.frombuffer(b"".join(data), np.uint8)
    low, high, item = map(np.array, (low, high, item))
    got = index._within(data, item, low, high)
    want = [decontam.edit_search(items[i][1], data[a:z].tobytes(), len(items[i][1]) // 10)[1] >= 0 for i, a, z in zip(item, low, high)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_a_common_opening_of_all_items():
    """Every item begins alike: each place where the opening stands is a place of all items."""
    import time

    rng = np.random.default_rng(5)
    opening = words(rng, 60)
    items = [(i, f"{opening} {words(rng, 50)}".encode()) for i in range(2000)]
    index = decontam.Index(items, 10)
    texts = [f"{opening} but something else here. {opening}", f"x {items[7][1].decode()[:-3]}", "nothing of it"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    began = time.perf_counter()
    found = index.search(data, np.cumsum([0, *map(len, texts)]))
    assert {w: set(v) for w, v in found.items()} == {1: {7}} and time.perf_counter() - began < 20
