import re

import numpy as np
from pyspark.sql import functions as F

from docgrid.llm import ngram_join
from docgrid.llm.ngram_join import Bands, jaccard_components, signatures


def brute(rows, k, percent):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=str)


def corpus(seed, n=160):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.7:
            w = list(bases[rng.integers(len(bases))])
            for _ in range(rng.integers(0, max(2, len(w) // 25))):
                j = rng.integers(len(w))
                if rng.random() < 0.5:
                    w[j] = rng.choice(vocabulary)
                else:
                    del w[j]
                    if not w:
                        w = ["x"]
        else:
            w = list(rng.choice(vocabulary, rng.choice([1, 3, 4, 5, 8, 11, 20, 60, 200, 700])))
            bases.append(w)
        rows.append((int(i * 3 + 1), " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    return rows


def test_against_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted([(r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k=k, percent=percent).collect()], key=str)
        assert got == brute(rows, k, percent)
        assert len({c for _, _, c in got}) < len(got) * 0.8


def test_edges(spark):
    rows = [(5, None, 1), (4, "", 1), (3, " \n", 1), (9, "One two", 1), (2, "one  TWO", 1), (7, "one", 1), (None, "one two", 1), (11, "a b c d e f " * 40_000, 1), (12, "a b c d e f " * 40_000, 1), (6, "one two", None), (6, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted([(r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()], key=str)
    assert got == sorted([(5, 0, 5), (4, 0, 4), (3, 0, 3), (9, 1, 2), (2, 1, 2), (7, 1, 7), (None, 1, None), (11, 6, 11), (12, 6, 11), (6, 1, 2), (6, 1, 2)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_a_chain_and_a_hub_of_near_copies(spark):
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each links with its neighbours only
        w = list(base)
        w[: 2 * i] = [f"c{j}" for j in range(2 * i)]
        rows.append((1000 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k=4, percent=85).collect()], key=str)
    assert got == brute(rows, 4, 85)


def shared_of(a, b):
    return len(np.intersect1d(a, b))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        bands = Bands(percent)
        for _ in range(1500):
            n = int(rng.integers(1, rng.choice([8, 40, 400])))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            while True:  # as far apart as a link allows
                c = b
                c = np.delete(c, rng.integers(len(c))) if rng.random() < 0.5 and len(c) > 1 else np.unique(np.append(c, np.uint64(rng.integers(0, 2**63))))
                shared = len(np.intersect1d(a, c))
                if 100 * shared < percent * (len(a) + len(c) - shared):
                    break
                b = c
                if rng.random() < 0.02:
                    break
            if len(a) == len(b) == shared_of(a, b):
                continue  # equal sets have one name
            sigs, owner = signatures([a, b], bands)
            assert len(np.intersect1d(sigs[owner == 0], sigs[owner == 1]))


def test_a_dense_group_around_the_threshold(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(150):  # copies with none to eight edits; some edits are shared
        w = list(base)
        for _ in range(rng.integers(0, 9)):
            j = int(rng.integers(0, 30)) * 3
            w[j : j + 1] = [] if rng.random() < 0.2 else [f"e{j}-{rng.integers(3)}"]
        rows.append((int(i * 7 % 151), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([(r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k=4, percent=85).collect()], key=str)
    assert got == brute(rows, 4, 85)
    assert len({c for _, _, c in got}) > 10


def test_large_groups(spark, monkeypatch):
    from docgrid.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "TOGETHER", 3)
    rng = np.random.default_rng(12)
    base, rows = [f"b{i}" for i in range(90)], corpus(7, 60)
    for i in range(110):  # a group with a common tail that its smallest set lacks
        w = list(base) + ([f"t{j}" for j in range(25)] if i % 3 else [])
        for _ in range(rng.integers(0, 7)):
            j = int(rng.integers(0, 30)) * 3
            w[j : j + 1] = [] if rng.random() < 0.2 else [f"e{j}-{rng.integers(3)}"]
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([(r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k=4, percent=85).collect()], key=str)
    assert got == brute(rows, 4, 85)


def test_words_that_a_polynomial_would_confuse(spark):
    for size in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(size)]
        one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
        docs = spark.createDataFrame([(1, one), (2, two), (3, f"x {one} y z w"), (4, f"x {two} y z w")], "doc_id long, text string")
        assert {(r.id, r.component_id) for r in jaccard_components(docs, k=4, percent=85).collect()} == {(i, i) for i in (1, 2, 3, 4)}


def test_words_that_one_lane_would_confuse(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "p9jqf07o<$p2y+<y"), (3, "q abcdefghijklmnop r s"), (4, "q p9jqf07o<$p2y+<y r s")], "doc_id long, text string")
    assert {(r.id, r.component_id) for r in jaccard_components(docs, k=4, percent=85).collect()} == {(i, i) for i in (1, 2, 3, 4)}


def test_hashes_tell_words_and_shingles_apart():
    import itertools

    from docgrid.llm.common import string_hash
    from docgrid.llm.ngram_join import _fold

    every = ["".join(x).encode() for n in range(1, 5) for x in itertools.product("ab\x01\x07", repeat=n)] + [b"a" * n for n in range(5, 80)] + [b"a" * n + b"\x07" for n in range(4, 80)]
    data, size = np.frombuffer(b"".join(every), np.uint8), np.array([len(x) for x in every])
    end = np.cumsum(size)
    h = string_hash(data, end - size, end)
    assert len(np.unique(h)) == len(every)
    assert (string_hash(np.concatenate([data[7:9], data]), end - size + 2, end + 2) == h).all()  # wherever they stand
    pairs = np.array(list(itertools.product(h[:150], repeat=2)), np.uint64).ravel()
    assert len(np.unique(_fold(pairs, np.arange(0, len(pairs), 2), 2))) == 150 * 150


def test_sketches_lose_no_link():
    from docgrid.llm.ngram_join import sketch

    rng = np.random.default_rng(3)
    for n in (3, 70, 900, 5000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**64, n // 20, np.uint64, endpoint=False)]))
        x, y = (np.frombuffer(sketch(s), np.uint8).astype(int) for s in (a, b))
        w = min(len(x), len(y))
        apart = np.abs(x.reshape(w, -1).sum(1) - y.reshape(w, -1).sum(1)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_groups_lose_no_pair(spark):
    from docgrid.llm.ngram_join import _groups

    rng = np.random.default_rng(21)
    for tasks in (1, 3, 40):
        holders = []  # of each signature; families whose members share many
        for s in range(300):
            family = np.arange(0, 90) if s < 120 else np.arange(s % 250, s % 250 + 12)
            holders.append(sorted({int(x) for x in rng.choice(family, int(rng.integers(1, len(family) + 1)), replace=False)}))
        task = rng.integers(0, tasks, 300)
        found = set()
        for ids in holders:
            heads = {}
            for i in ids:
                head = heads.setdefault(task[i], i)
                if head != i:
                    found.add((i, head, False))
            least = min(heads.values())
            found |= {(h, least, True) for h in heads.values() if h != least}
        rows = _groups(spark.createDataFrame(sorted(found), "id long, pivot long, across boolean")).collect()
        now = {}
        for r in rows:
            now.setdefault(r.g, set()).add(r.id)
        assert len(rows) == sum(map(len, now.values()))
        assert all(any(set(ids) <= g for g in now.values()) for ids in holders if len(ids) > 1)


def test_what_met_in_a_task_goes_to_its_own_pivots_group(spark):
    from docgrid.llm.ngram_join import _groups

    # 10 is the pivot of 20 across tasks and a member of 1's group; 11 met it in its task, 21 met 20
    found = [(20, 10, True), (10, 1, True), (11, 10, False), (21, 20, False)]
    rows = _groups(spark.createDataFrame(found, "id long, pivot long, across boolean")).collect()
    assert {r.g for r in rows if r.id == 11} & {r.g for r in rows if r.id == 21}
    assert not _groups(spark.createDataFrame([], "id long, pivot long, across boolean")).collect()


def test_only_likely_rows_are_sent(spark, monkeypatch):
    """A join sends the rows that it needs and few others, none of them lost, with a full bitmap too."""
    rows = spark.range(-5000, 15000).withColumn("text", F.lit("x")).unionByName(spark.createDataFrame([(None, "y")], "id long, text string"))
    keys = spark.range(-5000, 15000, 97)
    want = {r.id for r in keys.collect()}
    got = [r.id for r in ngram_join._likely(rows, keys, "id").collect()]
    assert want <= set(got) and len(got) == len(set(got)) < len(want) + 50
    monkeypatch.setattr(ngram_join, "BITS", 64)
    assert want <= {r.id for r in ngram_join._likely(rows, keys, "id").collect()}


def test_buckets_grow_with_the_features(spark, monkeypatch):
    """A task holds the signatures of one bucket, which stay as many as the input grows, whatever the partitions; the same result for any number of buckets."""
    for features in (0, 10**6, 10**9, 10**12):
        for partitions in (1, 12, 200):
            buckets = ngram_join._buckets(features, partitions)
            assert buckets >= 2 * partitions and features / buckets <= ngram_join.FEATURES
    monkeypatch.setattr(ngram_join, "FEATURES", 8)
    used, real = [], ngram_join._meet
    monkeypatch.setattr(ngram_join, "_meet", lambda *a: used.append(a[3]) or real(*a))
    rows = corpus(3)
    got = sorted([(r.id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=4, percent=85).collect()], key=str)
    assert got == brute(rows, 4, 85)
    assert used[0] * 8 >= sum(n for _, n, _ in got)
