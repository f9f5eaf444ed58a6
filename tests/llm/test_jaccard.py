import random

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemill.llm import jaccard, scan


def brute(rows, size, percent):
    sets = []
    for i, t in rows:
        words = [w for w in (t or "").lower().split() if w]
        grams = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        sets.append((i, grams))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(((i, len(x), find(i) if i is not None else None) for i, x in sets), key=str)


def near_copies(seed: int, count: int):
    r = random.Random(seed)
    rows = []
    for k in range(count):
        words = prose(seed * 100 + k % 9, r.choice((10, 12, 30, 100, 250))).split()
        for _ in range(r.choice((0, 0, 1, 2, len(words) // 30, len(words) // 12))):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        if r.random() < 0.2:
            words = words[: r.randint(1, len(words))]
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("chunk", [1000, 7])
def test_components_by_definition(spark, monkeypatch, size, percent, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    rows = near_copies(size, 160) + [(500, None), (501, ""), (None, "a b c d"), (502, "A b C d"), (503, "a B c d"), (7, "zeta one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, jaccard.join(docs, size, percent).collect()), key=str)
    assert found == brute(rows, size, percent)


def test_regular_texts_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 take the two Thue-Morse words of 2,048 letters for one."""
    x, y = ("".join(letters[bin(k).count("1") % 2] for k in range(2048)) for letters in ("ab", "ba"))
    rows = [(1, f"w1 w2 {x}"), (2, f"w1 w2 {y}"), (3, f"w1 w2 {x}"), (4, x), (5, y), (6, f"{x} {y}"), (7, f"{y} {x}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)


def test_digests_differ_where_bytes_do():
    r = random.Random(12)
    words = sorted({bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(1, 20))) for _ in range(5000)} | {b"\0" * n for n in range(1, 20)})
    r.shuffle(words)
    words += words[:1000]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    low, high = scan.digests(data, ends - [len(w) for w in words], ends)
    bits = list(zip(low.tolist(), high.tolist(), strict=True))
    assert len(set(bits)) == len(set(words)) and dict(zip(words, bits, strict=True)) == dict(zip(reversed(words), reversed(bits), strict=True))
    assert len(set(low.tolist())) == len(set(high.tolist())) == len(set(words))
    assert not len(scan.digests(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))[0])


@pytest.mark.parametrize("crowd", [1000, 4])
@pytest.mark.parametrize("flush", [1 << 20, 300])
def test_crowded_keys_and_many_tasks(spark, monkeypatch, crowd, flush):
    monkeypatch.setattr(jaccard, "KEY_SETS", crowd)
    monkeypatch.setattr(jaccard, "PACK_KEYS", flush)
    monkeypatch.setattr(jaccard, "PART_KEYS", flush)
    monkeypatch.setattr(jaccard, "GROUP_PAIRS", flush)
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 25)
    monkeypatch.setattr(jaccard, "BIN_SETS", 5)
    rows = near_copies(31, 260)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.join(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)


def test_neighbours_by_definition():
    r = np.random.default_rng(5)
    size = r.integers(20, 60, 40)
    vector = np.array([np.bincount(r.integers(0, 4, n) * r.integers(1, 3), minlength=jaccard.DIMENSIONS) for n in size]).astype(np.uint8)
    pairs = sorted({(int(r.integers(0, 12)), int(r.integers(0, 40))) for _ in range(90)})
    key, node = np.array(pairs).T
    fits = lambda a, b: 190 * int(np.minimum(vector[a], vector[b]).sum()) >= 90 * int(size[a] + size[b])
    want = {x: x for x in range(40)}

    def find(of, x):
        while of[x] != x:
            x = of[x]
        return x

    for k in set(key.tolist()):
        own = node[key == k].tolist()
        for a in own:
            for b in own:
                if a < b and fits(a, b):
                    p, q = sorted((find(want, a), find(want, b)))
                    want[q] = p
    got = {x: x for x in range(40)}
    for a, b in zip(*(x.tolist() for x in jaccard.neighbours(key, node, np.zeros(len(key), bool), size, vector, 90)), strict=True):
        assert fits(a, b)
        p, q = sorted((find(got, a), find(got, b)))
        got[q] = p
    assert [find(got, x) for x in range(40)] == [find(want, x) for x in range(40)]
    assert len({find(got, x) for x in range(40)}) > 5


def test_linked_pairs_share_a_key():
    r = random.Random(1)
    for percent in (80, 90):
        for _ in range(300):
            n = r.choice((1, 2, 5, 9, 12, 20, 40, 200, 900))
            base = np.array(sorted({r.getrandbits(64) for _ in range(n)}), np.uint64)
            other = np.array(sorted({*base[r.randint(0, n // 10) :].tolist(), *(r.getrandbits(64) for _ in range(r.randint(0, n // 10)))}), np.uint64)
            common = len(set(base.tolist()) & set(other.tolist()))
            if not common or 100 * common < percent * (len(base) + len(other) - common) or base.tolist() == other.tolist():
                continue
            keys, firsts = jaccard.keys_of(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), percent)
            assert set(keys[: firsts[1]].tolist()) & set(keys[firsts[1] :].tolist())


@pytest.mark.parametrize("sizes", [(20, 60), (400, 700), (3000, 3600)])
def test_tree_loses_nothing(sizes):
    r = random.Random(2)
    sets = []
    for _ in range(60):
        base = [r.getrandbits(64) for _ in range(r.randint(*sizes))]
        sets += [np.array(sorted(base), np.uint64), np.array(sorted(base[r.randint(0, len(base) // 8) :]), np.uint64)]
    lengths = np.array([len(x) for x in sets])
    groups = jaccard.dimensions(int(np.median(lengths)))
    tree = jaccard.CountTree(np.array([jaccard.count_vector(x, groups) for x in sets]), lengths)
    assert sorted(tree.order.tolist()) == list(range(len(sets)))
    candidates = 0
    for k in range(len(sets)):
        near = set(tree.after(k, 80).tolist())
        candidates += len(near)
        a = set(sets[tree.order[k]].tolist())
        for j in range(k + 1, len(sets)):
            b = set(sets[tree.order[j]].tolist())
            assert j in near or 100 * len(a & b) < 80 * len(a | b)
    assert candidates < 400


def test_representatives(spark):
    text = prose(3, 100)
    docs = spark.createDataFrame([(3, text, 1), (1, text + " more", 2), (2, prose(4, 100), 3), (None, text, 4), (4, None, 5)], "doc_id long, text string, component_id int")
    assert sorted(r["component_id"] for r in jaccard.representatives(docs).collect()) == [2, 3, 4, 5]
