import itertools
import random

import numpy as np
import pytest

from tests.llm.conftest import bag
from tidemill.llm import packed, substrings, suffix


def symbols(text: bytes) -> np.ndarray:
    return np.append(np.frombuffer(text, np.uint8).astype(np.int32) + 1, 0)


@pytest.mark.parametrize("buckets", [suffix.BUCKETS, 0])
def test_order_is_that_of_sorting(monkeypatch, buckets):
    monkeypatch.setattr(suffix, "BUCKETS", buckets)
    r = random.Random(4)
    for _ in range(150):
        word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 20)))
        for text in (bytes(r.choice(b"ab") for _ in range(r.randint(0, 80))), word * r.randint(1, 9) + b"a" * r.randint(0, 20)):
            t = symbols(text)
            plain = t.tolist()
            assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: plain[i:])  # noqa: B023


def test_names_are_sorted_recursively(monkeypatch, spark, small):
    """Every level whose names are not all different goes to the next, down to different names."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    t = symbols("\n".join(texts).encode()[:400_000])
    levels, plain = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda text, depth=None: (levels.append(len(text)), plain(text, depth))[1])
    order = suffix.suffix_array(t, 50)
    assert len(levels) >= 4 and all(b * 2 <= a for a, b in itertools.pairwise(levels))
    raw = t.tolist()
    heads = [raw[i : i + 50] for i in order.tolist()]
    assert all(a <= b for a, b in itertools.pairwise(heads))


def test_long_runs_and_periods():
    for text in (b"=" * 300_000 + b"a" + b"=" * 200_000, b"ab" * 150_000, b"abc" * 90_000 + b"z" + b"abc" * 90_000, bytes(range(1, 250)) * 900):
        order = suffix.suffix_array(symbols(text), 50)
        padded = text + bytes(50)
        heads = [padded[i : i + 50] for i in order.tolist()]
        assert heads == sorted(heads) and len(set(order.tolist())) == len(text) + 1


@pytest.mark.parametrize("buckets", [suffix.BUCKETS, 0])
def test_order_up_to_a_depth(monkeypatch, buckets):
    monkeypatch.setattr(suffix, "BUCKETS", buckets)
    t = symbols(bytes(random.Random(5).choice(b"ab") for _ in range(3000)) * 2)
    heads = [t[i : i + 12].tolist() for i in suffix.suffix_array(t, 12)]
    assert heads == sorted(heads)


def test_common_prefixes():
    text = b"abcabcabcabc xyz abcabcab"
    order = suffix.suffix_array(symbols(text))
    starts = np.arange(len(text) - 6 + 1)
    rank = {int(p): k for k, p in enumerate(order)}
    want = [rank[i] > 0 and text[order[rank[i] - 1] :][:6] == text[i : i + 6] for i in starts.tolist()]
    padded = text + bytes(2)
    assert suffix.permuted_prefix_at_least(padded[: len(text)], order, starts, 8)[: len(text) - 7].tolist() == [
        rank[i] > 0 and len(text[order[rank[i] - 1] :]) >= 8 and text[order[rank[i] - 1] :][:8] == text[i : i + 8] for i in range(len(text) - 7)
    ]
    assert any(want)


def test_packed_values():
    for values in ([], [0], [5, 300, 2**40], [-7, -7, 12]):
        x = np.array(values, np.int64)
        assert packed.unpack(packed.pack(x), len(x)).tolist() == values
        assert packed.unpack_rising(packed.pack_rising(np.sort(x)), len(x)).tolist() == sorted(values)


def brute(rows, length):
    """(id, bytes, removed, spans) by the definition."""
    known = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for p in range(len(raw) - length + 1):
                w = raw[p : p + length]
                known[w] = min(known.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for p in range(len(raw) - length + 1):
                if known[raw[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), kept))
    return out


def test_removal_by_definition(spark, awkward, documents):
    import hashlib
    from collections import Counter

    want = Counter((i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in brute([(r[0], r[1]) for r in awkward], 50))
    assert bag(substrings.dedup(documents, digest=True)) == want


def test_removal_in_many_small_shards(spark, monkeypatch):
    for name, value in (("ANCHOR_BYTES", 4000), ("TEXT_BYTES", 3000), ("SHARD_BYTES", 2000), ("SORT_BYTES", 3000), ("KEPT_ANCHORS", 50)):
        monkeypatch.setattr(substrings, name, value)
    r = random.Random(8)
    pool = ["".join(r.choice("abé ") for _ in range(r.randint(30, 120))) for _ in range(12)]
    rows = [(r.randrange(60), "".join(r.choice(pool)[r.randrange(20) :] for _ in range(r.randint(0, 6)))) for _ in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    import hashlib
    from collections import Counter

    want = Counter((i, n, c, s, hashlib.sha256(k).hexdigest()) for i, n, c, s, k in brute(rows, 50))
    assert bag(substrings.dedup(docs, digest=True)) == want
    kept = Counter((i, k.decode(errors="ignore") if c else t) for (i, t), (_, _, c, _, k) in zip(rows, brute(rows, 50), strict=True))
    assert bag(substrings.dedup(docs)) == kept


def test_copies_in_one_batch_with_the_smallest_id_last(spark, monkeypatch):
    """The smallest id of equal texts gives the fragments, so its bucket must get their anchors."""
    monkeypatch.setattr(substrings, "TEXT_BYTES", 300)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = []
    for group in range(40):
        whole, ids = text(200), sorted(r.sample(range(group * 100, group * 100 + 100), 6), reverse=True)
        copies, sharer = (ids[1:], ids[0]) if group % 2 else (ids[:-1], ids[-1])
        rows += [*((i, whole) for i in copies), (sharer, text(40) + whole[70:150] + text(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    import hashlib
    from collections import Counter

    want = Counter((i, n, c, s, hashlib.sha256(k).hexdigest()) for i, n, c, s, k in brute(rows, 50))
    assert sum(c > 0 for (_, _, c, _, _) in want) > 160
    assert bag(substrings.dedup(docs, digest=True)) == want


def test_regular_texts_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 take the two Thue-Morse words of 2,048 letters for one."""
    import hashlib
    from collections import Counter

    x, y = ("".join(letters[bin(k).count("1") % 2] for k in range(2048)) for letters in ("ab", "ba"))
    rows = [(1, x), (2, y), (3, f"{x}{y}"), (4, f"q{x}"), (5, f"{y}r"), (None, x), (6, "=" * 5000), (7, "=" * 300 + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = Counter((i, n, c, s, hashlib.sha256(k).hexdigest()) for i, n, c, s, k in brute(rows, 50))
    assert bag(substrings.dedup(docs, digest=True)) == want


def test_ranges_are_compared_by_their_bytes():
    data = np.frombuffer(b"abcdefghijabcdefghijabcdefghiXabcdefgh1abcdefgh2", np.uint8)
    begins, sizes = np.array([0, 10, 20, 30, 39]), np.array([10, 10, 10, 9, 9])
    assert substrings._as_before(data, begins, sizes, np.array([False, True, True, False, True])).tolist() == [False, True, False, False, False]


def test_a_passage_of_all_documents_is_combined_before_its_shuffles():
    """Of its anchors two documents a pack go on, and each bucket sends its bytes once."""
    import pyarrow as pa

    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage, n = text(300), 400
    texts = pa.table({"doc_id": list(range(n)), "text": [text(60) + passage + text(60) for _ in range(n)]})
    batches = texts.to_batches(max_chunksize=100)
    packs = list(substrings._anchor_rows(1, 5, 50, 20)(iter(batches)))
    rows = [row for pack in packs for row in pack.to_pylist()]
    pairs = [x for row in rows if row["bucket"] is None for x in packed.unpack(row["keys"], row["n"]).tolist()]
    told = {row["bucket"]: set(packed.unpack_rising(row["keys"], row["n"]).tolist()) for row in rows if row["bucket"] is not None}
    inside = set.intersection(*told.values())  # the passage's own anchors
    assert len(inside) >= 10 and all(pairs.count(key) == 2 * len(packs) for key in inside)
    notes = substrings._repeated(5)(pa.Table.from_pylist(rows, pa.schema(substrings.ANCHORS)))
    own = texts.filter(pa.array([i % 5 == 2 for i in range(n)]))
    sent = substrings._fragments(1, 50, 20, "doc_id", "text")((pa.scalar(2),), own, notes.filter(pa.array([b == 2 for b in notes.column("_bucket").to_pylist()])))
    keys = [x for row in sent.to_pylist() for x in packed.unpack(row["keys"], row["n"]).tolist()]
    # The outermost anchors have windows that reach into the texts around the passage.
    assert sum(keys.count(key) == 1 for key in inside) > len(inside) // 2
