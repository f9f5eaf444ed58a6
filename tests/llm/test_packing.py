import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import packing


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    found.encode_special_tokens = True
    return found


def test_ids_are_those_of_the_tokenizers_library(spark, small, reference, awkward):
    ours = packing.encoder(packing.default_vocabulary())
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [r[1] or "" for r in awkward] + ["a" * 20_000, " " * 9_000, "\r\n\t  y", "'s 'S don't"]
    for text in texts:
        assert ours.encode_ordinary(text) == reference.encode(text, add_special_tokens=False).ids


def test_pieces(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = packing.pack(docs, packing.default_vocabulary(), ids=True).toPandas()
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = np.array([*reference.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        own = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert np.concatenate(own.ids.to_list()).tolist() == want.tolist()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes())
            assert p.doc_tokens == len(want)
    rows = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, own in rows:
        assert own.offset.to_list() == [0, *np.cumsum(own.length)[:-1]]
    sizes = rows.length.sum()
    assert ((sizes & (sizes - 1)) == 0).all() and sizes.max() <= packing.CAPACITY


def test_special_tokens_in_texts_are_those_of_the_library_as_it_stands(spark, small, awkward):
    library = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    end = "<|endoftext|>"
    texts = [r[1] or "" for r in awkward] + [f"hello {end} world", end, end * 3, f"a{end}b", f" {end}\n\n{end}  x", f"it{end}'s", "<|endoftext|", "<|ENDOFTEXT|>", f"é{end}é", f"<|{end}|>"]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(docs, packing.default_vocabulary(), ids=True).toPandas()
    for doc_id, text in enumerate(texts):
        want = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        own = pieces[pieces.doc_id == doc_id].sort_values("start")
        assert np.concatenate(own.ids.to_list()).tolist() == want.tolist()
        assert (own.doc_tokens == len(want)).all()
        assert [zlib.crc32(want[p.start : p.start + p.length].tobytes()) for p in own.itertuples()] == own.ids_crc32.to_list()


def test_very_long_runs(reference):
    ours, end = packing.Encoder(packing.default_vocabulary()), "<|endoftext|>"
    library = Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))
    blank = " " * 1_200_000
    texts = [blank, f"a{blank}", f"{blank}b", f"x  y{blank}z", f"x{blank}\n", "\n" * 1_200_000 + "q", f"{end}{blank}{end}{blank}1", f"{blank}{end}", f"q{blank}{end} {blank}\u3000 it's"]
    texts += ["\u2003\t" * 600_000 + "!", "\x1c" * 300_000 + " z", "a" * 1_200_000, "!" * 1_200_000]
    for text in texts:
        assert ours.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_placements_are_kept_when_sequences_are_closed():
    """Only sequences of the lowest levels are cut up; all others keep their pieces and are topped up."""
    r = np.random.default_rng(8)
    packer = packing.Packer(64)
    docs = [np.arange(n, dtype=np.uint32) for n in r.integers(1, 64, 90)]
    assert all(len(s) for k, ids in enumerate(docs) for s in packer.add(k, ids))
    placed = [(level, [tuple(p[:2]) + (len(p[2]),) for p in s]) for level, found in enumerate(packer.levels.open) for s in found]
    closed = [[tuple(p[:2]) + (len(p[2]),) for p in s] for s in packer.close()]
    kept = [level for level, s in placed if any(c[: len(s)] == s for c in closed)]
    lost = sorted(level for level, _ in placed)[: len(placed) - len(kept)]
    assert sum(lost) <= sum(64 - level for level in kept) + 64 and len(kept) >= len(placed) // 2
    sizes = [sum(n for *_, n in c) for c in closed]
    assert sum(sizes) == sum(level for level, _ in placed) and sum(n < 64 for n in sizes) <= 6


def test_level_choice_minimises_the_sum_of_squares():
    r = np.random.default_rng(1)
    levels = packing.Levels(32)
    fills: list[int] = []
    for size in r.integers(1, 32, 400).tolist():
        counts = np.bincount(fills, minlength=33)

        def squares(level):
            new = counts.copy()  # noqa: B023
            if level:
                new[level] -= 1
            if level + size < 32:  # noqa: B023
                new[level + size] += 1  # noqa: B023
            return int((new[1:32] ** 2).sum())

        options = [h for h in range(33 - size) if h == 0 or counts[h]]
        sequence = levels.take(size)
        level = sequence[0] if sequence else 0
        assert squares(level) == min(map(squares, options))
        if level:
            fills.remove(level)
        if level + size < 32:
            fills.append(level + size)
            levels.put([level + size], level + size)


def test_bounded_open_sequences_lose_nothing():
    packer = packing.Packer(64, max_open=5)
    r = np.random.default_rng(3)
    docs = [np.arange(n, dtype=np.uint32) for n in r.integers(1, 200, 150)]
    out = [s for k, ids in enumerate(docs) for s in packer.add(k, ids)] + list(packer.close())
    seen = {}
    for sequence in out:
        n = sum(len(p[2]) for p in sequence)
        assert n <= 64 and n & (n - 1) == 0
        for doc, start, ids, total in sequence:
            assert ids.tolist() == list(range(start, start + len(ids))) and total == len(docs[doc])
            seen[doc] = seen.get(doc, 0) + len(ids)
    assert seen == {k: len(ids) for k, ids in enumerate(docs)}


def test_whole_query_against_a_plain_version(spark, small, reference):
    """The same packing by trying every level and counting all squares anew."""
    capacity = 256
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").coalesce(1)
    given = [(r["doc_id"], len(reference.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect()]
    opened: list[list] = []  # [fill, pieces], those put back last behind the others of their level
    done = []
    for doc, n in given:
        done += [[(doc, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
        start, size = n - n % capacity, n % capacity
        if not size:
            continue

        def squares(level):
            counts = [0] * (capacity + 1)
            for fill, _ in opened:
                counts[fill] += 1
            counts[level] -= level > 0
            counts[level + size] += 1  # noqa: B023
            return sum(c * c for c in counts[1:capacity])

        level = min({0, *(fill for fill, _ in opened if fill + size <= capacity)}, key=lambda h: (squares(h), -h))
        own = [0, []]
        if level:
            own = [x for x in opened if x[0] == level][-1]
            opened.remove(own)
        own = [level + size, [*own[1], (doc, start, size)]]
        (done.append(own[1]) if own[0] == capacity else opened.append(own))
    while opened:
        top = [x for x in opened if x[0] == max(f for f, _ in opened)][-1]
        opened.remove(top)
        fill, pieces = top
        while fill < capacity and opened:
            low = [x for x in opened if x[0] == min(f for f, _ in opened)][-1]
            opened.remove(low)
            doc, start, size = low[1].pop()
            cut = min(size, capacity - fill)
            pieces.append((doc, start, cut))
            fill += cut
            if cut < size:
                low[1].append((doc, start + cut, size - cut))
            if low[1]:
                opened.append([low[0] - cut, low[1]])
        if fill == capacity:
            done.append(pieces)
        else:
            rest = [(doc, start + k) for doc, start, size in pieces for k in range(size)]
            for bit in reversed(range(fill.bit_length())):
                if fill >> bit & 1:
                    part, rest = rest[: 1 << bit], rest[1 << bit :]
                    runs = [k for k in range(len(part)) if not k or part[k] != (part[k - 1][0], part[k - 1][1] + 1)]
                    done.append([(*part[a], b - a) for a, b in zip(runs, [*runs[1:], len(part)], strict=True)])
    rows = packing.pack(docs, packing.default_vocabulary(), capacity).toPandas().sort_values(["sequence_id", "offset"])
    found = [[(int(r.doc_id), int(r.start), int(r.length)) for r in own.itertuples()] for _, own in rows.groupby("sequence_id")]
    assert sorted(found) == sorted(done)
