"""Exact removal of repeated substrings by sharded suffix arrays.

Every byte goes that lies in a ``LENGTH``-byte string which also starts in a document
of a smaller id. Texts are UTF-8 bytes; strings lie in one document and are judged on
the input.

Windows are dealt to shards so that equal ones meet. The anchor of a window is the
smallest hash of its ``GRAM``-byte grams; equal windows have equal anchors. Neighbouring
windows with one anchor make a fragment.

1. Anchors, packed, are dealt by hash. Those found in one document only are dropped. An anchor that a
   task finds in several documents is known to be kept: buckets are told of it at once, and only two
   of its documents go on, for what other tasks have.
2. Texts meet the other anchors, bucket by bucket, and give the fragments, dealt by anchor. Equal
   fragments of a bucket go as one, with their smallest and largest document id.
3. A shard joins its distinct fragments to one text, sorts its suffixes by induced sorting
   (``suffix``) and takes the permuted common prefixes. Windows whose prefixes reach
   ``LENGTH`` form a class with a smallest document id. Each bucket is told, for its distinct
   fragments, runs of windows with their smallest ids.
4. Texts meet anchors and runs, bucket by bucket, and find their fragments again; a document
   loses the windows that have a smaller id than its own.

Copies of an entire text are found by digest (128 bits), aggregated before the shuffle, with
digests of very many rows joined by broadcast: a copy of a smaller id's text goes at once,
whole, and takes no part in the rest; copies in one batch give anchors once, as the smallest id
among them. Fragments count as equal by their bytes. Buckets and shards hold a bounded number of
bytes of text; their count follows the input. A fragment that every document has comes once from
each bucket, and an anchor that every document has a few times from each task. Rows with a null id
are in no bucket.

Defined results: a null text counts as empty; a row with a null id loses nothing and
removes nothing; rows of one id never remove from one another; repeated rows are all
kept; an empty table gives no rows; other columns are kept by ``remove``, whatever
their names. ``remove`` drops the stray bytes of a character that was cut through.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import graph, packed, scan, skew, suffix

LENGTH, GRAM = 50, 20
CHUNK = 1 << 19
#: Bytes of text behind each bucket of anchors, bucket of texts and shard.
ANCHOR_BYTES, TEXT_BYTES, SHARD_BYTES = 8 << 20, 8 << 20, 8 << 20
#: Bytes of distinct fragments that are sorted at once.
SORT_BYTES = 3 << 19
#: Most parts of anchors; least and most anchors that a task packs at once, in between 16 a part.
MOST_PARTS, KEPT_ANCHORS, MOST_KEPT_ANCHORS = 1 << 18, 500_000, 1 << 22
ANCHORS = [("_part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]
NOTES = [("_bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]
FRAGMENTS = [("_shard", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), *((x, pa.binary()) for x in ("docs", "spans", "refs", "sizes", "keys", "text"))]
WORDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
KEYS, COPIES, CUTS = 0, 1, 2
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def shape(fields) -> str:
    return ", ".join(f"{name} {WORDS[kind]}" for name, kind in fields)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(begins, ends, keys): runs of windows, by their first bytes, that share an anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, np.uint64)
    at = np.arange(len(data) - gram + 1)
    hashes = scan.span(scan.prefix(scan._byte_values()[data]), at, at + gram)
    width, reach = length - gram + 1, 1
    low = hashes
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    n = len(data) - length + 1
    low = np.minimum(low[:n], low[width - reach : width - reach + n])
    # A window must end in its text.
    inside = np.zeros(n + 1, np.int8)
    first, last = offs[:-1], offs[1:] - length
    real = last >= first
    np.add.at(inside, first[real], 1)
    np.add.at(inside, last[real] + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    starts = offs[1:-1]
    change[starts[starts < n]] = True
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], n)
    keep = inside[begins]
    # Minima are small numbers; mixed again, they deal out evenly.
    return begins[keep], ends[keep], scan.mix(low[begins[keep]])


def _smallest_of_equal(column, ids: np.ndarray) -> np.ndarray:
    """Of the rows of each distinct text, the one with the smallest id."""
    best: dict[bytes, int] = {}
    for first, end, data, offs in scan.chunks(column, CHUNK):
        raw = memoryview(data)
        for k in range(first, end):
            text = hashlib.blake2b(raw[offs[k - first] : offs[k - first + 1]], digest_size=16).digest()
            if text not in best or ids[k] < ids[best[text]]:
                best[text] = k
    chosen = np.zeros(len(ids), bool)
    chosen[list(best.values())] = True
    return chosen


def _anchor_rows(parts: int, buckets: int, length: int, gram: int):
    """Packed (anchor, document) pairs, each once per batch; of equal texts in a batch the smallest
    document has them, as copies of it take no part in the rest. Rows with a bucket have anchors
    for that bucket instead, which several documents of the task have."""

    def dealt(batches):
        keys, docs, held = [], [], 0
        most = max(KEPT_ANCHORS, min(16 * parts, MOST_KEPT_ANCHORS))

        def flush():
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            begins, ends = packed.runs(key)
            several = np.repeat(doc[begins] != doc[ends - 1], ends - begins)
            rows = [(bucket % parts, bucket, n, own, None) for bucket, n, own in _by_bucket(_short(key[several]), doc[several] % buckets)]
            stay = ~several
            stay[begins] = stay[ends - 1] = True
            key, doc = key[stay], doc[stay]
            part = packed.scaled(key, parts)
            order = np.lexsort((doc, part))
            key, doc, part = _short(key[order]), doc[order], part[order]
            return packed.batch(ANCHORS, rows + [(part[a], None, b - a, packed.pack(key[a:b]), packed.pack_rising(doc[a:b])) for a, b in zip(*packed.runs(part), strict=True)])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = _smallest_of_equal(batch.column(1), ids)
            for first, end, data, offs in scan.chunks(batch.column(1), CHUNK):
                begins, _, key = anchors(data, offs, length, gram)
                text = np.searchsorted(offs, begins, side="right") - 1
                keep = chosen[first:end][text]
                key, text = key[keep], text[keep]
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                keys.append(key[new])
                docs.append(ids[first:end][text[new]])
                held += int(new.sum())
                if held >= most:
                    yield flush()
                    keys, docs, held = [], [], 0
        if held:
            yield flush()

    return dealt


def _short(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64((1 << 48) - 1)).astype(np.int64)


def _by_bucket(key: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """(bucket, count, packed anchors) of the distinct anchors of each bucket."""
    order = np.lexsort((key, bucket))
    key, bucket = key[order], bucket[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    key, bucket = key[new], bucket[new]
    return [(int(bucket[a]), int(b - a), packed.pack_rising(key[a:b])) for a, b in zip(*packed.runs(bucket), strict=True)]


def _repeated(buckets: int):
    """Anchors of a part that two documents have, for each bucket that has such a document, and those
    that were known to be such."""

    def found(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        told = [r for r in rows if r["bucket"] is not None]
        rows = [r for r in rows if r["bucket"] is None]
        keys = [packed.unpack_rising(r["keys"], r["n"]) for r in told]
        places = [np.full(r["n"], r["bucket"], np.int64) for r in told]
        if rows:
            key = np.concatenate([packed.unpack(r["keys"], r["n"]) for r in rows])
            doc = np.concatenate([packed.unpack_rising(r["docs"], r["n"]) for r in rows])
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            begins, ends = packed.runs(key)
            several = np.repeat(np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins), ends - begins)
            keys.append(key[several])
            places.append(doc[several] % buckets)
        out = [(bucket, KEYS, n, own, None, None, None) for bucket, n, own in _by_bucket(np.concatenate(keys), np.concatenate(places))]
        return pa.Table.from_batches([packed.batch(NOTES, out)])

    return found


def _ordered(table: pa.Table, id_name: str, text_name: str):
    """Row numbers in an order that depends on the rows only, ids (null: missing) and texts."""
    table = table.combine_chunks()
    ids = table.column(id_name).cast(pa.int64())
    missing = ids.is_null().to_numpy()
    number = ids.fill_null(0).to_numpy()
    texts = table.column(text_name)
    order = np.argsort(number, kind="stable")
    again = np.zeros(len(number), bool)
    again[order[1:]] = number[order[1:]] == number[order[:-1]]
    if again.any():
        digests = np.array([hashlib.md5((x.as_py() or "").encode()).digest() for x in texts])
        order = np.lexsort((digests, missing, number))
    return order, number[order], missing[order], texts.take(pa.array(order))


def _notes(table: pa.Table, kind: int):
    return [row for row in table.select(["kind", "n", "a", "b", "c", "d"]).to_pylist() if row["kind"] == kind]


def _is_copy(number, missing, texts, notes: pa.Table) -> np.ndarray:
    known = {(int(i), bytes(d)) for row in _notes(notes, COPIES) for i, d in zip(packed.unpack(row["a"], row["n"]), np.frombuffer(row["b"], "V16"), strict=True)}
    if not known:
        return np.zeros(len(number), bool)
    ids = {i for i, _ in known}
    return np.array([not m and i in ids and (i, hashlib.md5((t.as_py() or "").encode()).digest()) in known for i, m, t in zip(number.tolist(), missing.tolist(), texts, strict=True)], bool)


class Fragments:
    """The fragments of a bucket's texts with known anchors, in an order that depends on rows and anchors only.

    ``slot``: the text of each, ``begin``: its place in the bytes of all texts, ``ref``: the number of its
    bytes among the distinct ones, ``heads``: the first of each distinct one."""

    def __init__(self, column, use: np.ndarray, notes: pa.Table, length: int, gram: int):
        keys = np.sort(np.concatenate([packed.unpack_rising(row["a"], row["n"]) for row in _notes(notes, KEYS)]))
        self.data, self.offs = scan.column_bytes(column)
        parts = []
        for first, _, data, offs in scan.chunks(column, CHUNK):
            begins, ends, full = anchors(data, offs, length, gram)
            small = (full & np.uint64((1 << 48) - 1)).astype(np.int64)
            spot = np.minimum(np.searchsorted(keys, small), len(keys) - 1)
            text = np.searchsorted(offs, begins, side="right") - 1
            keep = (keys[spot] == small) & use[first + text]
            begins, sizes = begins[keep], (ends - begins)[keep] + length - 1
            hashes = scan.span(scan.prefix(scan._byte_values()[data]), begins, begins + sizes)
            parts.append((first + text[keep], begins + self.offs[first], sizes, small[keep], full[keep], hashes))
        slot, begin, size, key, full, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((hashes, size, key))
        self.slot, self.begin, self.size, self.key, self.full, hashes = (x[order] for x in (slot, begin, size, key, full, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (self.key[1:] != self.key[:-1]) | (self.size[1:] != self.size[:-1])
        new |= ~_as_before(self.data, self.begin, self.size, ~new)
        self.ref, self.heads = np.cumsum(new) - 1, np.flatnonzero(new)


def _fragments(shards: int, length: int, gram: int, id_name: str, text_name: str):
    def found(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if _notes(notes, KEYS) and len(texts):
            _, number, missing, column = _ordered(texts, id_name, text_name)
            own = Fragments(column, ~(missing | _is_copy(number, missing, column, notes)), notes, length, gram)
            if len(own.heads):
                docs = number[own.slot]
                low, high = np.minimum.reduceat(docs, own.heads), np.maximum.reduceat(docs, own.heads)
                shard = packed.scaled(own.full[own.heads], shards)
                refs = np.argsort(shard, kind="stable")
                shard, heads = shard[refs], own.heads[refs]
                for a, b in zip(*packed.runs(shard), strict=True):
                    at, ref = heads[a:b], refs[a:b]
                    columns = (low[ref], high[ref] - low[ref], ref, own.size[at], own.key[at])
                    rows.append((shard[a], key[0].as_py(), b - a, *map(packed.pack, columns), _gathered(own.data, own.begin[at], own.size[at])))
        scan.give_back()
        return pa.Table.from_batches([packed.batch(FRAGMENTS, rows)])

    return found


def window_minima(data: np.ndarray, offs: np.ndarray, docs: np.ndarray, length: int):
    """For distinct fragments, each with its smallest document: the first window of each
    fragment (and the end), and for every window the smallest document that has it."""
    sizes = np.diff(offs)
    count = len(sizes)
    # One separator after each fragment, smaller than any byte; one smallest symbol at the end.
    spot = np.arange(len(data)) + np.repeat(np.arange(count), sizes)
    plain = np.zeros(len(data) + count, np.uint8)
    plain[spot] = data
    text = np.ones(len(plain) + 1, np.uint16)
    text[spot] = data + np.uint16(2)
    text[-1] = 0
    order = suffix.suffix_array(text, length)
    windows = sizes - length + 1
    firsts = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(count), windows)
    starts = np.arange(firsts[-1]) - firsts[owner] + offs[owner] + owner
    same = suffix.permuted_prefix_at_least(plain.tobytes(), order, starts, length)
    which = np.full(len(text), -1, np.int64)
    which[starts] = np.arange(len(starts))
    ranked = which[order]
    ranked = ranked[ranked >= 0]
    begins = np.flatnonzero(~same[ranked])
    low = np.minimum.reduceat(docs[owner[ranked]], begins)
    minima = np.empty(len(starts), np.int64)
    minima[ranked] = np.repeat(low, np.diff(np.append(begins, len(ranked))))
    return firsts, minima


def _cuts(length: int):
    """Runs of windows, with their smallest documents, of the fragments that a shard got from each bucket."""

    def found(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        column = lambda name: np.concatenate([packed.unpack(r[name], r["n"]) for r in rows])
        docs, spans, refs, sizes, keys = map(column, ("docs", "spans", "refs", "sizes", "keys"))
        buckets = np.concatenate([np.full(r["n"], r["bucket"], np.int64) for r in rows])
        data = np.frombuffer(b"".join(r["text"] for r in rows), np.uint8)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        hashes = np.concatenate([scan.span(scan.prefix(scan._byte_values()[data[offs[a] : offs[b]]]), offs[a:b] - offs[a], offs[a + 1 : b + 1] - offs[a]) for a, b in _slices(offs, CHUNK)])
        # Equal fragments, of one anchor, stand together; the first of them has the smallest document.
        order = np.lexsort((docs, hashes, keys))
        tops = (docs + spans)[order]
        docs, refs, sizes, keys, buckets, hashes, offs = docs[order], refs[order], sizes[order], keys[order], buckets[order], hashes[order], offs[:-1][order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])
        new |= ~_as_before(data, offs, sizes, ~new)
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        # Sorted in blocks; all fragments of an anchor are in one.
        load = np.concatenate([[0], np.cumsum(sizes[heads] + 1)])
        key_begins = np.flatnonzero(np.append(True, keys[heads][1:] != keys[heads][:-1]))
        block = load[key_begins] // SORT_BYTES
        tops_of = [*key_begins[np.flatnonzero(np.append(True, block[1:] != block[:-1]))].tolist(), len(heads)]
        pieces = []
        for a, b in zip(tops_of[:-1], tops_of[1:], strict=True):
            head = heads[a:b]
            size = sizes[head]
            own = np.concatenate([[0], np.cumsum(size)])
            spread = np.repeat(offs[head] - own[:-1], size) + np.arange(own[-1])
            firsts, minima = window_minima(data[spread], own, docs[head], length)
            last = heads[b] if b < len(heads) else len(order)
            pieces.append(_runs(group[head[0] : last] - a, tops[head[0] : last], firsts, minima, head[0]))
        row, begin, count, low = (np.concatenate(x) for x in zip(*pieces, strict=True))
        bucket = buckets[row]
        order = np.lexsort((refs[row], bucket))
        row, begin, count, low, bucket = row[order], begin[order], count[order], low[order], bucket[order]
        columns = refs[row], begin, count, low
        out = [(bucket[a], CUTS, b - a, *(packed.pack(x[a:b]) for x in columns)) for a, b in zip(*packed.runs(bucket), strict=True)]
        scan.give_back()
        return pa.Table.from_batches([packed.batch(NOTES, out)])

    return found


def _as_before(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range that is ``asked`` for equal those of the range before, of the same size."""
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    same = asked.copy()
    rest, k = np.flatnonzero(asked), 0
    while len(rest):
        left = sizes[rest] - k
        differ = words[begins[rest] + k] ^ words[begins[rest - 1] + k]
        # Of the last word only the bytes of the range count, which are its lowest.
        differ <<= (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        same[rest[differ != 0]] = False
        rest, k = rest[(differ == 0) & (left > 8)], k + 8
    return same


def _gathered(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bytes of ranges, one after the other."""
    offs, parts = np.concatenate([[0], np.cumsum(sizes)]), []
    for a, b in _slices(offs, CHUNK):
        spread = np.repeat(begins[a:b] - offs[a:b], sizes[a:b]) + np.arange(offs[a], offs[b])
        parts.append(data[spread].tobytes())
    return b"".join(parts)


def _slices(offs: np.ndarray, limit: int):
    first, n = 0, len(offs) - 1
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1))
        yield first, end
        first = end


def _runs(group: np.ndarray, tops: np.ndarray, firsts: np.ndarray, minima: np.ndarray, base: int):
    """(row, first window, windows, smallest document) of the runs of windows of each row's fragment that a document
    smaller than the row's largest has."""
    # Runs of equal minima in each distinct fragment.
    change = np.ones(len(minima), bool)
    change[1:] = minima[1:] != minima[:-1]
    change[firsts[:-1]] = True
    begins = np.flatnonzero(change)
    sizes = np.diff(np.append(begins, len(minima)))
    owned = np.searchsorted(begins, firsts)
    count = np.diff(owned)[group]
    row = np.repeat(np.arange(len(group)), count)
    run = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + owned[group[row]]
    low = minima[begins[run]]
    keep = low < tops[row]
    row, run, low = row[keep], run[keep], low[keep]
    return base + row, begins[run] - firsts[group[row]], sizes[run], low


def _cut_places(own: Fragments, number: np.ndarray, notes: list[dict]):
    """(first byte, windows) of all that is cut from the bytes of a bucket's texts."""
    ref, begin, count, low = (np.concatenate([packed.unpack(r[x], r["n"]) for r in notes]) for x in "abcd")
    first, last = np.searchsorted(own.ref, ref, "left"), np.searchsorted(own.ref, ref, "right")
    cut = np.repeat(np.arange(len(ref)), last - first)
    at = np.arange(len(cut)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[cut]
    gone = low[cut] < number[own.slot[at]]
    cut, at = cut[gone], at[gone]
    return own.begin[at] + begin[cut], count[cut]


def _applied(id_name: str, text_name: str, columns: list[str], kinds: dict, length: int, gram: int, digest: bool):
    def found(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        order, number, missing, column = _ordered(texts, id_name, text_name)
        copy = _is_copy(number, missing, column, notes)
        told = _notes(notes, CUTS)
        begins = counts = np.zeros(0, np.int64)
        if told:
            begins, counts = _cut_places(Fragments(column, ~(missing | copy), notes, length, gram), number, told)
            by_place = np.argsort(begins, kind="stable")
            begins, counts = begins[by_place], counts[by_place]
        kept, stats, base = [], [], 0
        for first, end, data, offs in scan.chunks(column, CHUNK):
            a, b = np.searchsorted(begins, [base, base + len(data)])
            edges = np.zeros(len(data) + 1, np.int64)
            np.add.at(edges, begins[a:b] - base, 1)
            np.add.at(edges, begins[a:b] - base + counts[a:b] + length - 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            base += len(data)
            sizes = np.diff(offs)
            for k in np.flatnonzero(copy[first:end] & (sizes >= length)).tolist():
                gone[offs[k] : offs[k + 1]] = True
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            starts = offs[:-1][sizes > 0]
            rise[starts] = gone[starts]
            removed, spans = scan.tally(gone, offs), scan.tally(rise, offs)
            raw = data.tobytes()
            for k in range(end - first):
                part = raw[offs[k] : offs[k + 1]]
                kept.append(data[offs[k] : offs[k + 1]][~gone[offs[k] : offs[k + 1]]].tobytes() if removed[k] else part)
            stats.append((sizes, removed, spans))
        if digest:
            sizes, removed, spans = (np.concatenate(x) for x in zip(*stats, strict=True)) if stats else [np.zeros(0, np.int64)] * 3
            arrays = [pa.array(number, pa.int64(), mask=missing), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            return pa.Table.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        rows = texts.combine_chunks().take(pa.array(order))
        fresh = [x.decode("utf-8", "ignore") for x in kept]
        if stats:
            removed = np.concatenate([x[1] for x in stats])
            old = column.to_pylist()
            fresh = [new if gone else same for new, gone, same in zip(fresh, removed.tolist(), old, strict=True)]
        arrays = []
        for name in columns:
            if name == text_name:
                arrays.append(pa.array(fresh, kinds[name]))
            elif name == "n_chars" and stats:
                arrays.append(pa.array([len(x or "") if gone else n for x, gone, n in zip(fresh, removed.tolist(), rows.column(name).to_pylist(), strict=True)], rows.column(name).type))
            else:
                arrays.append(rows.column(name))
        return pa.Table.from_arrays(arrays, names=columns)

    return found


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = "_" + name
    return name


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``docs`` with repeated strings cut from their texts; with ``digest`` a summary per row."""
    scan.small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, shards = min(1 + total // ANCHOR_BYTES, MOST_PARTS), 1 + total // SHARD_BYTES
    buckets = packed.prime_from(1 + total // TEXT_BYTES)
    bucket = F.coalesce(F.pmod(F.col("doc_id"), F.lit(buckets)), F.lit(0)).cast("int")

    # Copies of an entire text, by digest.
    digests = texts.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    copies = skew.with_least(graph.written(digests, "digests"), ["digest"], "doc_id", "smallest").where("doc_id > smallest").select(bucket.alias("_bucket"), "doc_id", "digest")

    def noted(table: pa.Table) -> pa.Table:
        ids, found = table.column("doc_id").to_numpy(), b"".join(table.column("digest").to_pylist())
        return pa.Table.from_batches([packed.batch(NOTES, [(table.column("_bucket")[0].as_py(), COPIES, len(ids), packed.pack(ids), found, None, None)])])

    copies = copies.groupBy("_bucket").applyInArrow(noted, shape(NOTES))
    pairs = texts.where("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_anchor_rows(parts, buckets, length, gram), shape(ANCHORS))
    keys = graph.written(pairs.groupBy("_part").applyInArrow(_repeated(buckets), shape(NOTES)), "anchors")

    name = _free("_bucket", docs.columns)
    side = (texts if digest else docs).where("doc_id is not null").withColumn(name, bucket)
    held = side.groupBy(name)
    fragments = held.cogroup(keys.unionAll(copies).groupBy("_bucket")).applyInArrow(_fragments(shards, length, gram, "doc_id", "text"), shape(FRAGMENTS))
    cuts = fragments.groupBy("_shard").applyInArrow(_cuts(length), shape(NOTES))
    columns = [c for c in side.columns if c != name]
    schema = DIGEST if digest else docs.schema
    applied = _applied("doc_id", "text", columns, {"text": pa.string()}, length, gram, digest)
    done = held.cogroup(cuts.unionAll(keys).unionAll(copies).groupBy("_bucket")).applyInArrow(applied, schema)
    nameless = (texts if digest else docs).where("doc_id is null")
    if digest:
        raw = F.coalesce("text", F.lit("")).cast("binary")
        zero = F.lit(0).cast("long")
        nameless = nameless.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(raw).cast("long"), zero, zero, F.sha2(raw, 256))
    return done.unionAll(nameless)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


SQL = f"""
WITH given AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
spots AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS w FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS p FROM given WHERE n >= {LENGTH})),
firsts AS (SELECT w, min(doc_id) AS low, max(doc_id) AS high FROM spots GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {LENGTH})) AS b FROM spots JOIN firsts USING (w) WHERE low < doc_id),
marked AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM gone),
counts AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < b - 1) AS n_spans FROM marked GROUP BY 1),
cut AS (
  SELECT doc_id, list(b) AS gone_bytes FROM gone GROUP BY 1),
bytes AS (
  SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2), '' ORDER BY b) AS kept
  FROM (SELECT doc_id, h, unnest(range(0, n)) AS b FROM given) ANTI JOIN gone USING (doc_id, b) GROUP BY 1)
SELECT given.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM given LEFT JOIN counts USING (doc_id) LEFT JOIN bytes USING (doc_id)
"""
