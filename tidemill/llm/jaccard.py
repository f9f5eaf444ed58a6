"""Exact Jaccard join on word shingles with a count-vector R-tree.

A document is the set of its distinct shingles: runs of ``size`` words, or all its words
if it has fewer but any. Two documents link if 100 * intersection >= percent * union.
A shingle is known by 128 bits made from those of its words, which differ for different words (``scan.digests``).

1. Documents with one set are one class; its smallest id stands for it.
2. Candidates. Sets in one size band (or in neighbouring bands) are dealt to G groups
   by shingle hash. A linked pair differs in at most ``differ`` shingles, so with G =
   differ + 1 + slack groups at least 1 + slack groups hold the same shingles in both.
   A class gives a key per filled group (and per empty one if it has more than slack of
   them), so every linked pair shares a key. Keys that one set has alone are dropped. Sets of
   a key become neighbours only if their short count vectors, sent to the keys that are
   left, let them link; so sets that share a key by chance don't chain. Only of a key
   with more than ``KEY_SETS`` sets all are neighbours; such a key is combined in each task
   before the shuffle.
3. Neighbours make candidate clusters. Small clusters are dealt to bins. Those of more than a
   chunk are parted once more by full count vectors, and what is still large is cut to
   chunks, by bands of size, and each pair of chunks goes to one task.
4. A task indexes group counts of its sets as points of an R-tree. The overlap with
   anything below a node is at most the sum of minima of the coordinates of the set and of
   the node's maxima. Pairs that survive are verified. Pairs that are in one component
   already are passed over: no link between them changes a component.
5. Components of the links found.

Where the ids that documents are filtered by are more than ``skew.BROADCAST_IDS``, they
are joined by shuffle instead of broadcast.

No pair is lost, whatever its cluster's size, and no task holds more than a chunk pair.
A cluster of n sets whose count vectors let them link, but which do not, costs up to
(n / chunk) ** 2 tasks.

Defined results: a null text counts as empty; a document without words has no shingles and
links with nothing; rows with a null id link with nothing and have no component; rows of
one id are one document, linked by their id; an empty table gives no rows; other columns
are kept by ``representatives`` and ignored by ``join``, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import graph, packed, scan, skew

SIZE, PERCENT = 5, 80
DIMENSIONS, MOST_DIMENSIONS, PER_GROUP, FANOUT = 64, 4096, 8, 16
#: Most sets, and about the most shingles, of one side of a task; sets of small clusters in a bin.
CHUNK_SETS, CHUNK_SHINGLES, BIN_SETS = 2_000, 1 << 22, 500
#: (key, set) pairs behind each part of the keys, most parts, and bytes of text taken for one shingle.
PART_KEYS, MOST_PARTS, SHINGLE_BYTES = 1 << 18, 1 << 18, 6
#: (key, set) pairs that ask for count vectors, behind each group of vectors.
GROUP_PAIRS = 1 << 19
#: Least and most pairs that a task packs at once; in between, as many as fill rows of 16 pairs.
PACK_KEYS, MOST_PACK_KEYS = 1 << 18, 1 << 22
#: Most sets of a key that are compared by their short count vectors.
KEY_SETS = 1_000
SETS = [("doc_id", pa.int64()), ("n", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64())]
PAIRS = [("_part", pa.int32()), ("pairs", pa.int64()), ("nodes", pa.int64()), *((x, pa.binary()) for x in ("key", "node", "per_node", "edge_a", "edge_b"))]
WANTED = [("_group", pa.int32()), ("_part", pa.int32()), ("nodes", pa.int64()), ("node", pa.binary())]
VECTORS = [*WANTED[1:], ("size", pa.binary()), ("vector", pa.binary())]
SCANNED = [*SETS, ("vector", pa.binary()), *PAIRS]
NODE_BITS = np.uint64((1 << 62) - 1)
EDGES = [("a", pa.int64()), ("b", pa.int64())]
WORDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def shape(fields) -> str:
    return ", ".join(f"{name} {WORDS[kind]}" for name, kind in fields)


def bands(percent: int, largest: int) -> np.ndarray:
    """Smallest sizes of the bands: linked sets are in one band or in neighbouring ones."""
    found = [1]
    while found[-1] <= largest:
        found.append(found[-1] * 100 // percent + 1)
    return np.array(found)


def groups(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups, slack) of each band, for pairs whose smaller set is in the band; one group: equal sets only."""
    top = bands(percent, largest)[1:] - 1
    differ = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    slack = 2 + differ // 12
    return np.where(differ, differ + 1 + slack, 1), slack


def shingles(data: np.ndarray, offs: np.ndarray, size: int):
    """(hashes, other halves of them, firsts): the distinct shingles of each text, in order of hash."""
    low = scan.LOWER[data]
    starts, ends, firsts = scan.words(low, offs, scan.NOT_SPACE)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    lanes = []
    for words in scan.digests(low, starts, ends):
        at, hashes = scan.windows(words, firsts, size)
        lanes.append(np.concatenate([hashes, scan.span(scan.prefix(words), firsts[short], firsts[short + 1])]))
    text = np.concatenate([np.searchsorted(firsts, at, side="right") - 1, short])
    hashes, others = lanes
    order = np.lexsort((others, hashes, text))
    hashes, others, text = hashes[order], others[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]) | (others[1:] != others[:-1])
    return hashes[new], others[new], np.searchsorted(text[new], np.arange(len(offs)))


def summed(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def keys_of(hashes: np.ndarray, firsts: np.ndarray, percent: int):
    """(keys, firsts): the group keys of each set."""
    sizes = np.diff(firsts)
    none = np.zeros(0, np.uint64), np.zeros(len(firsts), np.int64)
    if not len(hashes):
        return none
    largest = int(sizes.max())
    lows = bands(percent, largest)
    count, slack = groups(percent, largest)
    band = np.searchsorted(lows, sizes, side="right") - 1
    mixed = scan.mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    owner = scan.owner(firsts)
    found, owners = [], []
    for block in (band, band - 1):
        valid = (sizes > 0) & (block >= 0)
        parts = np.where(valid, count[np.maximum(block, 0)], 0)
        parts[parts == 1] = 0
        if not parts.any():
            continue
        base = np.concatenate([[0], np.cumsum(parts)])
        use = parts[owner] > 0
        text = owner[use]
        spot = base[text] + ((mixed[use] >> np.uint64(32)) * parts[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, spot, mixed[use])
        filled = np.bincount(spot, minlength=base[-1]) > 0
        group_owner = np.repeat(np.arange(len(sizes)), parts)
        empty = parts - np.bincount(group_owner[filled], minlength=len(sizes))
        emit = filled | (empty > slack[np.maximum(block, 0)])[group_owner]
        index = np.arange(base[-1]) - base[group_owner]
        salt = scan.mix((block[group_owner].astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64) + np.uint64(1))
        found.append(scan.mix(content ^ salt)[emit])
        owners.append(group_owner[emit])
    if not found:
        return none
    keys, text = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(text, kind="stable")
    return keys[order], np.searchsorted(text[order], np.arange(len(firsts)))


def prints(hashes: np.ndarray, others: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set."""
    return summed(scan.mix(hashes + np.uint64(1)), firsts), summed(scan.mix(others ^ np.uint64(0xE7037ED1A0B428DB)), firsts)


def short_vectors(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Counts of ``DIMENSIONS`` groups, cut off at 255, of each set."""
    spot = scan.owner(firsts) * DIMENSIONS + ((hashes >> np.uint64(17)) % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.minimum(np.bincount(spot, minlength=(len(firsts) - 1) * DIMENSIONS), 255).astype(np.uint8).reshape(-1, DIMENSIONS)


def _rows(fields, columns: dict, count: int) -> pa.RecordBatch:
    """A batch of all fields, null where there is no column."""
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(count, kind) for name, kind in fields], names=[name for name, _ in fields])


class Keys:
    """Gathers the keys of sets and packs them by part. A node is the first fingerprint of a set, cut to
    62 bits: copies are one node."""

    def __init__(self, percent: int, parts: int):
        self.percent, self.parts = percent, parts
        self.most = max(PACK_KEYS, min(16 * parts, MOST_PACK_KEYS))
        self.key, self.node, self.count = [], [], 0

    def add(self, hashes, firsts, print_a) -> None:
        key, key_firsts = keys_of(hashes, firsts, self.percent)
        self.key.append(key)
        self.node.append(np.repeat((print_a & NODE_BITS).astype(np.int64), np.diff(key_firsts)))
        self.count += len(key)

    def flush(self) -> pa.RecordBatch:
        key, node = np.concatenate(self.key), np.concatenate(self.node)
        self.__init__(self.percent, self.parts)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        # Keys of very many sets go on with the smallest of them; the others are its neighbours.
        begins, ends = packed.runs(key)
        many = np.repeat(ends - begins > KEY_SETS, ends - begins)
        head = np.zeros(len(key), bool)
        head[begins] = True
        gone = many & ~head
        edges = graph.local_stars(node[gone], np.repeat(node[begins], ends - begins)[gone])
        rows = _packed(key[~gone], node[~gone], (many & head)[~gone], packed.scaled(key[~gone], self.parts))
        if len(edges[0]):
            rows.append((int(edges[1][0]) % self.parts, len(edges[0]), 0, None, None, None, *map(packed.pack, edges)))
        columns = dict(zip([name for name, _ in PAIRS], zip(*rows, strict=True), strict=True))
        return _rows(SCANNED, columns, len(rows))


def _packed(key: np.ndarray, node: np.ndarray, crowded: np.ndarray, part: np.ndarray) -> list[tuple]:
    """A row of PAIRS for each part."""
    order = np.lexsort((key, node, part))
    key, node, crowded, part = key[order], node[order], crowded[order], part[order]
    rows = []
    for a, b in zip(*packed.runs(part), strict=True):
        starts, stops = packed.runs(node[a:b])
        keys = packed.pack(key[a:b]) + np.packbits(crowded[a:b]).tobytes()
        rows.append((int(part[a]), int(b - a), len(starts), keys, packed.pack_rising(node[a:b][starts]), packed.pack(stops - starts), None, None))
    return rows


def _unpacked(rows: list[dict]):
    """(keys, nodes, crowded) of rows of PAIRS."""
    found = []
    for r in rows:
        n, m = r["pairs"], r["nodes"]
        cut = len(r["key"]) - (n + 7) // 8
        crowded = np.unpackbits(np.frombuffer(r["key"][cut:], np.uint8), count=n).astype(bool)
        found.append((packed.unpack(r["key"][:cut], n), np.repeat(packed.unpack_rising(r["node"], m), packed.unpack(r["per_node"], m)), crowded))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shared(table: pa.Table) -> pa.Table:
    """The keys of a part that several sets have, and the edges."""
    rows = table.to_pylist()
    key, node, crowded = _unpacked([r for r in rows if r["nodes"]])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    crowded = np.logical_or.reduceat(crowded[order], np.flatnonzero(new)) if len(key) else crowded
    key, node = key[new], node[new]
    begins, ends = packed.runs(key)
    keep = np.repeat(ends - begins > 1, ends - begins)
    part = rows[0]["_part"]
    found = _packed(key[keep], node[keep], crowded[keep], np.full(int(keep.sum()), part))
    found += [tuple(r.values()) for r in rows if not r["nodes"]]
    scan.give_back()
    return pa.Table.from_batches([packed.batch(PAIRS, found)])


def _wanted(groups: int):
    """The nodes whose count vectors a part needs, packed by group of nodes."""

    def wanted(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["nodes"]:
                    node = packed.unpack_rising(r["node"], r["nodes"])
                    group = _group_of(node, groups)
                    order = np.argsort(group, kind="stable")
                    group, node = group[order], node[order]
                    yield packed.batch(WANTED, [(group[a], r["_part"], b - a, packed.pack_rising(node[a:b])) for a, b in zip(*packed.runs(group), strict=True)])

    return wanted


def _group_of(node: np.ndarray, groups: int) -> np.ndarray:
    return packed.scaled(scan.mix(node.view(np.uint64)), groups)


def _grouped(groups: int):
    def grouped(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_group_of(batch.column(0).to_numpy(), groups), pa.int32()), *batch.columns], names=["_group", "node", "n", "vector"])

    return grouped


def _sent(wanted: pa.Table, vectors: pa.Table) -> pa.Table:
    """The sizes and count vectors of a group's nodes for each part that wants them."""
    known, size, vector = _nodes(*_table_vectors(vectors))
    rows = []
    for r in wanted.to_pylist():
        spot = np.searchsorted(known, packed.unpack_rising(r["node"], r["nodes"]))
        rows.append((r["_part"], r["nodes"], r["node"], packed.pack(size[spot]), vector[spot].T.tobytes()))
    return pa.Table.from_batches([packed.batch(VECTORS, rows)])


def _table_vectors(vectors: pa.Table):
    vector = np.frombuffer(b"".join(vectors.column("vector").to_pylist()), np.uint8).reshape(-1, DIMENSIONS)
    return vectors.column("node").to_numpy(), vectors.column("n").to_numpy(), vector


def _nodes(node: np.ndarray, size: np.ndarray, vector: np.ndarray):
    """Distinct nodes, rising; of several sets of one node the smallest size and the largest counts,
    which bound the overlap with each of them."""
    order = np.argsort(node, kind="stable")
    begins, _ = packed.runs(node[order])
    if not len(begins):
        return node, size, vector
    return node[order][begins], np.minimum.reduceat(size[order], begins), np.maximum.reduceat(vector[order], begins, axis=0)


def _scanned(size: int, percent: int, parts: int):
    """One row per document (its set's size and fingerprints), and packed keys of the sets."""

    def scanned(batches):
        keys = Keys(percent, parts)
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offs in scan.chunks(batch.column(1)):
                hashes, others, firsts = shingles(data, offs, size)
                a, b = prints(hashes, others, firsts)
                vectors = [x.tobytes() for x in short_vectors(hashes, firsts)]
                own = ids.slice(first, end - first)
                yield _rows(SCANNED, {"doc_id": own, "n": np.diff(firsts), "print_a": a.view(np.int64), "print_b": b.view(np.int64), "vector": vectors}, end - first)
                keys.add(hashes, firsts, a)
                if keys.count >= keys.most:
                    yield keys.flush()
        if keys.count:
            yield keys.flush()
        scan.give_back()

    return scanned


def may_link(vector, size, left, right, percent: int) -> np.ndarray:
    """Whether the count vectors let pairs of sets link; counts that were cut off let any."""
    found = np.zeros(len(left), bool)
    for k in range(0, len(left), 1 << 16):
        a, b = left[k : k + (1 << 16)], right[k : k + (1 << 16)]
        least = np.minimum(vector[a], vector[b])
        enough = least.sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * (size[a] + size[b])
        found[k : k + (1 << 16)] = enough | (least == 255).any(axis=1)
    return found


def neighbours(key, node, crowded, size, vector, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all sets which share a key and may link. ``key`` rises; ``node`` numbers the
    rows of ``size`` and ``vector``. All sets of a crowded key are joined."""
    begins, ends = packed.runs(key)
    count = ends - begins
    crowd = (np.logical_or.reduceat(crowded, begins) if len(begins) else np.zeros(0, bool)) | (count > KEY_SETS)
    heads = node[begins]
    tail = np.ones(len(key), bool)
    tail[begins] = False
    run = np.repeat(np.arange(len(begins)), count)[tail]
    low, high = heads[run], node[tail]
    joined = crowd[run]
    pairs, back = np.unique(low * len(size) + high, return_inverse=True)
    fits = may_link(vector, size, pairs // len(size), pairs % len(size), percent)[back] | joined
    found_a, found_b = [low[fits]], [high[fits]]
    # Sets that don't fit their key's first one are compared with those others of the key that are not in
    # their component yet.
    failed = np.flatnonzero(~fits & (count[run] > 2))
    label = np.arange(len(size))
    members, least = graph.local_stars(np.concatenate(found_b), np.concatenate(found_a))
    label[members] = least
    parent = {}

    def root(x):
        while x in parent:
            x = parent[x]
        return x

    seen = set()
    for a, b in zip(*packed.runs(run[failed]), strict=True):
        r = run[failed[a]]
        own = node[begins[r] : ends[r]]
        if (name := own.tobytes()) in seen:
            continue
        seen.add(name)
        kind = np.array([root(x) for x in label[own].tolist()])
        if (kind == kind[0]).all():
            continue
        for one in high[failed[a:b]].tolist():
            same = root(int(label[one]))
            rest = np.flatnonzero(kind != same)
            rest = rest[may_link(vector, size, np.full(len(rest), one), own[rest], percent)]
            for other, k in zip(*(x.tolist() for x in np.unique(kind[rest], return_index=True)), strict=True):
                found_a.append(np.array([one]))
                found_b.append(own[rest[k]][None])
                parent[other] = same
                kind[kind == other] = same
    return np.concatenate(found_a), np.concatenate(found_b)


def _stars(percent: int):
    def stars(part: tuple, pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        """Components within a part of the keys: each node, with the smallest node of its component."""
        rows = pairs.to_pylist()
        edges = [r for r in rows if not r["nodes"]]
        a, b = ([packed.unpack(r[x], r["pairs"]) for r in edges] for x in ("edge_a", "edge_b"))
        key, node, crowded = _unpacked([r for r in rows if r["nodes"]])
        if len(key):
            sent = vectors.to_pylist()
            known, size, vector = _nodes(
                np.concatenate([packed.unpack_rising(r["node"], r["nodes"]) for r in sent]),
                np.concatenate([packed.unpack(r["size"], r["nodes"]) for r in sent]),
                np.concatenate([np.frombuffer(r["vector"], np.uint8).reshape(DIMENSIONS, -1).T for r in sent]),
            )
            order = np.lexsort((node, key))
            x, y = neighbours(key[order], np.searchsorted(known, node[order]), crowded[order], size, vector, percent)
            a.append(known[x])
            b.append(known[y])
        a, b = graph.local_stars(*(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b)))
        scan.give_back()
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return stars


def dimensions(size: int) -> int:
    """Groups of a count vector: so many that a set of this size has ``PER_GROUP`` shingles in each, as
    counts of unrelated sets then differ by enough for the bound to tell."""
    groups = DIMENSIONS
    while groups * PER_GROUP < size and groups < MOST_DIMENSIONS:
        groups *= 2
    return groups


def count_vector(members: np.ndarray, groups: int) -> np.ndarray:
    return np.minimum(np.bincount((members >> np.uint64(17)) % np.uint64(groups), minlength=groups), 65_535).astype(np.uint16)


class CountTree:
    """R-tree over count vectors, packed in order of size; a node keeps its coordinates' maxima."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.counts = counts[self.order]
        self.most = int(self.counts.max(initial=0))
        if self.most < 256:
            self.counts = self.counts.astype(np.uint8)
        self.maxima = np.maximum.reduceat(self.counts, np.arange(0, len(sizes), FANOUT), axis=0)

    def after(self, row: int, percent: int) -> np.ndarray:
        """Rows after ``row`` whose overlap with it may suffice."""
        size, count = int(self.sizes[row]), self.counts[row]
        end = int(np.searchsorted(self.sizes, size * 100 // percent, side="right"))
        first, last = (row + 1) // FANOUT, -(-end // FANOUT)
        # The overlap must be percent * (size + other) / (100 + percent) at least; a node's smallest is its first.
        lows = np.maximum(self.sizes[np.arange(first, last) * FANOUT], size)
        bound = np.minimum(self.maxima[first:last], count).sum(axis=1, dtype=np.int64)
        nodes = np.flatnonzero(self._enough(bound, size, lows, percent)) + first
        rows = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        rows = rows[(rows > row) & (rows < end)]
        full = len(rows) == end - row - 1
        bound = np.minimum(self.counts[row + 1 : end] if full else self.counts[rows], count).sum(axis=1, dtype=np.int64)
        return rows[self._enough(bound, size, self.sizes[rows], percent)]

    def _enough(self, bound, size, other, percent: int):
        if self.most == 65_535:  # counts were cut off
            return np.ones(len(bound), bool)
        return bound * (100 + percent) >= percent * (size + other)


def bound_links(counts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, percent: int, side: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a cluster whose bound suffices, as many as join their components; where both sides occur, only
    pairs between them."""
    _, label = np.unique(nodes, return_inverse=True)
    tree = CountTree(counts, sizes)
    label, side, nodes = label[tree.order], side[tree.order], nodes[tree.order]
    between = side.any() and not side.all()
    found = []
    for k in range(len(sizes)):
        near = tree.after(k, percent)
        near = near[(label[near] != label[k]) & ((side[near] != side[k]) if between else True)]
        for one in near[np.unique(label[near], return_index=True)[1]].tolist():
            found.append((int(nodes[k]), int(nodes[one])))
            label[label == label[one]] = label[k]
    return found


def links(sets: list[np.ndarray], nodes: np.ndarray, percent: int, left: np.ndarray | None = None, cluster: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the components of the sets; with ``left``, only between its two sides matter,
    so links inside a side may be left out. Sets of different clusters are not compared."""
    _, label = np.unique(nodes, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    groups = dimensions(int(np.median(sizes)))
    tree = CountTree(np.array([count_vector(x, groups) for x in sets]), sizes)
    label = label[tree.order]
    side = None if left is None else left[tree.order]
    kind = None if cluster is None else cluster[tree.order]
    found = []
    for k in range(len(sets)):
        near = tree.after(k, percent)
        near = near[label[near] != label[k]]
        if side is not None:
            near = near[side[near] != side[k]]
        if kind is not None:
            near = near[kind[near] == kind[k]]
        own = sets[tree.order[k]]
        while len(near):
            other, near = int(near[0]), near[1:]
            large = sets[tree.order[other]]
            spot = np.minimum(np.searchsorted(large, own), len(large) - 1)
            common = int(np.count_nonzero(large[spot] == own))
            if 100 * common >= percent * (len(own) + len(large) - common):
                found.append((int(nodes[tree.order[k]]), int(nodes[tree.order[other]])))
                label[label == label[other]] = label[k]
                near = near[label[near] != label[k]]
    return found


def _counted(size: int):
    """Size and count vector of each document's set."""

    def counted(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offs in scan.chunks(batch.column(1)):
                hashes, _, firsts = shingles(data, offs, size)
                sizes = np.diff(firsts)
                blobs = [count_vector(hashes[a:b], dimensions(int(b - a))).tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "counts"])

    return counted


def _bounded(percent: int):
    """Components of the pairs in a task whose bound suffices. A pair is looked at where the smaller
    set's band is, with vectors folded to that band's groups."""

    def bounded(table: pa.Table) -> pa.Table:
        nodes, sizes, side = (table.column(c).to_numpy() for c in ("doc_id", "n", "side"))
        vectors = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("counts")]
        lows = bands(percent, int(sizes.max()))
        band = np.searchsorted(lows, sizes, side="right") - 1
        across = side.any() and not side.all()
        found = []
        for b in np.unique(band).tolist():
            rows = np.flatnonzero((band == b) | (band == b + 1))
            if across and (side[rows] == side[rows[0]]).all():
                continue
            groups = dimensions(int(lows[b]))
            counts = np.array([np.minimum(vectors[k].reshape(-1, groups).sum(axis=0, dtype=np.int64), 65_535) for k in rows.tolist()]).astype(np.uint16)
            found += bound_links(counts, sizes[rows], nodes[rows], percent, side[rows])
        pairs = np.array(found, np.int64).reshape(-1, 2)
        a, b = graph.local_stars(pairs[:, 0], pairs[:, 1])
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return bounded


def _members(size: int):
    """The shingle sets themselves."""

    def members(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offs in scan.chunks(batch.column(1)):
                hashes, _, firsts = shingles(data, offs, size)
                raw, at = hashes.tobytes(), (firsts * 8).tolist()
                blobs = pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), pa.array(np.diff(firsts), pa.int64()), blobs], names=["doc_id", "n", "members"])

    return members


def _verified(percent: int):
    def verified(table: pa.Table) -> pa.Table:
        nodes = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]
        side = table.column("side").to_numpy()
        # Equal sides on all rows: a bin of whole clusters, or a chunk against itself.
        left = None if (side == side[0]).all() else side
        found = np.array(links(sets, nodes, percent, left, table.column("root").to_numpy()), np.int64).reshape(-1, 2)
        a, b = graph.local_stars(found[:, 0], found[:, 1])
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return verified


def _weighed(clustered: DataFrame) -> DataFrame:
    """(root, sets, weight) of each cluster, in the shared folder."""
    return graph.cut_lineage(clustered.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("weight")))


def _tasks(clustered: DataFrame, weighed: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, root, task, side): the tasks that each class of a cluster takes part in.

    Small clusters are dealt to bins. A class of a large cluster is in chunk (band, part); chunks
    meet those of their own band and of the next one."""
    small = (F.col("sets") <= CHUNK_SETS) & (F.col("weight") <= CHUNK_SHINGLES)
    sums = weighed.where(small).agg(F.sum("sets").alias("sets"), F.sum("weight").alias("weight")).first()
    bins = 1 + max((sums["sets"] or 0) // BIN_SETS, 4 * (sums["weight"] or 0) // CHUNK_SHINGLES)
    rows = clustered.join(weighed.hint("merge"), "root")
    task = F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins)))
    binned = rows.where(small).select("doc_id", "n", "root", task.alias("task"), F.lit(0).alias("side"))
    if weighed.where(~small).isEmpty():
        return binned

    rows = rows.where(~small).drop("sets", "weight")
    largest = rows.agg(F.max("n")).first()[0]
    lows = bands(percent, int(largest)).tolist()
    band = F.array_position(F.transform(F.array(*[F.lit(x) for x in lows]), lambda x: x > F.col("n")), True) - 1
    rows = rows.withColumn("band", F.when(band > 0, band).otherwise(len(lows)).cast("int"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    by_band = rows.groupBy("root", "band").agg(parts.alias("parts"))
    # A cluster has one row per band here, and there are few bands; large clusters are few as well.
    whole = by_band.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts_of"))
    b = F.col("band")
    of = lambda x: F.coalesce(F.try_element_at("parts_of", x.cast("int")), F.lit(0))
    rows = rows.join(whole.hint("merge"), "root").withColumn("parts", of(b)).withColumn("up", of(b + 1)).withColumn("down", of(b - 1))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    name = lambda a, b, c, d: F.concat_ws("/", "root", a, b, c, d)
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(to(F.col("parts")), lambda x: F.struct(name(b, F.least(x, F.col("part")), b, F.greatest(x, F.col("part"))).alias("task"), F.when(x < F.col("part"), 1).otherwise(0).alias("side")))
    higher = F.transform(to(F.col("up")), lambda x: F.struct(name(b, F.col("part"), b + 1, x).alias("task"), F.lit(0).alias("side")))
    lower = F.transform(to(F.col("down")), lambda x: F.struct(name(b - 1, x, b, F.col("part")).alias("task"), F.lit(1).alias("side")))
    rows = rows.withColumn("part", part.cast("int")).withColumn("tasks", F.concat(own, higher, lower))
    return binned.unionByName(rows.select("doc_id", "n", "root", F.explode("tasks").alias("t")).select("doc_id", "n", "root", "t.task", "t.side"))


def _of(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """The texts of the entries' ids."""
    wanted = skew.sized(entries.select(F.col("doc_id").alias("wanted_id")).distinct())
    return texts.join(wanted, F.col("doc_id") == F.col("wanted_id"), "left_semi")


def _rooted(stars: DataFrame) -> DataFrame:
    """(node, root) of every node of a graph's components, the roots among them."""
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


def _parted(texts: DataFrame, entries: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, root, n) of ``entries``, with the clusters of more than a chunk parted by full count vectors."""
    weighed = _weighed(entries)
    large = weighed.where((F.col("sets") > CHUNK_SETS) | (F.col("weight") > CHUNK_SHINGLES))
    if large.isEmpty():
        return entries
    roots = F.broadcast(large.select("root"))  # each stands for more than a chunk
    rest, large = entries.join(roots, "root", "left_anti"), graph.cut_lineage(entries.join(roots, "root", "left_semi"))
    counted = _of(texts, large).mapInArrow(_counted(size), "doc_id long, n long, counts binary").where("n > 0")
    dealt = counted.join(_tasks(large, weighed, percent).hint("merge"), ["doc_id", "n"])
    near = graph.components(dealt.groupBy("task").applyInArrow(_bounded(percent), shape(EDGES)))
    parted = large.select("doc_id", "n").join(_rooted(near).hint("merge"), F.col("doc_id") == F.col("node"))
    return graph.cut_lineage(rest.select("doc_id", "root", "n").unionByName(parted.select("doc_id", "root", "n").distinct()))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    scan.small_batches(docs.sparkSession)
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = total // SHINGLE_BYTES * 2 * (100 - percent) // percent
    scanned = graph.written(texts.mapInArrow(_scanned(size, percent, min(1 + expected // PART_KEYS, MOST_PARTS)), shape(SCANNED)), "shingles")
    rows = scanned.where("_part is null").select(*[name for name, _ in SETS])

    # Classes: the smallest id of each set. Rows of one id join the classes of their sets.
    named = rows.where("doc_id is not null")
    by_set = ["n", "print_a", "print_b"]
    classed = skew.with_least(named.where("n > 0"), by_set, "doc_id", "least").withColumn("class", F.coalesce("least", "doc_id")).drop("least")
    classed = graph.cut_lineage(classed.unionByName(named.where("n = 0").withColumn("class", F.col("doc_id"))))
    split = classed.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("doc_id", "least")
    same_id = classed.join(split.hint("merge"), "doc_id").select(F.col("class").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()

    # Candidates: clusters of sets that share keys and may link.
    node = F.col("print_a").bitwiseAND(F.lit(int(NODE_BITS)))
    pairs = scanned.where("_part is not null").select(*[name for name, _ in PAIRS])
    shared = graph.written(pairs.groupBy("_part").applyInArrow(_shared, shape(PAIRS)), "keys")
    groups = 1 + (shared.agg(F.sum("nodes")).first()[0] or 0) // GROUP_PAIRS
    vectors = scanned.where("n > 0").select(node.alias("node"), "n", "vector").distinct().mapInArrow(_grouped(groups), "_group int, node long, n long, vector binary")
    wanted = shared.mapInArrow(_wanted(groups), shape(WANTED))
    vectors = wanted.groupBy("_group").cogroup(vectors.groupBy("_group")).applyInArrow(_sent, shape(VECTORS))
    edges = shared.groupBy("_part").cogroup(vectors.groupBy("_part")).applyInArrow(_stars(percent), shape(EDGES))
    clusters = _rooted(graph.components(edges))
    heads = classed.where("class = doc_id and n > 0").select("doc_id", "n", node.alias("node"))
    entries = graph.cut_lineage(heads.join(clusters.hint("merge"), "node").select("doc_id", "root", "n").distinct())

    # Verification, on the sets themselves.
    entries = _parted(texts, entries, size, percent)
    sets = _of(texts, entries).mapInArrow(_members(size), "doc_id long, n long, members binary").where("n > 0")
    dealt = sets.join(_tasks(entries, _weighed(entries), percent).hint("merge"), ["doc_id", "n"])
    found = dealt.groupBy("task").applyInArrow(_verified(percent), shape(EDGES))
    roots = graph.components(found.unionAll(same_id))
    done = classed.join(roots.hint("merge"), F.col("class") == F.col("node"), "left")
    done = done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class").alias("component_id"))
    nameless = rows.where("doc_id is null and n is not null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.unionAll(nameless)


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Rows with a null id stay."""
    joined = join(docs, size, percent).groupBy("doc_id").agg(F.max("component_id").alias("component_id"))
    gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    name = "_key"
    while name in docs.columns:
        name = "_" + name
    keyed = docs.withColumn(name, F.col("doc_id").cast("long"))
    return keyed.join(skew.sized(gone), F.col(name) == F.col("gone_id"), "left_anti").drop(name)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM w
  UNION SELECT edges.b, reach.root FROM reach JOIN edges ON reach.node = edges.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
