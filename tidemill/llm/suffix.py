"""Suffix arrays by induced sorting, vectorised.

``suffix_array`` classifies suffixes as larger or smaller than the next one, sorts the
substrings between leftmost-smaller positions by inducing, names them, sorts the
string of names in the same way, recursively until all names differ, and induces the whole
order from that.

Inducing has two forms with the same result. ``induce`` passes over the buckets of the
first symbol; a pass over a bucket is a few NumPy operations, however many suffixes it
holds. It serves for the bytes of texts. ``induce_by_runs`` serves for names, of which
there are too many for a pass each, and for texts with long runs of one byte, through which
a bucket is walked one by one: a larger suffix is a run of larger positions down to the next
leftmost-smaller one, whose order is known, so runs are sorted by their few symbols
and the order of what ends them; and a smaller suffix is likewise a run up to the next larger one.

Orders may be asked for up to a depth: suffixes that agree on their first ``depth``
symbols then stand together in any order.
"""

import numpy as np

#: Symbols up to which buckets are passed over, and the longest run of one symbol for that.
BUCKETS, LONGEST_RUN = 1 << 10, 1 << 10


def smaller(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol is the unique smallest."""
    n = len(text)
    found = np.ones(n, bool)
    rises, falls = text[:-1] < text[1:], text[:-1] > text[1:]
    decided = np.where(rises | falls, np.arange(n - 1), n)
    # An equal neighbour has the type of the next position that differs.
    nearest = np.minimum.accumulate(decided[::-1])[::-1]
    found[:-1] = np.append(rises, True)[np.minimum(nearest, n - 1)]
    return found


def _spread(sorted_symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of a run of equal symbols counted up from each symbol's start."""
    first = np.flatnonzero(np.append(True, sorted_symbols[1:] != sorted_symbols[:-1]))
    sizes = np.diff(np.append(first, len(sorted_symbols)))
    return np.arange(len(sorted_symbols)) - np.repeat(first, sizes) + starts[sorted_symbols]


def induce(text: np.ndarray, is_smaller: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """The order that the given order of leftmost-smaller suffixes induces."""
    n = len(text)
    counts = np.bincount(text, minlength=symbols)
    tails = np.cumsum(counts)
    heads = tails - counts
    array = np.empty(n, np.int64)

    by_symbol = leftmost[np.argsort(text[leftmost], kind="stable")]
    marks = np.bincount(text[leftmost], minlength=symbols)
    mark_ends = np.cumsum(marks)

    # Larger suffixes, from the smallest bucket up: those found so far give their left neighbours.
    place = heads.copy()

    def put_larger(block):
        before = block[block > 0] - 1
        before = before[~is_smaller[before]]
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            symbol = symbol[order]
            array[_spread(symbol, place)] = before[order]
            np.add(place, np.bincount(symbol, minlength=symbols), out=place)

    used = np.flatnonzero(counts)
    for c in used.tolist():
        at = heads[c]
        while at < place[c]:
            end = place[c]
            put_larger(array[at:end])
            at = end
        if marks[c]:
            put_larger(by_symbol[mark_ends[c] - marks[c] : mark_ends[c]])
    larger_ends = place

    # Smaller suffixes, from the largest bucket down, filled from the buckets' ends.
    place = tails.copy()
    array[0] = n - 1
    place[text[n - 1]] -= 1

    def put_smaller(block):
        before = block[block > 0] - 1
        before = before[is_smaller[before]]
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            symbol = symbol[order]
            array[2 * place[symbol] - 1 - _spread(symbol, place)] = before[order]
            np.subtract(place, np.bincount(symbol, minlength=symbols), out=place)

    for c in used[::-1].tolist():
        end = tails[c]
        while place[c] < end:
            at = place[c]
            put_smaller(array[at:end][::-1])
            end = at
        if larger_ends[c] > heads[c]:
            put_smaller(array[heads[c] : larger_ends[c]][::-1])
    return array


def _name(text: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Names, in text order, of the substrings from each leftmost position to the next."""
    n = len(text)
    ends = np.zeros(n, np.int64)
    ends[leftmost[:-1]] = leftmost[1:]
    ends[leftmost[-1]] = leftmost[-1]
    length = ends[ordered] - ordered
    same = length[1:] == length[:-1]
    rest = np.flatnonzero(same)
    k = 0
    while len(rest):
        equal = text[ordered[rest] + k] == text[ordered[rest + 1] + k]
        same[rest[~equal]] = False
        rest = rest[equal]
        rest = rest[length[rest] > k]
        k += 1
    names = np.zeros(n, np.int64)
    names[ordered] = np.append(0, np.cumsum(~same))
    return names[leftmost]


def _run_order(code: np.ndarray, last: np.ndarray, positions: np.ndarray, depth: int | None) -> np.ndarray:
    """``positions`` sorted by the codes from each one to the first ``last`` one after it, which is included."""
    n = len(code)
    # Behind the end of a run stands place n, with code 0 for ever.
    code = np.append(code + 1, 0)
    after = np.arange(1, n + 2)
    after[:-1][last] = n
    after[n] = n
    bits = int(code.max()).bit_length()
    most = 62 // bits
    at, key, read = positions, np.zeros(len(positions), np.int64), 0
    for _ in range(most):
        key = (key << bits) | code[at]
        at, read = after[at], read + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    group = np.append(0, np.cumsum(key[1:] != key[:-1])) if len(key) else key
    at = at[order]
    found = positions[order]
    while depth is None or read < depth:
        same = np.zeros(len(group) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        rest = np.flatnonzero((same[1:] | same[:-1]) & (at < n))
        # A run that has ended stands before longer ones of its group, as code 0 is the smallest.
        tied = np.isin(group, group[rest]) if len(rest) else None
        if tied is None:
            break
        rest = np.flatnonzero(tied)
        # The group, and as many codes as there is room for besides.
        _, small = np.unique(group[rest], return_inverse=True)
        room = (62 - int(small.max()).bit_length()) // bits
        key, spot = small, at[rest]
        for _ in range(room):
            key = (key << bits) | code[spot]
            spot = after[spot]
        read += room
        order = np.argsort(key, kind="stable")
        found[rest], at[rest] = found[rest][order], spot[order]
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        group[rest] = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))] + len(group)
    return found


def induce_by_runs(text: np.ndarray, is_smaller: np.ndarray, leftmost: np.ndarray, symbols: int, depth: int | None) -> np.ndarray:
    """As ``induce``, for any number of symbols."""
    n = len(text)
    wide = text.astype(np.int64)

    def codes(known: np.ndarray, before: bool):
        """Codes of all positions: ``known`` ones, given in order, by their ranks, others by their symbols.
        Of one symbol the known ones stand before the others or after them."""
        counts = np.cumsum(np.bincount(wide[known], minlength=symbols))
        if not before:
            counts = np.append(0, counts[:-1])
        code = counts[wide] + wide
        code[known] = np.arange(len(known)) + wide[known] + (not before)
        return code

    known = leftmost[np.argsort(wide[leftmost], kind="stable")]
    last = np.zeros(n, bool)
    last[known] = True
    larger = _run_order(codes(known, False), last, np.flatnonzero(~is_smaller), depth)
    small = _run_order(codes(larger, True), ~is_smaller, np.flatnonzero(is_smaller), depth)
    array = np.empty(n, np.int64)
    above = np.cumsum(np.bincount(wide[larger], minlength=symbols))
    below = np.append(0, np.cumsum(np.bincount(wide[small], minlength=symbols))[:-1])
    array[np.arange(len(larger)) + below[wide[larger]]] = larger
    array[np.arange(len(small)) + above[wide[small]]] = small
    return array


def longest_run(text: np.ndarray) -> int:
    change = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    return int(np.diff(np.append(change, len(text))).max())


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last symbol must be its only 0, for the first
    ``depth`` symbols (None: all)."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    symbols = int(text.max()) + 1
    if symbols <= 1 << 16:
        text = text.astype(np.uint16)  # sorted by radix
    is_smaller = smaller(text)
    leftmost = np.flatnonzero(is_smaller[1:] & ~is_smaller[:-1]) + 1
    if symbols <= BUCKETS and longest_run(text) <= LONGEST_RUN:
        induced = lambda found: induce(text, is_smaller, found, symbols)
    else:
        induced = lambda found: induce_by_runs(text, is_smaller, found, symbols, depth)
    rough = induced(leftmost)
    marked = np.zeros(n, bool)
    marked[leftmost] = True
    names = _name(text, rough[marked[rough]], leftmost)
    if int(names.max()) + 1 == len(leftmost):
        order = np.argsort(names)
    else:
        # Each leftmost-smaller substring takes two symbols at least.
        order = suffix_array(names, None if depth is None else depth // 2 + 1)
    return induced(leftmost[order])


def permuted_prefix_at_least(text: bytes, order: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts``, in text order: whether the suffix there and the one before it in
    ``order`` agree on ``length`` bytes. Every start has that many bytes after it."""
    n = len(text)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    before = before[starts]
    padded = np.frombuffer(text + bytes(length + 8), np.uint8)
    words = np.ndarray((n + length,), "<u8", padded, 0, (1,))
    same = before >= 0
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        rest = np.flatnonzero(same)
        same[rest] = words[starts[rest] + at] == words[before[rest] + at]
    return same
