"""Vectorised work on the UTF-8 bytes of many texts at once.

An Arrow column of texts is one run of bytes with offsets. These functions find
words in it and hash words, windows of words and byte n-grams with a few NumPy
operations per byte and no loop over texts. Chunks bound the memory: a chunk holds
``CHUNK`` bytes, or one text if that is longer.
"""

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
#: Rows and bytes handed to Python at once; a batch of long texts must fit in memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def small_batches(spark) -> None:
    """Lowers the session's limits of an Arrow batch to BATCH_ROWS and BATCH_BYTES, and leaves lower ones.

    Spark reads them when a query runs, so they stay lowered; no result depends on them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; workers are kept for later tasks."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def table(keep) -> np.ndarray:
    return np.fromiter((bool(keep(b)) for b in range(256)), bool, 256)


#: Bytes of words: not a space, \t, \n, \v, \f or \r.
NOT_SPACE = table(lambda b: b != 32 and not 9 <= b <= 13)
#: Bytes of letters and digits, all bytes of other code points than ASCII among them.
ALNUM = table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A code point starts at every byte that doesn't continue one.
STARTS_CHAR = table(lambda b: b & 0xC0 != 0x80)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of an Arrow string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found[offs[0] : offs[-1]], offs - offs[0]


def chunks(column, limit: int = CHUNK):
    """(first text, end text, bytes, offsets) of runs of texts."""
    data, offs = column_bytes(column)
    first, n = 0, len(offs) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def words(data: np.ndarray, offs: np.ndarray, kinds: np.ndarray):
    """(starts, ends, firsts): spans of bytes of one kind other than 0, and for each text (and
    the end) its first span. ``kinds`` maps a byte to its kind."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    kind = kinds[data]
    change = np.zeros(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offs] = True
    change[n] = True
    inside = kind.astype(bool)
    starts = np.flatnonzero(inside & change[:-1])
    return starts, np.flatnonzero(inside & change[1:]) + 1, np.searchsorted(starts, offs)


def owner(firsts: np.ndarray) -> np.ndarray:
    """The text of each word (or other thing) of which ``firsts`` has each text's first."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as asked for so far in this process.

    Functions go to executors by value, and this with them: without what it holds."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return type(self), ()

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values times rising powers; ``span`` takes hashes of ranges from them."""
    up, _ = POWERS.get(max(1, len(values)))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range that depends on its values and length only. Different long ranges of
    regular structure may have one hash, so equal hashes do not prove equal ranges."""
    _, down = POWERS.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each range's bytes, the bytes of each number): ranges have one number if, and only
    if, their bytes are equal. Ranges rise, are not empty and do not overlap."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] = 1
    edges[ends] -= 1
    inside = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offs[1:])
    ranges = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(inside)])
    numbered = ranges.dictionary_encode()
    return numbered.indices.to_numpy().astype(np.int64), numbered.dictionary


#: Constants of the rounds of ``digests``.
ROUNDS = tuple(map(np.uint64, (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of 128 bits for each range; see ``same_bytes``. Those of up to 15 bytes are their
    bytes and length, mixed by a bijection, so different ranges have different bits; longer ones have a
    BLAKE2b digest."""
    sizes = ends - starts
    padded = np.append(data, np.zeros(16, np.uint8))
    words = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
    kept = np.append(np.uint64(0), ~np.uint64(0) >> (np.uint64(64) - np.arange(8, 72, 8, dtype=np.uint64)))
    low = words[starts] & kept[np.minimum(sizes, 8)]
    high = words[starts + np.minimum(sizes, 8)] & kept[np.clip(sizes - 8, 0, 7)] | sizes.astype(np.uint64) << np.uint64(56)
    high ^= mix(low ^ ROUNDS[0])
    low ^= mix(high ^ ROUNDS[1])
    high ^= mix(low ^ ROUNDS[2])
    low, high = mix(low), mix(high)
    long = np.flatnonzero(sizes > 15)
    if len(long):
        number, distinct = same_bytes(data, starts[long], ends[long])
        halves = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in distinct.to_pylist()), "<u8").reshape(-1, 2)
        low[long], high[long] = halves[number, 0], halves[number, 1]
    return low, high


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span(prefix(_byte_values()[data]), starts, ends)


def windows(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``size`` words that lies in one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    left = np.repeat(firsts[1:], np.diff(firsts))[:n]
    at = at[at + size <= left]
    return at, span(prefix(hashes), at, at + size)


def combined(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """A number per row that is equal where all columns are; each is given with an upper bound of its
    numbers (excluded)."""
    value, span = columns[0][0].astype(np.int64), max(1, columns[0][1])
    for more, bound in columns[1:]:
        bound = max(1, bound)
        if span * bound >= 1 << 62:
            distinct, value = np.unique(value, return_inverse=True)
            span = max(1, len(distinct))
        value, span = value * bound + more, span * bound
    return value


def tally(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the values per text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]
