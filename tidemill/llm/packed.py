"""Columns of many small integers as one binary value, for shuffles with few rows."""

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Byte planes, lowest first, as many as the largest value needs; they compress well."""
    raw = np.ascontiguousarray(values).astype(np.int64).view(np.uint64)
    width = (int(raw.max()).bit_length() + 7) // 8 if len(raw) else 0
    return bytes([width]) + raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data, count: int) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    width = int(data[0])
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = data[1:].reshape(width, count).T
    return out.reshape(-1).view(np.int64)


def pack_rising(values: np.ndarray) -> bytes:
    """Values in rising order, as the first and the steps."""
    return np.int64(values[0] if len(values) else 0).tobytes() + pack(np.diff(values))


def unpack_rising(data, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    data = memoryview(data)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.int64), unpack(data[8:], count - 1)]))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the runs of equal neighbours."""
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return begins, np.append(begins[1:], len(keys))


def scaled(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Deals 64-bit hashes to ``parts`` equal ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def prime_from(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])
