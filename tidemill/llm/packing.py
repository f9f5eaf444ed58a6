"""Sum-of-squares online packing of tokenised documents into sequences.

Each task packs its own documents as they come. A document longer than a sequence
first fills whole sequences; what remains goes to the open sequence whose fill level
makes the sum of squared counts of partially filled sequences smallest, or opens a
new one. ``Levels`` keeps that count per level. While more than ``MAX_OPEN`` sequences
are open, the fullest is topped up with tokens of the emptiest, whose pieces are cut for
that. At the end of a task all open sequences are closed so: each keeps what was placed
in it and gets its gap filled, until the emptiest are used up; what is left of the last one
is cut into sequences whose lengths are powers of two, which need no padding.

There is no shuffle, and a task holds the tokens of its open sequences only. A task
that runs again after a lost executor packs the same rows the same way; sequence ids
are the partition's number and a count within it.

Defined results: a null text counts as empty and has the end token only; null or
repeated ids are packed like any others; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemill.llm import scan

CAPACITY, END_ID = 2048, 1
MAX_OPEN = 4096
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: how this vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: white space of that split. Its matcher gives up in runs of about a million, so texts of
#: ``RUN`` characters or more have long runs taken out first.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself,
    the other bytes, in order, from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file. Its ids rise in the order of its merges, so they
    serve as ranks; a special token's string in a text is that token, as in the library."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    special = {x["content"]: x["id"] for x in stored["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): k for token, k in stored["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts, of any length."""

    def __init__(self, path: str):
        self.model = encoder(path)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.model.special_tokens_set))) + ")")
        self.run = re.compile(f"[{SPACES}]{{{RUN},}}")

    def ids(self, text: str) -> np.ndarray:
        if len(text) < RUN or not self.run.search(text):
            return self.model.encode_to_numpy(text, allowed_special="all")
        # Special tokens part a text first. In a part, all of a run but its last character is one word;
        # at the end of a part, the whole run.
        found = []
        for part in self.special.split(text):
            at = 0
            if part not in self.model.special_tokens_set:
                for run in self.run.finditer(part):
                    end = run.end() if run.end() == len(part) else run.end() - 1
                    found.append(self.model.encode_to_numpy(part[at : run.start()]))
                    found.append(np.array(self.model._encode_single_piece(part[run.start() : end]), np.uint32))
                    at = end
            found.append(self.model.encode_to_numpy(part[at:], allowed_special="all"))
        return np.concatenate(found)


#: The cost of leaving a level that has no sequence.
NONE = np.iinfo(np.int64).max // 4


class Levels:
    """Counts of open sequences by fill level, and the cost of leaving and entering each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list] = [[] for _ in range(capacity)]
        self.leave = np.full(capacity + 1, NONE, np.int64)
        self.enter = np.ones(capacity + 1, np.int64)
        self.leave[0] = self.enter[capacity] = 0

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.leave[level] = 1 - 2 * n if n else NONE
        self.enter[level] = 2 * n + 1

    def take(self, size: int):
        """Removes and returns the open sequence (None: a new one) to place ``size`` tokens in."""
        cost = self.leave[: self.capacity - size + 1] + self.enter[size:]
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equal costs the fullest
        if level == 0:
            return None
        found = self.open[level].pop()
        self._count(level)
        return found

    def put(self, sequence: list, fill: int) -> None:
        self.open[fill].append(sequence)
        self._count(fill)

    def _taken(self, level: int) -> tuple[list, int]:
        found = self.open[level].pop()
        self._count(level)
        return found, level

    def fullest(self) -> tuple[list, int]:
        """Removes and returns an open sequence of the highest level, and the level."""
        return self._taken(int(np.flatnonzero(self.leave[1 : self.capacity] < NONE)[-1]) + 1)

    def emptiest(self) -> tuple[list, int]:
        return self._taken(int(np.argmax(self.leave[1 : self.capacity] < NONE)) + 1)


class Packer:
    """Packs (doc, ids); a piece is [doc, start, ids, tokens of the document]."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.levels, self.n_open = Levels(capacity), 0

    def add(self, doc, ids: np.ndarray):
        """Yields sequences (lists of pieces) that are complete."""
        total, at = len(ids), 0
        while total - at >= self.capacity:
            yield [[doc, at, ids[at : at + self.capacity], total]]
            at += self.capacity
        if at == total:
            return
        piece = [doc, at, ids[at:].copy(), total]
        sequence = self.levels.take(total - at)
        self.n_open += sequence is None
        sequence = sequence or []
        sequence.append(piece)
        fill = sum(len(p[2]) for p in sequence)
        if fill == self.capacity:
            self.n_open -= 1
            yield sequence
            return
        self.levels.put(sequence, fill)
        while self.n_open > self.max_open:
            yield from self._topped_up()

    def _topped_up(self):
        """Fills the fullest open sequence from the emptiest ones; yields it when it is full."""
        sequence, fill = self.levels.fullest()
        self.n_open -= 1
        while fill < self.capacity and self.n_open:
            donor, left = self.levels.emptiest()
            doc, start, ids, total = donor.pop()
            cut = ids[: self.capacity - fill]
            sequence.append([doc, start, cut, total])
            fill += len(cut)
            if len(cut) < len(ids):
                donor.append([doc, start + len(cut), ids[len(cut) :], total])
            if donor:
                self.levels.put(donor, left - len(cut))
            else:
                self.n_open -= 1
        if fill == self.capacity:
            yield sequence
        else:
            yield from self._in_powers(sequence, fill)

    def _in_powers(self, sequence: list, left: int):
        """Sequences of lengths that are powers of two, with the same tokens."""
        room, found = 1 << left.bit_length() - 1, []
        for doc, start, ids, total in sequence:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                found.append([doc, start, part, total])
                start += len(part)
                room -= len(part)
                left -= len(part)
                if not room:
                    yield found
                    room, found = 1 << left.bit_length() - 1 if left else 0, []

    def close(self):
        """Closes all open sequences; none gets padding."""
        while self.n_open:
            yield from self._topped_up()


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row per piece; with ``ids`` its token ids too. ``vocabulary`` is a path that executors can read."""
    scan.small_batches(docs.sparkSession)
    shape = PIECES + (", ids array<int>" if ids else "")

    def packed(batches):
        encode = Encoder(vocabulary).ids
        packer = Packer(capacity)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        n = 0

        def place(sequence):
            nonlocal n
            offset = 0
            for doc, start, part, total in sequence:
                crc = zlib.crc32(part.astype("<u4").tobytes())
                rows.append((doc, start, len(part), crc, total, base + n, offset, *([part.astype(np.int32)] if ids else [])))
                offset += len(part)
            n += 1

        def flushed():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[7:]]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in shape.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                for sequence in packer.add(doc, tokens):
                    place(sequence)
                if len(rows) > 20_000:
                    yield flushed()
        for sequence in packer.close():
            place(sequence)
        if rows:
            yield flushed()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(packed, shape)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
