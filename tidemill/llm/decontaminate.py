"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits and of all other code points than ASCII,
with A-Z in lower case. A window of a benchmark item is 13 of its consecutive words,
or all its words if it has fewer but any. Hashes of all windows are broadcast in
blocks of at most ``BLOCK`` windows, each loaded by itself, so a task holds one block
whatever the benchmark's size; where there are several, a task loads each once for every
``BUFFER`` bytes of documents. Every window of a document is looked up; a hit is
verified word by word before it counts. A document word inside a verified hit is hit,
and a document is contaminated if at least one in ``SHARE`` of its words is hit.

Defined results: a null text has no words and is not contaminated; null or repeated
document ids are kept as they are; items without words have no windows; items that
repeat are each reported; a null item id is not reported; an empty table of documents
gives no rows, and an empty benchmark no hits; other columns are ignored by
``measure`` and kept by ``clean``, whatever their names.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import scan

SIZE, SHARE = 13, 20
BLOCK, BUFFER = 1_000_000, 16 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MEASURES = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall(scan.LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes())


class Block:
    """Windows of some items: per length the sorted hashes, and of each window its item and its
    place in the items' words, joined by spaces."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.names = [name for name, _ in items]
        self.text = b" ".join(word for _, words in items for word in words)
        data = np.frombuffer(self.text, np.uint8)
        starts, ends, _ = scan.words(data, np.array([0, len(data)]), scan.ALNUM)
        sums = scan.prefix(scan.word_hashes(data, starts, ends))
        counts = np.array([len(words) for _, words in items])
        firsts = np.cumsum(counts) - counts
        sizes = np.minimum(counts, size)
        self.by_size = {}
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            windows = counts[own] - n + 1
            item = np.repeat(own, windows)
            at = firsts[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
            hashes = scan.span(sums, at, at + n)
            order = np.argsort(hashes, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(hashes >> np.uint64(44)).astype(np.int64)] = True
            at = at[order]
            self.by_size[n] = (hashes[order], item[order].astype(np.int32), starts[at], ends[at + n - 1], marks)


def blocks(benchmark: DataFrame, size: int, limit: int):
    """The benchmark, read row by row, in blocks of about ``limit`` windows."""
    found, held = [], 0
    for row in benchmark.selectExpr("cast(item_id as string) as item", "text").toLocalIterator():
        if words := item_words(row["text"]):
            found.append((row["item"], words))
            held += max(1, len(words) - size + 1)
        if held >= limit:
            yield Block(found, size)
            found, held = [], 0
    if found:
        yield Block(found, size)


class Text:
    """The words of a chunk of documents and what was found in them."""

    def __init__(self, data, offs):
        self.low = scan.LOWER[data]
        self.starts, self.ends, self.firsts = scan.words(self.low, offs, scan.ALNUM)
        self.hashes = scan.word_hashes(self.low, self.starts, self.ends)
        self.edges = np.zeros(len(self.starts) + 1, np.int64)
        self.items: dict[int, set] = {}  # by document

    def look_up(self, block: Block) -> None:
        for size, (known, item, begins, stops, marks) in block.by_size.items():
            at, found = scan.windows(self.hashes, self.firsts, size)
            near = np.flatnonzero(marks[(found >> np.uint64(44)).astype(np.int64)])
            at, found = at[near], found[near]
            lo, hi = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
            owners = np.searchsorted(self.firsts, at, side="right") - 1
            for k in np.flatnonzero(lo < hi).tolist():
                first = int(at[k])
                spans = zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True)
                words = b" ".join(self.low[a:b].tobytes() for a, b in spans)
                same = [int(item[j]) for j in range(lo[k], hi[k]) if block.text[begins[j] : stops[j]] == words]
                if same:
                    self.edges[first] += 1
                    self.edges[first + size] -= 1
                    self.items.setdefault(int(owners[k]), set()).update(block.names[j] for j in same if block.names[j] is not None)

    @property
    def hit(self) -> np.ndarray:
        return np.cumsum(self.edges[:-1]) > 0

    def verdicts(self):
        """(words, hit words, contaminated) of each document."""
        n_words, n_hit = np.diff(self.firsts), scan.tally(self.hit, self.firsts)
        return n_words, n_hit, judged(n_words, n_hit)


def looked_up(batches, place: int, index: list):
    """(batch, data, offsets, Text) of the chunks of all batches, whose column ``place`` holds the texts."""
    held, size = [], 0

    def done():
        for one in index:
            block = one.value
            for *_, text in held:
                text.look_up(block)
            if len(index) > 1:
                _release(one)
        yield from held
        held.clear()

    for batch in batches:
        for first, end, data, offs in scan.chunks(batch.column(place)):
            held.append((batch.slice(first, end - first), data, offs, Text(data, offs)))
            size += len(data)
            if len(index) < 2 or size >= BUFFER:
                yield from done()
                size = 0
    yield from done()


def _release(one) -> None:
    """Forgets the loaded value of a broadcast; it is read from its file again when needed."""
    one.__dict__.pop("_value", None)


def _index(benchmark: DataFrame, size: int, limit: int) -> list:
    found = []
    for block in blocks(benchmark, size, limit):
        found.append(benchmark.sparkSession.sparkContext.broadcast(block))
        _release(found[-1])
    return found


def judged(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def measure(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Words, hit words and items of every document."""
    scan.small_batches(docs.sparkSession)
    index = _index(benchmark, size, block)

    def measured(batches):
        for batch, _, _, text in looked_up(batches, 1, index):
            n_words, n_hit, contaminated = text.verdicts()
            items = [text.items.get(k, ()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                    pa.array(contaminated),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(measured, MEASURES)


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """``docs`` without contaminated documents, or with every hit span cut from its text.

    A span runs from the first byte of its first word to the last of its last; the count
    ``n_chars``, where there is one, is made anew.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    scan.small_batches(docs.sparkSession)
    index = _index(benchmark, size, block)
    place = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def kept(batches):
        for part, data, offs, text in looked_up(batches, place, index):
            if remove == "documents":
                yield part.filter(pa.array(~text.verdicts()[2]))
                continue
            mask, firsts = text.hit, text.firsts
            texts = part.column(place).to_pylist()
            for k in np.flatnonzero(scan.tally(mask, firsts)).tolist():
                texts[k] = cut(data, offs[k], offs[k + 1], text.starts, text.ends, mask, firsts[k], firsts[k + 1])
            columns = part.columns
            columns[place] = pa.array(texts, part.schema.field(place).type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(kept, docs.schema)


def cut(data, begin, stop, starts, ends, mask, first, last) -> str:
    keep = np.ones(stop - begin, bool)
    hit = np.flatnonzero(mask[first:last]) + first
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    for run in runs:
        keep[starts[run[0]] - begin : ends[run[-1]] - begin] = False
    return data[begin:stop][keep].tobytes().decode()


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


SQL = f"""
WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
grams AS (
  SELECT DISTINCT item_id, least(len(w), {SIZE}) AS size, list_slice(w, k, k + least(len(w), {SIZE}) - 1) AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
spots AS (
  SELECT doc_id, size, k, list_slice(w, k, k + size - 1) AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, k, spots.size FROM spots JOIN grams ON spots.size = grams.size AND spots.gram = grams.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND {SHARE} * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
