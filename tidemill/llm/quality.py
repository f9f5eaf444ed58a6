"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

The trusted target is every document that ``labels`` marks with quality 1; the raw
corpus is every document. Both give a multinomial over ``BINS`` hashed byte 4-grams,
smoothed by one. A document's score is the mean, over its 4-grams, of the logarithm
of target over raw probability; it is kept if it passes the base rules and scores
``THRESHOLD`` or more. Bytes serve here because most junk is words not seen before:
a 4-gram still shows the signs attached to them. Weights are whole multiples of 1 / ``UNIT``,
so a sum has no rounding and a verdict depends on nothing but the text and the weights.

Counts cover all documents. Each task sums its own counts, raw and target in one scan, to
``SLICES`` slices, and slices are added up by key, first within ``FANS`` parts, so what reaches the
driver is 2 * ``BINS`` counts at any size. The trusted ids are broadcast while they are at
most ``skew.BROADCAST_IDS``, which is checked; more are joined by shuffle.

Base counts compare words and lines by their bytes, not by hashes.

Defined results: a null text counts as empty, has no words and fails; a text of fewer
than four bytes scores 0; without any trusted document all scores are 0; null or
repeated ids are kept (a document whose id is labelled more than once counts once,
and a null id is never labelled); empty tables give no rows; other columns are
ignored by ``measure`` and kept by ``keep``, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scan, skew

GRAM, BINS, SLICES, FANS = 4, 1 << 16, 64, 64
THRESHOLD = -0.3
UNIT = 1 << 32
MIN_WORDS, MAX_REPEATED = 50, 50
#: Fixed value: the characters that count as symbols.
SYMBOLS = scan.table(lambda b: b in b"#*$%&|<>")
MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, firsts) of all byte 4-grams that lie in one text."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    wide = data.astype(np.uint32)
    value = wide[:n].copy()
    for k in range(1, GRAM):
        value |= wide[k : n + k] << np.uint32(8 * k)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    value *= np.uint32(0x297A2D39)
    value >>= np.uint32(16)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        ends = offs[1:-1] - k
        inside[ends[(ends >= 0) & (ends < n)]] = False
    firsts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(offs, n)]
    return value[inside].astype(np.int64), firsts


def repeats(keys: np.ndarray) -> np.ndarray:
    """True for each key that stands in the array twice or more."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order] = same[1:] | same[:-1]
    return found


def duplicates(keys: np.ndarray) -> np.ndarray:
    """True for each key that equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    found = np.zeros(len(keys), bool)
    found[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return found


def base_counts(data: np.ndarray, offs: np.ndarray):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends, firsts = scan.words(data, offs, scan.NOT_SPACE)
    n_words = np.diff(firsts)
    chars = scan.tally(scan.NOT_SPACE[data] & scan.STARTS_CHAR[data], offs)
    symbols = scan.tally(SYMBOLS[data], offs)

    texts, count = scan.owner(firsts), len(offs) - 1
    number, distinct = scan.same_bytes(data, starts, ends)
    at = np.arange(max(0, len(starts) - 2))
    at = at[texts[at] == texts[at + 2]]
    kinds = len(distinct)
    at = at[repeats(scan.combined((texts[at], count), *((number[at + k], kinds) for k in range(3))))]
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 3, -1)
    repeated = scan.tally(np.cumsum(edges[:-1]) > 0, firsts)

    # A line ends before each \n and at each text's end; only lines with a word count.
    newline = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offs[:-1], newline + 1]))
    begins = begins[begins < len(data)]
    stops = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, begins)], offs[np.searchsorted(offs, begins, side="right")])
    filled = np.searchsorted(starts, begins) < np.searchsorted(starts, stops)
    begins, stops = begins[filled], stops[filled]
    texts = np.searchsorted(offs, begins, side="right") - 1
    number, distinct = scan.same_bytes(data, begins, stops)
    again = duplicates(scan.combined((texts, count), (number, len(distinct))))
    lines = np.bincount(texts[again], minlength=count)
    return n_words, chars, symbols, lines, repeated


def _counts(docs: DataFrame) -> np.ndarray:
    """Counts of all 4-grams of all texts and of the trusted ones; rows are (text, trusted)."""
    both = 2 * BINS

    def summed(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False)
            for first, end, data, offs in scan.chunks(batch.column(0)):
                bins, firsts = grams(data, offs)
                total[0] += np.bincount(bins, minlength=BINS)
                total[1] += np.bincount(bins[np.repeat(trusted[first:end], np.diff(firsts))], minlength=BINS)
        if total.any():
            part = TaskContext.get().partitionId() % FANS
            columns = [pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array([x.tobytes() for x in np.split(total.ravel(), SLICES)])]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "part", "counts"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(both // SLICES, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()])], names=["slice", "part", "counts"])

    shape = "slice int, part int, counts binary"
    fanned = docs.mapInArrow(summed, shape).groupBy("slice", "part").applyInArrow(added, shape)
    rows = fanned.groupBy("slice").applyInArrow(added, shape).collect()
    total = np.zeros((SLICES, both // SLICES), np.int64)
    for row in rows:
        total[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return total.reshape(2, BINS)


def weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Logarithm of target over raw probability, per bin, in units of 1 / ``UNIT``."""
    trusted = skew.sized(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct())
    own = docs.select(F.col("doc_id").alias("own_id"), "text")
    flagged = own.join(trusted, F.col("own_id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    raw, target = _counts(flagged)
    if not target.any():
        return np.zeros(BINS, np.int64)
    share = lambda x: np.log(x + 1.0) - np.log(x.sum() + BINS)
    return np.rint((share(target) - share(raw)) * UNIT).astype(np.int64)


def verdicts(data, offs, weight, threshold):
    """Base counts, whether the base rules fail, whether the text is kept, score."""
    counts = base_counts(data, offs)
    n_words, repeated = counts[0], counts[4]
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
    bins, firsts = grams(data, offs)
    score = scan.tally(weight[bins], firsts) / (np.maximum(1, np.diff(firsts)) * float(UNIT))
    return counts, failed, ~failed & (score >= threshold), score


def measure(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scan.small_batches(docs.sparkSession)
    weight = docs.sparkSession.sparkContext.broadcast(weights(docs, labels))

    def measured(batches):
        for batch in batches:
            for first, end, data, offs in scan.chunks(batch.column(1)):
                counts, failed, kept, score = verdicts(data, offs, weight.value, threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *(pa.array(x, pa.int64()) for x in counts), pa.array(failed), pa.array(kept), pa.array(score)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(measured, MEASURES)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    scan.small_batches(docs.sparkSession)
    weight = docs.sparkSession.sparkContext.broadcast(weights(docs, labels))
    place = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            for first, end, data, offs in scan.chunks(batch.column(place)):
                yield batch.slice(first, end - first).filter(pa.array(verdicts(data, offs, weight.value, threshold)[2]))

    return docs.mapInArrow(kept, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("score")


SQL = f"""
WITH given AS (
  SELECT doc_id, text, hex(encode(text)) AS h, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
spots AS (SELECT doc_id, k, list_slice(w, k, k + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM given WHERE len(w) > 2)),
twice AS (SELECT doc_id, g FROM spots GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM spots JOIN twice USING (doc_id, g)) GROUP BY 1),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM given LEFT JOIN repeated USING (doc_id)),
digits AS (
  SELECT doc_id, list_transform(string_split(h, ''), lambda c: CAST(position(c IN '0123456789ABCDEF') - 1 AS BIGINT)) AS d FROM given WHERE h <> ''),
bytes AS (SELECT doc_id, list_transform(range(0, len(d) // 2), lambda i: 16 * d[2 * i + 1] + d[2 * i + 2]) AS b FROM digits),
four AS (
  SELECT doc_id, b[k] + 256 * b[k + 1] + 65536 * b[k + 2] + 16777216 * b[k + 3] AS v
  FROM (SELECT doc_id, b, unnest(range(1, len(b) - {GRAM - 2})) AS k FROM bytes WHERE len(b) >= {GRAM})),
once AS (SELECT doc_id, (xor(v, v >> 15) * 739982445) & 4294967295 AS v FROM four),
binned AS (SELECT doc_id, ((xor(v, v >> 12) * 695872825) & 4294967295) >> 16 AS bin FROM once),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT bin, count(*) AS raw, count(trusted.doc_id) AS target FROM binned LEFT JOIN trusted USING (doc_id) GROUP BY 1),
sums AS (SELECT sum(raw) AS raw, sum(target) AS target FROM counts),
weights AS (
  SELECT bin, CASE WHEN sums.target = 0 THEN 0 ELSE ln(counts.target + 1) - ln(sums.target + {BINS}) - ln(counts.raw + 1) + ln(sums.raw + {BINS}) END AS weight
  FROM counts, sums),
scores AS (SELECT doc_id, avg(weight) AS score FROM binned JOIN weights USING (bin) GROUP BY 1),
judged AS (
  SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, coalesce(score, 0) AS score
  FROM base LEFT JOIN scores USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {THRESHOLD} AS kept
FROM judged
"""
