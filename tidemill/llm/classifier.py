"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

A token is a run of letters and digits or a run of other signs; a token equal to the
one before it is written as a repeat mark, so that loops look alike whatever their
words. Features are tokens and pairs of tokens, hashed to ``BINS``; a feature's value
is its count over the square root of the number of features, so a score is one
sparse dot product. Weights are rounded to whole multiples of 1 / ``UNIT``; their
sums have no rounding, so equal texts have equal scores whatever stands beside them.

Training is sequential by nature: it takes at most ``SAMPLE`` labelled documents, those
of the smallest MD5 of their ids, in that order, ``EPOCHS`` times, in one task. Of rows that
repeat an id the smallest text is learnt from. Rows whose
crc32(doc_id as text) mod 5 is 0 are held out and never learnt from. Every document
is scored, by its whole text.

Defined results: a null text counts as empty and is scored by the bias alone; null ids
are never learnt from, and held out if the CRC of an empty string says so; repeated
rows are scored each; labels that are null are not used; without labels every score
is 0.5; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scan

BINS = 1 << 18
SAMPLE, EPOCHS = 8_000, 2
UNIT = 1 << 32
CUT = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.01, 0.01
TOKENS = scan.ALNUM.astype(np.uint8) + 2 * (scan.NOT_SPACE & ~scan.ALNUM)
REPEAT, PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, firsts): the bias, tokens and pairs of each text."""
    starts, ends, firsts = scan.words(data, offs, TOKENS)
    tokens = scan.word_hashes(data, starts, ends)
    first = np.zeros(len(tokens) + 1, bool)
    first[firsts] = True
    first = first[:-1]
    same = np.zeros(len(tokens), bool)
    same[1:] = (tokens[1:] == tokens[:-1]) & ~first[1:]
    marked = np.where(same, REPEAT, tokens)
    pairs = marked[1:] + scan.mix(marked[:-1] + PAIR) if len(marked) else marked
    pairs = scan.mix(pairs[~first[1:]])
    n = np.diff(firsts)
    # Laid out per text: one bias, n tokens, n - 1 pairs.
    sizes = 1 + n + np.maximum(n - 1, 0)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begins[-1], np.int64)
    texts = scan.owner(firsts)
    spot = begins[texts] + 1 + np.arange(len(tokens)) - firsts[texts]
    out[spot] = _bins(marked)
    later = ~first
    out[spot[later] + n[texts[later]] - 1] = _bins(pairs)
    return out, begins


def _bins(hashes: np.ndarray) -> np.ndarray:
    return 1 + (hashes % np.uint64(BINS - 1)).astype(np.int64)


def scores(weight: np.ndarray, bins: np.ndarray, begins: np.ndarray) -> np.ndarray:
    whole = np.rint(weight * UNIT).astype(np.int64)
    z = scan.tally(whole[bins], begins) / (float(UNIT) * np.sqrt(np.diff(begins)))
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Follow the regularised leader, one example at a time."""

    def __init__(self):
        self.z, self.n = np.zeros(BINS), np.zeros(BINS)

    def weight(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weight(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights per bin, learnt from at most ``sample`` labelled documents."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("learnt_id")).agg(F.max("quality").cast("int").alias("label"), F.first(order).alias("place"))
    chosen = chosen.orderBy("place", "learnt_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text")
    texts = own.join(F.broadcast(chosen), F.col("own_id") == F.col("learnt_id")).groupBy("place", "own_id", "label").agg(F.min("text").alias("text"))

    def learnt(batches):
        rows = []
        for batch in batches:
            labels = batch.column(2).to_pylist()
            for first, end, data, offs in scan.chunks(batch.column(3)):
                bins, begins = features(data, offs)
                for k in range(end - first):
                    at, count = np.unique(bins[begins[k] : begins[k + 1]], return_counts=True)
                    rows.append((at.astype(np.int32), (count / np.sqrt(begins[k + 1] - begins[k])).astype(np.float32), labels[first + k]))
        model = Ftrl()
        for _ in range(epochs):
            for row in rows:
                model.learn(*row)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight().tobytes()])], names=["weights"])

    # Bounded by the sample, so one task holds it.
    ordered = texts.repartition(1).sortWithinPartitions("place", "own_id")
    found = ordered.mapInArrow(learnt, "weights binary").collect()
    return np.frombuffer(found[0]["weights"]) if found else np.zeros(BINS)


def score(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scan.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def scored(batches):
        for batch in batches:
            for first, end, data, offs in scan.chunks(batch.column(2)):
                p = scores(shared.value, *features(data, offs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return narrow.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op7_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scan.small_batches(spark)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
