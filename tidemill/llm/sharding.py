"""Proportional stratified interleaving of documents into shards (law ``rows``).

Rows of each source are ranked in a seeded shuffled order, that of a digest of seed, id and checksum
of the text, so rows without an id or with one id are spread like any others. A row of rank r among
the n rows of its source has the fractional rank (2r + 1) / 2n. All rows, sorted
by fractional rank, are cut into ranges whose lengths differ by at most one, so
each shard holds every source in the proportion of the whole.

No rank is taken over an unbounded group: the shuffle key (and later the
fractional rank) is cut into ``buckets`` equal ranges, rows are ranked inside a
bucket, and the counts of the buckets before it are added. Only a count per
source and bucket is ever gathered.

Defined results: a null text counts as empty bytes; null sources form one source
of their own; null or repeated ids are kept, ties being ordered by id, checksum
and size; an empty table gives no rows; columns beyond the three used are ignored,
whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"
BUCKETS = 1024


def _before(counts: DataFrame, within: list[str], by: str) -> DataFrame:
    """Adds ``ahead`` (rows of smaller buckets) and ``total`` to counts per bucket."""
    parts = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return counts.select(
        *within,
        by,
        (F.sum("n").over(parts.orderBy(by)) - F.col("n")).alias("ahead"),
        F.sum("n").over(parts).alias("total"),
    )


def keyed(docs: DataFrame, seed: str, buckets: int) -> DataFrame:
    """One narrow row per document; the text goes no further than its size and checksum."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    crc = F.crc32(text)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), crc.cast("string")).cast("binary"))
    stratum = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("source")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        stratum.alias("stratum"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        crc.alias("text_crc32"),
        key.alias("key"),
        _slice(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 1 << 32, buckets).alias("bucket"),
    )


def _slice(value: Column, span: int, buckets: int) -> Column:
    return F.floor(value * F.lit(buckets) / F.lit(span)).cast("int")


def interleave(docs: DataFrame, shards: int = 24, seed: str = "tide", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, stratum, size, text_crc32, fraction, shard, slot of every row of ``docs``."""
    rows = keyed(docs, seed, buckets)
    tie = ["key", F.asc_nulls_first("doc_id"), "text_crc32", "size"]

    counts = keyed(docs, seed, buckets).groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    local = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*tie))
    ranked = (
        rows.withColumn("local", local)
        .join(_before(counts, ["stratum"], "bucket"), ["stratum", "bucket"])
        .withColumn("rank", F.col("ahead") + F.col("local") - 1)
        .withColumn("fraction", (2 * F.col("rank") + 1).cast("double") / (2 * F.col("total")).cast("double"))
        .drop("local", "ahead", "total", "bucket", "rank")
        .withColumn("bucket", F.floor(F.col("fraction") * buckets).cast("int"))
    )
    # Of n rows of a source, those of rank r with floor((2r + 1) / 2n * buckets) = b are
    # counted from the ranked rows themselves, so both uses share one exchange.
    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    local = F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "stratum", *tie))
    place = F.col("ahead") + F.col("local") - 1
    return (
        ranked.withColumn("local", local)
        .join(_before(counts, [], "bucket"), "bucket")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"cast(place * {shards} div total as int)"))
        .withColumn("slot", F.expr(f"place - (shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "stratum", "size", "text_crc32", "fraction", "shard", "slot")
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return interleave(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# CRC-32 without a table: eight shifts a byte, folded over the bytes of the text.
_CRC_STEP = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
SQL = f"""
WITH narrow AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS stratum,
    coalesce(text, '') AS text,
    CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 8 AS size
  FROM documents),
steps AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: {_CRC_STEP}) AS v FROM range(256) r(b))),
digits AS (
  SELECT narrow.*, steps.t, list_transform(CASE WHEN text = '' THEN [] ELSE string_split(hex(encode(text)), '') END,
    lambda c: position(c IN '0123456789ABCDEF') - 1) AS d FROM narrow, steps),
sums AS (
  SELECT doc_id, stratum, size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(d) // 2), lambda i: d[2 * i + 1] * 16 + d[2 * i + 2])),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM digits),
keyed AS (SELECT *, md5('tide:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)) AS key FROM sums),
ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id NULLS FIRST, text_crc32, size) - 1 AS DOUBLE)
    / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS fraction FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id NULLS FIRST, text_crc32, size) - 1 AS place,
    count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, '{LAW}' AS law,
  CAST(place * 24 // total AS INTEGER) AS shard,
  CAST(place - (place * 24 // total * total + 23) // 24 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
