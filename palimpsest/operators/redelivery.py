"""Exactly one copy of each message out of an at-least-once delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import keep

BITS_PER_ID = 16
PROBES = 4
MOST_BUCKETS = 100_000
SPACE = " \t\n\r\u00a0\u3000"


def uuid_key(c: Column) -> Column:
    """The 32 lower-case hex digits of a UUID in any usual spelling, else null.

    Hyphens, braces, an ``urn:uuid:`` prefix, letter case and outer white space
    do not matter. Null, blank and anything that is no UUID give null.
    """
    bare = F.btrim(F.lower(c), F.lit(SPACE))
    bare = F.btrim(F.when(F.startswith(bare, F.lit("urn:uuid:")), F.substring(bare, 10, 64)).otherwise(bare), F.lit("{}()"))
    digits = F.translate(bare, "-", "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits)


def identified(df: DataFrame, id_col: str, key_col: str, at_col: str) -> DataFrame:
    """Messages with identifier, written once: id, key, at."""
    m = df.select(F.col(id_col).alias("id"), uuid_key(F.col(key_col)).alias("key"), F.col(at_col).alias("at"))
    return keep(m.filter(F.col("key").isNotNull()), "messages")


def _sketched(storage: DataFrame, words: int) -> DataFrame:
    """Storage with the place (``word``) and the bits (``mask``) of every identifier in a filter of ``words`` 64-bit words."""
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(key, 7L), {6 * i}), 64) as int))"))
    return storage.withColumn("word", F.pmod(F.xxhash64("key"), F.lit(words))).withColumn("mask", mask)


def _filters(sketched: DataFrame) -> DataFrame:
    return sketched.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))


def _folded(m: DataFrame, bucket: str) -> DataFrame:
    bucket_of = F.coalesce(F.unix_micros(F.date_trunc(bucket, F.col("at").cast("timestamp"))), F.lit(1 << 62)).alias("bucket")
    return m.groupBy(bucket_of, "key").agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", "id")).alias("first"), F.count("*").alias("n_copies")).select("bucket", "key", "first", "n_copies")


def first_copies(m: DataFrame, bucket: str = "week") -> DataFrame:
    """Of messages (id, key, at): per identifier and time bucket the earliest copy, and whether an earlier bucket really holds the identifier.

    1. Storage: copies are folded per (bucket, identifier) to the earliest one,
       with map-side combination, so that copies of one identifier never pile up
       in a task.
    2. Every bucket gets a Bloom filter over its identifiers, kept as a table of
       64-bit words (an identifier sets ``PROBES`` bits of one word), so that a
       filter may be larger than any one machine.
    3. An identifier whose word shows its bits in no earlier bucket is definitely
       new. The others are verified exactly, and only against the storage of the
       buckets whose filter matched.

    Result: bucket, key, at, id, n_copies, earlier (true where an earlier bucket holds the key).
    """
    storage = _folded(m, bucket)
    n = max(1, m.count())
    sketched = _sketched(storage, 1 << max(6, (n * BITS_PER_ID // 64 // 8).bit_length()))
    filters = _filters(sketched).groupBy("word").agg(F.collect_list(F.struct("bucket", "bits")).alias("filters"))
    hits = F.expr("transform(filter(filters, f -> f.bucket < bucket and (f.bits & mask) = mask), f -> f.bucket)")
    possible = sketched.join(filters, "word").select("bucket", "key", F.explode(hits).alias("at_bucket"))
    verified = (
        possible.join(storage.select(F.col("bucket").alias("at_bucket"), "key"), ["at_bucket", "key"], "left_semi")
        .groupBy("bucket", "key")
        .agg(F.lit(True).alias("earlier"))
    )
    return storage.join(verified, ["bucket", "key"], "left").select("bucket", "key", F.col("first.at").alias("at"), F.col("first.id").alias("id"), "n_copies", F.coalesce("earlier", F.lit(False)).alias("earlier"))


class SeenStore:
    """Identifiers seen so far, stored by time bucket, each bucket with its Bloom filter: for deliveries that come in batches.

    ``folder``: shared by all executors. ``words``: 64-bit words of one bucket's filter (16 bits an identifier are about one
    false match in a hundred); a fuller filter only sends more identifiers to be verified.
    """

    def __init__(self, spark: SparkSession, folder: str, bucket: str = "week", words: int = 1 << 20):
        self.spark, self.folder, self.bucket, self.words = spark, folder.rstrip("/"), bucket, words

    def _read(self, what: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{what}"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def add(self, df: DataFrame, id_col: str, key_col: str, at_col: str) -> DataFrame:
        """The ids of the batch's surplus copies: of each identifier the earliest copy of the first batch that brings it stays. The batch is then added.

        Identifiers whose bits no stored filter shows are new and meet no storage; of the
        rest, only the stored buckets that some filter points to are read. Rows without identifier are never surplus.
        """
        m = identified(df, id_col, key_col, at_col)
        batch = keep(_sketched(_folded(m, self.bucket), self.words), "batch")
        stored = self._read("filters", "word long, bits long, bucket long")
        possible = keep(batch.join(stored.withColumnRenamed("bucket", "at_bucket"), "word").filter("(bits & mask) = mask").select("key", "at_bucket").distinct(), "possible")
        asked = [r["at_bucket"] for r in possible.select("at_bucket").distinct().limit(MOST_BUCKETS).collect()]
        seen = self._read("keys", "key string, bucket long").filter(F.col("bucket").isin(asked)).withColumnRenamed("bucket", "at_bucket")
        known = keep(possible.join(seen, ["at_bucket", "key"], "left_semi").select("key").distinct(), "known")
        new = batch.join(known, "key", "left_anti")
        stays = new.groupBy("key").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"))
        surplus = keep(m.select("id").join(stays, "id", "left_anti").select(F.col("id").alias(id_col)).distinct(), "surplus")
        fresh = keep(new.select("key", "word", "mask", "bucket"), "fresh")
        fresh.select("key", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/keys")
        _filters(fresh).select("word", "bits", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/filters")
        return surplus


def surplus_copies(df: DataFrame, id_col: str, key_col: str, at_col: str, bucket: str = "week") -> DataFrame:
    """The ids of all copies but the one that stays (earliest ``at_col``, then lowest id).

    The copies that stay are the firsts of their bucket without an earlier
    bucket; all other identified copies are surplus. They are told apart by the
    delivery's own id, which is unique, so the join has no hot key even when a
    third of all messages are copies of one. Null, blank and malformed
    identifiers identify nothing: such messages are never surplus. A copy without
    time counts as later than any with time. An id that occurs twice is one
    delivery. An empty table gives no rows; other columns pass untouched.
    """
    m = identified(df, id_col, key_col, at_col)
    stays = first_copies(m, bucket).filter(~F.col("earlier")).select("id")
    return m.select("id").join(stays, "id", "left_anti").select(F.col("id").alias(id_col)).distinct()


def deduplicate(df: DataFrame, id_col: str, key_col: str, at_col: str, bucket: str = "week") -> DataFrame:
    """The rows of ``df`` without surplus copies; rows without identifier all stay."""
    return df.join(surplus_copies(df, id_col, key_col, at_col, bucket), id_col, "left_anti")
