"""Change streams: replay from a checkpoint, routing, windows, exactly-once consumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def changes(events: DataFrame) -> DataFrame:
    """Events as changes: checkpoint, kind, tenant, path, at."""
    kind = F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "signup", "Rename").otherwise("Write")
    tenant = F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))
    return events.select((F.col("event_id") + 1).alias("checkpoint"), kind.alias("kind"), tenant.alias("tenant"), F.concat(F.lit("uwu://"), tenant, F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").alias("at"))


def watch(ch: DataFrame, after: int, prefix: str | None = None) -> DataFrame:
    """Changes behind a checkpoint below a prefix, each checkpoint once; works on streams and batches."""
    out = ch.filter(F.col("checkpoint") > after)
    out = out.filter((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/")) if prefix else out
    return out.dropDuplicates(["checkpoint"])


def channel(path: Column, rules: dict[str, str], default: str = "Main") -> Column:
    """Channel of the longest matching prefix."""
    out = F.lit(default)
    for prefix in sorted(rules, key=len):
        out = F.when(path.startswith(prefix), rules[prefix]).otherwise(out)
    return out


def reconnect_delay(attempt: Column, base: float = 0.5, most: float = 30.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def windowed(ch: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes per window and kind; on a stream, later ones than ``late`` are dropped."""
    timed = ch.withColumn("at", F.col("at").cast("timestamp"))
    timed = timed.withWatermark("at", late) if ch.isStreaming else timed
    return timed.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n")


def sessions(ch: DataFrame, gap: str = "30 minutes") -> DataFrame:
    timed = ch.withColumn("at", F.col("at").cast("timestamp"))
    return timed.groupBy(F.session_window("at", gap).alias("w"), "tenant").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "tenant", "n")


def valid_envelopes(ch: DataFrame, at: Column, fresh_seconds: int, senders: list[str]) -> DataFrame:
    """Envelopes that are fresh, from an allowed sender, and not replayed."""
    age = F.timestamp_diff("SECOND", F.col("at"), at)
    return ch.filter(F.col("tenant").isin(senders) & (age >= 0) & (age <= fresh_seconds)).dropDuplicates(["checkpoint"])


def follow(spark: SparkSession, path: str, sink: str, checkpoint: str, prefix: str | None = None) -> None:
    """Streams new event files into a parquet sink until all are taken; a restart goes on where it stopped."""
    schema = spark.read.parquet(path).schema
    q = watch(changes(spark.readStream.schema(schema).parquet(path)), -1, prefix).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
