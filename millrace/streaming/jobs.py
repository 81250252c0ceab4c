"""Streams of requests, lookups and body chunks, and the batch twins of their results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators.ttl import ttl_states
from millrace.session import fresh_path

# Seconds of a throughput window, idle seconds that end a session, chunk and overlap sizes.
WINDOW_SECONDS, IDLE_SECONDS = 5, 300
PENDING_SECONDS = 600
CHUNK_CHARS, OVERLAP_CHARS = 4096, 1024


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, write its rows as parquet and return them."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, name + "-checkpoint")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = writer.outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a job on every batch of a stream, write its rows and return them."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, name + "-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a repeated batch replaces its own rows only
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def run_updates(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream in update mode; of each key the row of the last batch is returned."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, name + "-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a repeated batch replaces its own rows only
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def throughput(requests: DataFrame, delay: str = "1 minute") -> DataFrame:
    """start, bytes_per_second of every window of five seconds; rows later than the delay are dropped."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", delay)
    summed = timed.groupBy(F.window("ts", f"{WINDOW_SECONDS} seconds").alias("w")).agg(F.sum("bytes").alias("bytes"))
    return summed.select(F.unix_seconds("w.start").alias("start"), (F.col("bytes") / WINDOW_SECONDS).alias("bytes_per_second"))


def sessions(requests: DataFrame, delay: str = "1 minute") -> DataFrame:
    """endpoint, start_us, end_us, requests of every run of requests with less than five idle minutes between."""
    timed = requests.select(F.col("ts").cast("timestamp").alias("ts"), U.host(F.col("url")).alias("endpoint"))
    if timed.isStreaming:
        # sessions of a partition merge before the shuffle, so a hot endpoint sends sessions, not rows
        requests.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        timed = timed.withWatermark("ts", delay)
    rows = timed.groupBy(F.session_window("ts", f"{IDLE_SECONDS} seconds").alias("w"), "endpoint").agg(F.count("*").alias("requests"))
    return rows.select("endpoint", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "requests")


def closing_row(rows: DataFrame, at: str, micros: bool = False) -> DataFrame:
    """One row a day after all others: it moves the watermark beyond every open session and stays open itself."""
    value = (F.max(at) + 86_400_000_000 if micros else F.max(at) + F.expr("INTERVAL 1 DAY")).alias(at)
    return rows.agg(value).select(*[F.col(at) if c == at else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


def run_ttl_cache(stream: DataFrame, name: str, forget: int | None = None) -> DataFrame:
    """req_id, host, state (hit, stale, miss) of a stream of lookups.

    The cache is a table of host and expiry: each batch reads the version that the batch before has written, judges its
    lookups as a table and writes the next version, so the state of a host is two values and a repeated batch gives the
    same rows. Expired answers are served while they are refreshed; with ``forget`` (seconds) those that expired longer
    than that before the latest lookup are dropped, which bounds the state.
    """
    spark = stream.sparkSession
    out, held, checkpoint = (fresh_path(spark, name + part) for part in ("", "-held", "-checkpoint"))

    def save(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.parquet(f"{held}/batch={batch_id - 1}") if batch_id else None
        states, after = ttl_states(batch, known)
        states.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if forget is not None:
            latest = batch.agg(F.max("at_us")).first()[0]
            if latest is not None:
                after = after.where(F.col("expires") > latest - forget * 1_000_000)
        after.write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def coalesce_lookups(lookups: DataFrame, pending: int = PENDING_SECONDS) -> DataFrame:
    """host, req_id of the first lookup of every run of lookups for a host that come while one is under way.

    By event time: the result does not depend on how rows fall into batches. A run ends when no lookup comes for
    ``pending`` seconds.
    """
    timed = lookups.withColumn("ts", F.timestamp_micros("at_us"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", "1 minute")
    runs = timed.groupBy(F.session_window("ts", f"{pending} seconds").alias("w"), "host").agg(F.min(F.struct("at_us", "req_id")).alias("first"))
    return runs.select("host", "first.req_id")


def chunk_hits(chunks: DataFrame, signatures: Sequence[tuple[str, str]], apart: str = "1 hour") -> DataFrame:
    """stream_id, name of signatures found in bodies that come in chunks, also across a chunk border.

    Hits inside a chunk need no state. For borders each chunk is joined with its follower on stream and
    number, so even one endless stream is spread over all tasks; only the ends of the chunks travel. No
    signature may be longer than the overlap or than a chunk. In a stream neighbours may be ``apart`` in time,
    which bounds the state; a table has no such bound.
    """
    if any(len(s) > OVERLAP_CHARS for _, s in signatures):
        raise ValueError("signature longer than the overlap")
    rows = chunks.withWatermark("ts", apart) if chunks.isStreaming else chunks

    def names(tests: list[Column]) -> Column:
        return F.array_compact(F.array(*[F.when(test, F.lit(n)) for (n, _), test in zip(signatures, tests)]))

    inside = rows.select("stream_id", F.explode(names([F.contains("text", F.lit(s)) for _, s in signatures])).alias("name"))
    longest = max(len(s) for _, s in signatures) - 1
    tails = rows.select(
        F.col("stream_id").alias("t_stream"), (F.col("seq") + 1).alias("t_seq"), F.col("ts").alias("t_ts"), F.right("text", F.lit(longest)).alias("tail")
    )
    heads = rows.select("stream_id", "seq", "ts", F.left("text", F.lit(longest)).alias("head"))
    bound = f" AND t_ts BETWEEN ts - INTERVAL {apart} AND ts + INTERVAL {apart}" if chunks.isStreaming else ""
    near = F.expr("stream_id = t_stream AND seq = t_seq" + bound)
    borders = heads.join(tails, near)
    crossing = [F.contains(F.concat(F.right("tail", F.lit(len(s) - 1)), F.left("head", F.lit(len(s) - 1))), F.lit(s)) for _, s in signatures]
    return inside.unionByName(borders.select("stream_id", F.explode(names(crossing)).alias("name")))


def chunked(documents: DataFrame) -> DataFrame:
    """stream_id, seq, ts, text: the texts cut every CHUNK_CHARS characters."""
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / CHUNK_CHARS).cast("int") - 1, F.lit(0)))
    rows = documents.select(F.col("doc_id").alias("stream_id"), "text", F.explode(cuts).alias("seq"))
    ts = F.timestamp_seconds(F.col("stream_id") % 1000 + F.col("seq"))
    return rows.select("stream_id", "seq", ts.alias("ts"), F.col("text").substr(F.col("seq") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("text"))


def reload_verdicts(stream: DataFrame, rules_of: Callable[[SparkSession], DataFrame], out: str, checkpoint: str) -> None:
    """Judge a stream of requests by the newest version of a domain list, read again for every batch.

    ``rules_of`` returns version and entry of the current list. Writes req_id, version, blocked.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        rules = rules_of(batch.sparkSession)
        version = rules.agg(F.max("version").alias("version"))
        listed = rules.select(F.col("entry").alias("host"), F.lit(True).alias("_hit")).distinct()
        rows = batch.select("req_id", U.host(F.col("url")).alias("host")).join(listed, "host", "left")
        # the version is one row
        rows = rows.select("req_id", F.coalesce("_hit", F.lit(False)).alias("blocked"), F.lit(version.first().version).alias("version"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
