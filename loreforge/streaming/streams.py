"""Structured Streaming: new documents, resumed runs, running log statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreforge.operators.chunking import chunk_markdown
from loreforge.operators.density import ANCHORS, filter_chunks


def stream_new_documents(stream: DataFrame, chunks_path: str, checkpoint: str, known: DataFrame | None = None, doc_name: str = "doc_name", text: str = "markdown", anchors=ANCHORS) -> StreamingQuery:
    """Chunks and filters each new document once, as files arrive; the chunks carry the text's hash.

    The hashes seen so far are keyed state of the query, dealt over the executors and saved with the checkpoint, so a batch
    looks up its own hashes alone and a query that was stopped goes on where it was. Of equal texts the first to arrive counts.
    `known` is a table of hashes that were registered before the stream. The file sink writes each batch once. Sessions with
    many documents should choose the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = stream.withColumn("hash", F.sha2(text, 256))
    if known is not None:
        registered = known.select(F.col("hash").alias("_known")).distinct()
        rows = rows.join(registered, F.col("hash") == F.col("_known"), "left").where("_known is null").drop("_known")
    rows = rows.dropDuplicates(["hash"])
    out = filter_chunks(chunk_markdown(rows, text, doc_name), anchors=anchors)
    return out.writeStream.format("parquet").outputMode("append").option("path", chunks_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_resume(chunks: DataFrame, work, out_path: str, checkpoint: str) -> StreamingQuery:
    """Runs work(df) over a stream of chunks; a stopped run goes on with what isn't done, and a batch that runs again replaces its rows."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_log_stats(calls: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Calls, tokens and mean latency of each phase and day, with late records up to the delay; works on streams and tables."""
    rows = calls.withWatermark("ts", delay).groupBy(F.window("ts", width), "phase")
    return rows.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.avg("latency_ms").alias("avg_latency_ms")).select(F.col("window.start").alias("day"), "phase", "calls", "tokens", "avg_latency_ms")


def write_log_stats(calls: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", width: str = "1 day") -> StreamingQuery:
    """stream_log_stats() of a stream, each window written once: when the watermark (latest ts less the delay) has passed its end.

    Records whose window has been written are late and dropped; those within the delay count.
    """
    out = stream_log_stats(calls, delay, width)
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
