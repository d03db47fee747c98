"""Long texts made of many: numbered by where each begins, joined by the sink alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.functions.tables import stored, sums_before
from loreforge.functions.text import ordered_join
from loreforge.sources.files import write_named_files

#: What stands between two texts that are merged (fixed value).
RULE = "\n\n---\n\n"


def text_segments(texts: DataFrame, key: str, order: str, text: str = "text", between: str = RULE) -> DataFrame:
    """(key, order, start, length, text): each text with the code point at which it begins in its key's whole.

    Starts are sums over ranges of (key, order), so no task and no row holds a key. Rows of a null text or key have no place;
    an empty text has one, with the separator before it. Rows of equal order are taken in the order of their texts.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text")).where("key is not null and text is not null")
    # the separator is counted with the text that follows; the first has none, so all starts are beyond it by as much
    length = F.length("text").cast("long")
    out = sums_before(rows.withColumn("length", length), "key", ["ord", "text"], length + len(between), "start")
    return out.select(F.col("key").alias(key), F.col("ord").alias(order), "start", "length", F.col("text").alias(text))


def segment_totals(segments: DataFrame, key: str) -> DataFrame:
    """(key, segments, chars): texts and code points of each key's whole."""
    return segments.groupBy(key).agg(F.count("*").alias("segments"), F.max(F.col("start") + F.col("length")).alias("chars"))


def text_blocks(segments: DataFrame, key: str, chars: int = 1_000_000, text: str = "text", between: str = RULE) -> DataFrame:
    """(key, block, text): each key's whole cut into blocks of `chars` code points, numbered from 0; the last may be shorter.

    Segments are cut where a block ends and joined within it, so a row holds a block and no key meets in a task. A whole that is
    empty has no block.
    """
    later = F.col("start") > 0
    begin = F.when(later, F.col("start") - len(between)).otherwise(F.col("start"))
    rows = segments.select(key, begin.alias("begin"), F.when(later, F.concat(F.lit(between), F.col(text))).otherwise(F.col(text)).alias("t"))
    rows = rows.withColumn("end", F.col("begin") + F.length("t")).where("end > begin")
    first, last = F.floor(F.col("begin") / chars), F.floor((F.col("end") - 1) / chars)
    inside = lambda k: F.greatest(k * chars - F.col("begin"), F.lit(0))
    pieces = F.transform(
        F.sequence(first, last),
        lambda k: F.struct(k.alias("block"), F.greatest(k * chars, F.col("begin")).alias("at"), F.substr("t", (inside(k) + 1).cast("int"), F.least((k + 1) * chars - F.col("begin") - inside(k), F.lit(chars)).cast("int")).alias("piece")),
    )
    parts = rows.select(key, F.inline(pieces))
    return parts.groupBy(key, "block").agg(ordered_join("piece", ["at"], "").alias("text"))


def write_segments(segments: DataFrame, key: str, folder: str, suffix: str = ".md", text: str = "text", between: str = RULE) -> DataFrame:
    """Writes each key's whole to `key` + suffix below the folder; (path, lines) of what was written, lines being its segments.

    A file is written by one task, which holds a batch of segments at a time and never the whole.
    """
    rows = segments.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("path"), F.col(text).alias("line"), "start")
    return stored(write_named_files(rows, folder, "start", between=between), "segments-written")
