"""Minimax contiguous partition of ordered atomic groups into shards of nearly equal bytes."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import join_counted, numbered, partitions_for, read_table, stored


class _Prefix:
    """Ends of the groups on the line of summed bytes. Blocks of groups are in spans of blocks; the driver holds the ends of at
    most `most` spans, and reads the blocks of a span and the groups of a block only where a cut is probed.

    So what it holds at once is bounded by `most` spans, most blocks of max_open spans (up to 16 million blocks) and the groups
    of max_open blocks.
    """

    def __init__(self, groups: DataFrame, n_blocks: int, max_open: int = 32, most: int = 4096):
        self.groups, self.max_open = groups, max_open
        fan = -(-n_blocks // most)
        blocks = groups.groupBy("block").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m")).withColumn("span", F.floor(F.col("block") / fan))
        self.blocks = stored(blocks, "shard-blocks")
        sums = self.blocks.groupBy("span").agg(F.sum("b").alias("b"), F.max("m").alias("m")).orderBy("span").collect()
        self.spans, self.starts, self.total = [r["span"] for r in sums], [], 0
        for r in sums:
            self.starts.append(self.total)
            self.total += r["b"]
        self.largest = max((r["m"] for r in sums), default=0)
        self.open: dict[tuple, list] = {}

    def _read(self, key: tuple, table: DataFrame, start: int, *cols: str) -> list[tuple]:
        """(end, row) of the ordered rows of a span or block, which begins at start."""
        if key not in self.open:
            if len(self.open) >= 2 * self.max_open:
                self.open.pop(next(iter(self.open)))
            out, at = [], start
            for r in table.collect():
                at += r[0]
                out.append((at, *r[1:]))
            self.open[key] = out
        return self.open[key]

    def group_after(self, x: int) -> tuple[int, tuple | None]:
        """The largest group end (or 0) that is at most x, and the (doc_id, digest) of the group that begins there."""
        k = bisect_right(self.starts, x) - 1
        span, at = self.spans[k], self.starts[k]
        for end, block in self._read((span,), self.blocks.where(F.col("span") == span).orderBy("block").select("b", "block"), at):
            if x < end:
                break
            at = end
        rows = self._read((span, block), self.groups.where(F.col("block") == block).orderBy("first").select("bytes", "first"), at)
        i = bisect_right(rows, x, key=lambda r: r[0])
        return (rows[i - 1][0] if i else at), (tuple(rows[i][1]) if i < len(rows) else None)

    def floor(self, x: int) -> int:
        return self.total if x >= self.total else self.group_after(x)[0]

    def rough(self, x: int, up: bool) -> int:
        """The end of the span around x (up) or its start: what floor(x) lies between."""
        if x >= self.total:
            return self.total
        k = bisect_right(self.starts, x) - 1
        return min(x, self.starts[k + 1] if k + 1 < len(self.starts) else self.total) if up else self.starts[k]


def _cuts(n: int, capacity: int, total: int, floor) -> list[int] | None:
    """Greedy: each shard takes groups up to the capacity; None if n shards don't hold all."""
    at, cuts = 0, []
    for _ in range(n):
        at = floor(at + capacity)
        cuts.append(at)
        if at >= total:
            return cuts + [total] * (n - len(cuts))
    return None


def minimax_cuts(prefix: _Prefix, n: int) -> tuple[int, list[int]]:
    """The smallest capacity with which n contiguous shards hold all groups, and the ends of the shards."""
    total = prefix.total
    lo, hi = max(prefix.largest, -(-total // n)), max(prefix.largest, -(-total // n)) + prefix.largest
    lo0 = lo

    def search(lo, hi, ok):
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
        return lo

    if total:
        # block ends alone bound the answer on both sides; groups are read for what remains between the bounds
        hi = min(hi, search(lo, hi, lambda c: _cuts(n, c, total, lambda x: prefix.rough(x, False)) is not None))
        lo = max(lo0, search(lo, hi, lambda c: _cuts(n, c, total, lambda x: prefix.rough(x, True)) is not None))
        lo = search(lo, hi, lambda c: _cuts(n, c, total, prefix.floor) is not None)
    return lo, _cuts(n, lo, total, prefix.floor) or [0] * n


def shard_documents(docs: DataFrame, n_shards: int = 8, groups_each: int = 20_000, spans: int = 4096) -> DataFrame:
    """Deals documents into n_shards contiguous runs of atomic groups so that the largest shard is as small as can be.

    Groups are equal texts (all null texts are one, apart from empty ones), ordered by their smallest doc_id
    (nulls first, then by the text's digest). Size: UTF-8 bytes plus 1. Returns doc_id, size, text_crc32, law,
    shard, slot and grown_shard. Repeated rows count each time. An empty table gives no rows. Other columns are
    left out.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"),
    )
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = stored(groups, "shard-groups")
    n_blocks = partitions_for(spark, groups.count(), groups_each)
    ordered = groups.repartitionByRange(n_blocks, "first").withColumn("block", F.spark_partition_id())
    ordered = stored(ordered.sortWithinPartitions("first"), "shard-order")
    prefix = _Prefix(ordered, n_blocks, most=spans)
    _, ends = minimax_cuts(prefix, n_shards)

    # the first group of each shard but the first: the one that begins at the end of the shard before
    marks = [None if end >= prefix.total else prefix.group_after(end)[1] for end in ends[:-1]]
    shard = F.lit(0)
    for m in marks:
        if m is not None:
            at_or_after = (F.col("first") >= F.struct(F.lit(m[0]).cast("long").alias("doc_id"), F.lit(m[1]).alias("digest")))
            shard = shard + at_or_after.cast("int")
    placed = stored(ordered.select("digest", "rows", shard.cast("int").alias("shard")), "shard-groups-placed")
    out = join_counted(rows, placed, ["digest"], "rows").select("doc_id", "size", "text_crc32", "digest", "shard")
    # repeated rows are told apart by a number that is fixed when they are written
    out = stored(out.withColumn("_row", F.monotonically_increasing_id()), "shard-placed")
    out = numbered(out, ["shard"], ["doc_id", "digest", "_row"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark, sf_dir) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
