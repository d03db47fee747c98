"""Helpers shared by the training-data operators: tables in the shared folder, words in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.session import shared_dir

# ---------------------------------------------------------------- shared folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and sizes are known."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by stored() that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 16 << 20) -> int:
    """Number of partitions so that one holds about `each` bytes; never under the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each))


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name with as many underscores before it that no column is called so."""
    names = {c.lower() for c in taken}
    while name in names:
        name = "_" + name
    return name


def attach(rows: DataFrame, table: DataFrame, key: str, how: str = "left", make: Column | None = None, limit: int = 20_000, salts: int = 64) -> DataFrame:
    """rows joined to a table with one small row for each value of the string column `key`.

    The table is counted: up to `limit` rows are broadcast; more are joined by shuffle, each value dealt to `salts` parts,
    since one may hold a large share of the rows. `make` is the key where rows have no such column.
    """
    if make is not None:
        rows = rows.withColumn(key, make)
    table = stored(table, "attached")
    if table.count() <= limit:
        out = rows.join(F.broadcast(table), key, how)
    else:
        salt = free_name("salt", rows.columns)
        spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        out = rows.join(spread.hint("shuffle_hash"), [key, salt], how).drop(salt)
    return out if make is None else out.drop(key)


def join_counted(rows: DataFrame, per_key: DataFrame, key: list[str], n: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined to a stored table with one row for each key, in which column `n` counts the key's rows.

    Keys with more than a 1 / share of all rows are fewer than `share`, whatever the input: their table is broadcast, so
    the rows of a hot key stay where they are. All others meet by shuffle. Keys aren't null; `how` is inner, left_semi or left.
    """
    total = per_key.agg(F.sum(n)).collect()[0][0] or 0
    bound = max(total // share, 1000)
    cold = per_key.select(*key, n) if how == "left_semi" else per_key
    if not per_key.where(F.col(n) > bound).limit(1).count():
        return rows.join(cold.hint("merge"), key, how)
    hot = F.broadcast(cold.where(F.col(n) > bound))
    out = rows.join(hot, key, "inner" if how == "left" else how)
    rest = rows.join(hot.select(*key), key, "left_anti").join(cold.where(F.col(n) <= bound).hint("merge"), key, how)
    return out.unionByName(rest)


def numbered(df: DataFrame, key: list[str], order: list[str], out: str, rows_each: int = 200_000) -> DataFrame:
    """Adds `out`: 0, 1, ... within each key, in the given order (which has no ties), without a task for a whole key.

    The rows are dealt by range and written; each written range is numbered on its own and moved by the
    count of the rows before it, so a key with a third of all rows is spread over many tasks.
    """
    spark = df.sparkSession
    dealt = stored(
        df.repartitionByRange(partitions_for(spark, 0), *key, *order).withColumn("_part", F.spark_partition_id()), "numbered"
    )
    by_key = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by_key), F.lit(0))).drop("_n")
    in_part = W.partitionBy("_part", *key).orderBy(*order)
    rows = dealt.withColumn("_in", F.row_number().over(in_part) - 1)
    cond = [rows[k].eqNullSafe(before[k]) for k in ["_part", *key]]
    joined = rows.join(before.hint("shuffle_hash"), cond)
    return joined.select(*[rows[c] for c in df.columns], (F.col("_in") + F.col("_before")).cast("long").alias(out))


def sums_before(df: DataFrame, key: list[str], order: list[str], value: str, out: str, rows_each: int = 200_000) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one within its key, without a task for a whole key.

    As in `numbered`, rows are dealt by range and each range is moved by the sums of the ranges before it. Rows that tie in
    `order` may change places, so they should be equal in all that matters.
    """
    spark = df.sparkSession
    n_parts = partitions_for(spark, df.count(), rows_each)
    dealt = stored(df.repartitionByRange(n_parts, *key, *order).withColumn("_part", F.spark_partition_id()), "sums")
    by_key = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*key, "_part").agg(F.sum(value).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(by_key), F.lit(0))).drop("_n")
    in_part = W.partitionBy("_part", *key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumn("_in", F.coalesce(F.sum(value).over(in_part), F.lit(0)))
    joined = rows.join(before.hint("shuffle_hash"), [rows[k].eqNullSafe(before[k]) for k in ["_part", *key]])
    return joined.select(*[rows[c] for c in df.columns], (F.col("_in") + F.col("_before")).cast("long").alias(out))


# ---------------------------------------------------------------- words in numpy

M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("pow", ())) < n:
        n = max(n, _CHUNK + 4096)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["pow"], _powers["inv"]


def byte_table(separators: Iterable[int]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: Words are runs of anything but ASCII white space.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters and digits and of all that isn't ASCII.
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words and the bytes after their last."""
    m = np.zeros(len(buf) + 2, dtype=np.int8)
    m[1:-1] = table[buf]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; the buffer is taken in pieces, so memory doesn't grow with one long text."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, side="right")))
        piece = buf[lo : int(ends[j - 1])]
        pw, inv = _power(len(piece) + 1)
        p = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_RANDOM[piece] * pw[: len(piece)], out=p[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((p[e] - p[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; none where there are fewer."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        acc = acc * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(acc)


def groups_of(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer one is alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each value; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def word_batches(texts: list[bytes], table: np.ndarray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: number of the first text, buffer, starts, ends, hashes of words, and for each text its first word (one more at the end)."""
    for lo, hi in groups_of(texts):
        part = texts[lo:hi]
        buf = np.frombuffer(b"\n".join(part), dtype=np.uint8)
        if lower:
            buf = LOWER[buf]
        starts, ends = word_spans(buf, table)
        at = np.cumsum([0, *(len(t) + 1 for t in part)])
        yield lo, buf, starts, ends, span_hashes(buf, starts, ends), np.searchsorted(starts, at)


def int_list(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, type=kind or pa.int64())
